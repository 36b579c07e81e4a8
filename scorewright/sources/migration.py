"""Bringing the result files of a folder to the newer version in place, so that no stop half-way loses a file.

The tasks write the new files to a staging folder beside the old ones. Once all of them are there and
have been read again and compared, a journal that names them is written, and from then on the migration
goes forward: each old file is moved to the backup, and the new one to its place. A run that was
stopped before there was a journal leaves the folder as it was, and what it staged is thrown away; one that
was stopped later is completed by the next run, or undone by ``roll_back``. Only names go through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RESULT_FIELDS, result_files, unified

STAGING, BACKUP, JOURNAL = ".migration", "v1_backup", "journal.json"
#: How far rates may be from what they were.
CLOSE = 1e-9


class Folder:
    """A folder's files by name, wherever pyarrow opens it."""

    def __init__(self, place: str) -> None:
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place.removeprefix("file:"))
        self.kinds = fs.FileType

    def exists(self, name: str) -> bool:
        return self.system.get_file_info(f"{self.root}/{name}").type != self.kinds.NotFound

    def move(self, name: str, to: str) -> None:
        self.system.move(f"{self.root}/{name}", f"{self.root}/{to}")

    def make(self, name: str) -> None:
        self.system.create_dir(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        if self.exists(name):
            self.system.delete_dir(f"{self.root}/{name}")

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.root}/{name}") as file:
            return file.read()

    def write(self, name: str, body: bytes) -> None:
        """The file appears whole or not at all."""
        with self.system.open_output_stream(f"{self.root}/{name}.draft") as file:
            file.write(body)
        self.move(f"{name}.draft", name)


def _free(folder: Folder, name: str) -> str:
    """A name in the backup that no earlier migration has taken."""
    n, own = 0, f"{BACKUP}/{name}"
    while folder.exists(own):
        n, own = n + 1, f"{BACKUP}/{name}.{n + 1}"
    return own


def go_forward(folder: Folder) -> int:
    """Completes what the journal names, from wherever it was stopped; the number of files that it names, 0 without a journal."""
    if not folder.exists(f"{STAGING}/{JOURNAL}"):
        folder.drop(STAGING)
        return 0
    journal = json.loads(folder.read(f"{STAGING}/{JOURNAL}"))
    if journal["backup"]:
        folder.make(BACKUP)
    for name, kept in journal["files"].items():
        staged = f"{STAGING}/new/{name}"
        if not folder.exists(staged):
            continue  # it's in its place already
        if kept and folder.exists(name) and not folder.exists(kept):
            folder.move(name, kept)
        folder.move(staged, name)
    folder.move(f"{STAGING}/{JOURNAL}", f"{STAGING}/done.json")
    folder.drop(STAGING)
    return len(journal["files"])


def roll_back(place: str) -> int:
    """Puts back the old files of a migration that was stopped half-way; the number of those that had been moved.

    Without a journal there is nothing to undo but what was staged. A migration without backup can only go forward.
    """
    folder = Folder(place)
    if not folder.exists(f"{STAGING}/{JOURNAL}"):
        folder.drop(STAGING)
        return 0
    journal, back = json.loads(folder.read(f"{STAGING}/{JOURNAL}")), 0
    if not journal["backup"]:
        raise ValueError("a migration without backup can't be undone")
    for name, kept in journal["files"].items():
        if folder.exists(kept):
            folder.move(kept, name)
            back += 1
    folder.move(f"{STAGING}/{JOURNAL}", f"{STAGING}/undone.json")
    folder.drop(STAGING)
    return back


def stage(new: DataFrame, place: str) -> list[str]:
    """Writes a file of the newer version for each row of ``new`` (file, and the fields of a result) to the staging folder; their names."""
    rows = new.withColumn("schema_version", F.lit(2)).select("file", F.to_json(F.struct(*RESULT_FIELDS), {"ignoreNullFields": "false"}).alias("body"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder(place)
        folder.make(f"{STAGING}/new")
        for frame in frames:
            for name, body in zip(frame["file"], frame["body"], strict=True):
                folder.write(f"{STAGING}/new/{name}", body.encode())
            yield frame[["file"]]

    return sorted(r["file"] for r in rows.mapInPandas(write, "file string").collect())


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file): those whose rates, or numbers of samples, aren't the same in both, or that are in ``before`` alone."""

    def facts(of: DataFrame) -> DataFrame:
        rates = F.transform(F.array_sort(F.map_entries("results")), lambda e: F.struct(e["key"].alias("name"), e["value"]["wer"].alias("wer"), e["value"]["cer"].alias("cer")))
        return of.select("file", rates.alias("rates"), "num_samples", F.size("per_sample").alias("n"))

    a, b = facts(before).alias("a"), facts(after).alias("b")

    def close(x, y):
        return (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= CLOSE, F.lit(False))

    pairs = F.zip_with("a.rates", "b.rates", lambda x, y: x["name"].eqNullSafe(y["name"]) & close(x["wer"], y["wer"]) & close(x["cer"], y["cer"]))
    same = F.forall(pairs, lambda x: x) & (F.col("a.num_samples") == F.col("b.num_samples")) & (F.col("a.n") == F.col("b.n"))
    return a.join(b, F.col("a.file") == F.col("b.file"), "left").where(~F.coalesce(same, F.lit(False))).select("a.file")


def migrate_in_place(spark: SparkSession, place: str, backup: bool = True, dry_run: bool = False) -> dict[str, int]:
    """Counts of migrated, skipped (new already), failed (other after than before; left alone) and resumed files.

    First completes a migration that was stopped. A dry run only counts. Broken files, and JSON that isn't
    a run, are none of either.
    """
    folder = Folder(place)
    resumed = 0 if dry_run else go_forward(folder)
    runs = unified(result_files(spark, place))
    old = runs.where("schema_version < 2")
    counts = {"migrated": 0, "skipped": runs.where("schema_version >= 2").count(), "failed": 0, "resumed": resumed}
    if dry_run:
        return counts | {"migrated": old.count()}
    names = stage(old, place)
    if names:
        again = spark.read.schema(result_files(spark, place).drop("file").schema).json(f"{place}/{STAGING}/new", multiLine=True, columnNameOfCorruptRecord="_corrupt_record")
        bad = {r["file"] for r in differing(old, unified(again.withColumn("file", F.col("_metadata.file_name")))).collect()}
        kept = {n: _free(folder, n) if backup else "" for n in names if n not in bad}
        folder.write(f"{STAGING}/{JOURNAL}", json.dumps({"backup": backup, "files": kept}).encode())
        counts |= {"migrated": len(kept), "failed": len(bad)}
    go_forward(folder)
    return counts
