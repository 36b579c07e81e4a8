"""Manifests and hypothesis files in JSON lines."""

from __future__ import annotations

import io
import wave
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import strip

LINE = "audio_filepath string, audio string, text string, duration double, utt_id string"
HYPOTHESIS = "audio_filepath string, ref string, text string, hyp string, hyp_raw string, index long, duration double, utt_id string"
#: Bytes at the beginning of a recording that hold its header.
HEAD = 65_536


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of text files, numbered from 0 in each; large files are read in splits.

    Lines are numbered within their split; the numbers of lines of the splits before are added.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1
    sizes = lines.groupBy("file", "split").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("file", "split", before.alias("ahead"))
    return lines.withColumn("line", within).join(ahead, ["file", "split"]).select("file", (F.col("line") + F.col("ahead")).alias("line"), "value")


def relocated(path: Column, root: str | None) -> Column:
    """A path's last part under another root, or the path itself."""
    return path if root is None else F.concat(F.lit(root.rstrip("/") + "/"), F.element_at(F.split(path, "/"), -1))


#: Numbers of lines, documents and so on that make a piece for ``indexed``.
PIECE = 65_536


def indexed(rows: DataFrame, *order: str, by: tuple[str, ...] = ("dataset",), pieces: Sequence[Column] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with a dense ``idx`` from 0 in the given order within each of ``by``, from ``offset`` on, at most ``limit``.

    ``pieces`` are columns that cut each of ``by`` into pieces of bounded size which lie in the given order;
    rows are sorted within their piece, and only the numbers of rows of the pieces are summed up in one task.
    Without any, the first column of the order is the piece.
    """
    cut = [f"_piece_{k}" for k in range(max(len(pieces), 1))]
    named = rows.withColumns(dict(zip(cut, pieces or [F.col(order[0])], strict=True)))
    sizes = named.groupBy(*by, *cut).count()
    before = F.sum("count").over(Window.partitionBy(*by).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select(*by, *cut, F.coalesce(before, F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(*by, *cut).orderBy(*order)) - 1
    same = reduce(and_, (F.col(f"n.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*by, *cut)))
    out = named.withColumn("_within", within).alias("n").join(ahead.alias("a"), same)
    out = out.select(*(f"n.{c}" for c in rows.columns), (F.col("n._within") + F.col("a.ahead")).cast("long").alias("idx"))
    out = out.where(F.col("idx") >= offset) if offset else out
    return out.where(F.col("idx") < offset + limit) if limit is not None else out


def header_seconds(head: bytes) -> float:
    """The duration that the beginning of a WAV file states; 0 where it can't be read."""
    try:
        with wave.open(io.BytesIO(head)) as sound:
            return sound.getnframes() / sound.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return 0.0


@F.pandas_udf(DoubleType())
def recorded_seconds(paths: pd.Series) -> pd.Series:
    """Durations by the headers of the recordings at these paths, of which only the beginning is read; 0 where there is none."""
    from pyarrow import fs

    def seconds(path: str | None) -> float:
        if path is None:
            return 0.0
        try:
            system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
            with system.open_input_file(place) as file:
                return header_seconds(file.read(HEAD))
        except (OSError, ValueError):
            return 0.0

    return paths.map(seconds)


def read_manifest(spark: SparkSession, path: str, dataset: str = "manifest", ref_name: str = "ref", audio_root: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples of a manifest: lines that are JSON with a text and a path; blank, broken and incomplete ones are left out.

    A duration that isn't stated comes from the recording's header, and is 0 where that can't be read.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("row", F.from_json("value", LINE, {"mode": "PERMISSIVE"}))
    audio = F.coalesce(F.nullif(F.col("row.audio_filepath"), F.lit("")), F.nullif(F.col("row.audio"), F.lit("")))
    rows = lines.select(F.lit(dataset).alias("dataset"), "file", "line", audio.alias("raw_path"), strip(F.coalesce("row.text", F.lit(""))).alias("text"), "row.duration", "row.utt_id")
    rows = indexed(rows.where((F.col("text") != "") & F.col("raw_path").isNotNull()), "file", "line", pieces=(F.col("file"), F.floor(F.col("line") / PIECE)), offset=offset, limit=limit)
    place = relocated(F.col("raw_path"), audio_root)
    return rows.select(
        "dataset",
        "idx",
        place.alias("audio_path"),
        F.coalesce("duration", recorded_seconds(F.when(F.col("duration").isNull(), place))).alias("duration"),
        F.col("text").alias("transcript"),
        F.create_map(F.lit(ref_name), F.col("text")).alias("references"),
        F.lit(ref_name).alias("primary_reference"),
        F.lit(None).cast("string").alias("speaker_id"),
        F.map_filter(F.create_map(F.lit("utt_id"), F.col("utt_id")), lambda _, v: v.isNotNull()).alias("metadata"),
    )


def read_hypotheses(spark: SparkSession, path: str, model: str, dataset: str) -> DataFrame:
    """(model, dataset, idx, reference, hypothesis, raw_hypothesis, duration, utt_id) of a file of answers; a broken line raises.

    ``ref`` goes before ``text``, and both and the answer are without white space at their ends; a missing
    answer is empty; a missing index is the number of the file's lines before that aren't blank.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    lines = indexed(lines, "line", by=("file",), pieces=(F.floor(F.col("line") / PIECE),))
    rows = lines.withColumn("row", F.from_json("value", HYPOTHESIS, {"mode": "FAILFAST"}))
    return rows.select(
        F.lit(model).alias("model"),
        F.lit(dataset).alias("dataset"),
        F.coalesce("row.index", F.col("idx")).alias("idx"),
        strip(F.coalesce(F.nullif(F.col("row.ref"), F.lit("")), "row.text", F.lit(""))).alias("reference"),
        strip(F.coalesce("row.hyp", F.lit(""))).alias("hypothesis"),
        F.col("row.hyp_raw").alias("raw_hypothesis"),
        F.coalesce("row.duration", F.lit(0.0)).alias("duration"),
        "row.utt_id",
    )
