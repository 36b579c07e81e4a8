"""Result files of both schema versions, as one table of runs; writing and migrating them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import model_tag

METRICS = "struct<wer:double,cer:double,substitutions:bigint,deletions:bigint,insertions:bigint,num_samples:bigint>"
RATES = "struct<wer:double,cer:double>"
#: Fields of a sample in the newer files, and those that the older ones have for each reference (fixed values).
SAMPLE_FIELDS = "index:bigint,audio_path:string,hypothesis:string,duration:double,references:map<string,string>,metrics:map<string,struct<wer:double,cer:double>>,inference_time:double,speaker_id:string,raw_hypothesis:string,extra:string"
OLD_REFERENCES = ("dialect", "ort", "kan")
OLD_FIELDS = ",".join(f"{r}_reference:string,{r}_wer:double,{r}_cer:double" for r in OLD_REFERENCES) + ",selected_speaker:string,all_speakers:string"
SCHEMA = (
    "model string, dataset string, language string, num_samples bigint, num_skipped bigint, schema_version int, references array<string>, primary_reference string, "
    f"results map<string,{METRICS}>, speed map<string,double>, timestamp string, per_sample array<struct<{SAMPLE_FIELDS},{OLD_FIELDS}>>, _corrupt_record string"
)
SKIPPED = ("leaderboard.json",)


def run_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)


def normal_sample(s: Column, old: bool) -> Column:
    """A sample of a file's version as one of the newer version."""
    if old:
        texts = F.map_filter(F.create_map(*(x for r in OLD_REFERENCES for x in (F.lit(r), s[f"{r}_reference"]))), lambda _, v: v.isNotNull())
        rates = F.map_filter(F.create_map(*(x for r in OLD_REFERENCES for x in (F.lit(r), F.struct(s[f"{r}_wer"].alias("wer"), s[f"{r}_cer"].alias("cer"))))), lambda _, v: v["wer"].isNotNull() | v["cer"].isNotNull())
        extra = F.when(s["selected_speaker"].isNotNull() | s["all_speakers"].isNotNull(), F.to_json(F.struct(s["selected_speaker"].alias("selected_speaker"), s["all_speakers"].alias("all_speakers"))))
    else:
        empty = F.create_map().cast("map<string,string>")
        texts, rates, extra = F.coalesce(s["references"], empty), F.coalesce(s["metrics"], F.create_map().cast(f"map<string,{RATES}>")), s["extra"]
    plain = [F.coalesce(s["index"], F.lit(0).cast("long")).alias("index"), *(F.coalesce(s[c], F.lit("")).alias(c) for c in ("audio_path", "hypothesis")), F.coalesce(s["duration"], F.lit(0.0)).alias("duration")]
    return F.struct(*plain, texts.alias("references"), rates.alias("metrics"), s["inference_time"].alias("inference_time"), s["speaker_id"].alias("speaker_id"), s["raw_hypothesis"].alias("raw_hypothesis"), extra.alias("extra"))


def unified(raw: DataFrame) -> DataFrame:
    """Runs of one shape from rows as they are in the files; rows that are broken or lack results or model are left out.

    In the older version a reference's key has a suffix, unscored references are dropped, and the primary is
    the orthographic reference if it was scored, else the first.
    """
    rows = raw.where("_corrupt_record is null and results is not null and model is not null")
    version = F.coalesce("schema_version", F.lit(1))
    scored = F.map_filter("results", lambda _, m: m["wer"].isNotNull())
    old_results = F.transform_keys(scored, lambda k, _: F.regexp_replace(k, "_reference$", ""))
    names = F.map_keys(old_results)
    empty_speed = F.create_map().cast("map<string,double>")

    def shaped(part: DataFrame, old: bool) -> DataFrame:
        results, references = (old_results, names) if old else (F.col("results"), F.coalesce("references", F.array().cast("array<string>")))
        primary = F.when(F.array_contains(names, "ort"), "ort").otherwise(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))) if old else F.coalesce("primary_reference", F.lit(""))
        return part.select(
            "file",
            "model",
            F.coalesce("dataset", F.lit("unknown")).alias("dataset"),
            F.coalesce("language", F.lit("")).alias("language"),
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("num_samples", "num_skipped")),
            version.alias("schema_version"),
            references.alias("references"),
            primary.alias("primary_reference"),
            results.alias("results"),
            (F.coalesce("speed", empty_speed)).alias("speed"),
            F.coalesce("timestamp", F.lit("")).alias("timestamp"),
            F.coalesce(F.transform("per_sample", lambda s: normal_sample(s, old)), F.array().cast(f"array<struct<{SAMPLE_FIELDS}>>")).alias("per_sample"),
        )

    return shaped(rows.where(version < 2), True).unionByName(shaped(rows.where(version >= 2), False))


def result_files(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> DataFrame:
    """What a folder's result files hold, broken ones too; hidden files and boards are skipped."""
    raw = spark.read.schema(run_schema()).json(folder, multiLine=True, mode=mode, columnNameOfCorruptRecord="_corrupt_record", pathGlobFilter="*.json")
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    return raw.where(~F.col("file").isin(*SKIPPED) & ~F.col("file").startswith("."))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs in a folder's result files, with their files' names; broken files and such as aren't runs are skipped."""
    return unified(result_files(spark, folder))


def read_chart_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that charts are made of: also those without a model, which have an empty one; a broken file raises."""
    raw = result_files(spark, folder, mode="FAILFAST").withColumn("_corrupt_record", F.lit(None).cast("string"))
    return unified(raw.withColumn("model", F.coalesce("model", F.lit(""))))


def file_name(model: Column, dataset: Column) -> Column:
    return F.concat(model_tag(model), F.lit("__"), dataset, F.lit(".json"))


def write_runs(runs: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Runs in a folder for each dataset and model, so that readers of few of them skip the rest."""
    parts = runs.withColumns({"part_dataset": F.col("dataset"), "part_model": model_tag(F.col("model"))})
    parts.write.partitionBy("part_dataset", "part_model").mode("overwrite").format(kind).save(folder)


#: The fields of a result file in their order (fixed values).
RESULT_FIELDS = ("model", "dataset", "language", "num_samples", "num_skipped", "schema_version", "references", "primary_reference", "timestamp", "results", "speed", "per_sample")


def write_results(runs: DataFrame, folder: str) -> list[str]:
    """A JSON file of the newer version for each run under ``folder``; the names of the files.

    A file appears whole or not at all, so a task that is tried again only writes it anew. Of runs
    with one model and dataset one stays.
    """
    one = runs.withColumn("schema_version", F.lit(2)).groupBy(file_name(F.col("model"), F.col("dataset")).alias("file")).agg(F.max_by(F.struct(*RESULT_FIELDS), "file").alias("run"))
    rows = one.select("file", F.to_json("run", {"ignoreNullFields": "false"}).alias("body"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(root)
        for frame in frames:
            for name, body in zip(frame["file"], frame["body"], strict=True):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(body.encode())
                system.move(draft, f"{root}/{name}")
            yield frame[["file"]]

    return sorted(r["file"] for r in rows.mapInPandas(write, "file string").collect())


def migrated(runs: DataFrame) -> DataFrame:
    """Runs with their version before and after, and what became of them: ``migrated``, or ``skipped`` if new already."""
    before = F.col("schema_version")
    return runs.withColumns({"outcome": F.when(before >= 2, "skipped").otherwise("migrated"), "was": before, "schema_version": F.lit(2)})


def migrate(spark: SparkSession, folder: str, target: str, dry_run: bool = False) -> dict[str, int]:
    """Bring all result files to the newer version under ``target``; counts of migrated, skipped and failed files.

    What is written is read again and held against what was read first, by rates and numbers of samples.
    """
    raw = result_files(spark, folder)
    failed = raw.select("file", (F.col("_corrupt_record").isNotNull() | F.col("results").isNull() | F.col("model").isNull()).alias("bad"))
    new = migrated(unified(raw))
    counts = {r["outcome"]: r["count"] for r in new.groupBy("outcome").count().collect()}
    counts = {k: counts.get(k, 0) for k in ("migrated", "skipped")} | {"failed": failed.select("file", "bad").agg(F.count_if("bad").alias("n")).first()["n"]}
    if not dry_run:
        write_runs(new.drop("outcome", "was"), target)
        again = spark.read.parquet(target)
        facts = [F.col("file"), F.to_json("results").alias("results"), F.col("num_samples"), F.size("per_sample").alias("n")]
        counts["failed"] += new.select(*facts).exceptAll(again.select(*facts)).count()
    return counts
