"""Stand-ins for samples, hypotheses and result runs, derived from the standard tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators.tables import shared_folder
from ..sources.migration import Folder
from ..sources.runs import write_results

#: Letters that a second reference has in other places (fixed values).
VOWELS, TURNED = "aeiou", "eioua"
MODELS = ("drop5", "swap7", "twice6", "half")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, reference, hypothesis): a user's turn, and the assistant's turn right after it as its hypothesis."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return said.join(answers, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "reference", "hypothesis")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a sample with two named references."""
    turns = table(spark, sf_dir, "conversations")
    references = F.create_map(F.lit("ort"), F.col("text"), F.lit("dialect"), F.translate("text", VOWELS, TURNED))
    return turns.select(F.col("role").alias("dataset"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("transcript"), references.alias("references"), F.lit("ort").alias("primary_reference"))


def misheard(model: str, text: Column) -> Column:
    """A text as one of four deterministic models hears it, by the words' positions alone."""
    w = words(F.regexp_replace(text, r"\s+", " "))
    heard = {
        "drop5": F.filter(w, lambda _, k: k % 5 != 4),
        "swap7": F.transform(w, lambda x, k: F.when(k % 7 == 6, F.lit("xx")).otherwise(x)),
        "twice6": F.flatten(F.transform(w, lambda x, k: F.when(k % 6 == 5, F.array(x, x)).otherwise(F.array(x)))),
        "half": F.slice(w, F.lit(1), F.ceil(F.size(w) / 2).cast("int")),
    }
    return F.array_join(heard[model], " ")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models' hypotheses for each sample."""
    each = samples(spark, sf_dir).select("dataset", "idx", F.explode(F.create_map(*(x for m in MODELS for x in (F.lit(m), misheard(m, F.col("transcript")))))).alias("model", "hypothesis"))
    return each.select("model", "dataset", "idx", "hypothesis")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result runs: a model for each supplier number modulo 12, a dataset for each return flag, a reference for each line status."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.concat(F.lit("m"), F.col("l_suppkey") % 12).alias("model"), F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("ref")]
    each = lines.groupBy(*keys).agg((F.sum("l_linenumber") / F.sum("l_quantity")).alias("wer"), (F.sum("l_discount") / F.sum("l_quantity")).alias("cer"), F.count("*").alias("n"), F.sum("l_tax").alias("t"))
    out = each.groupBy("model", "dataset").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ref", F.struct("wer", "cer", F.col("n").alias("num_samples")))))).alias("results"),
        F.sum("n").alias("num_samples"),
        (F.sum("n") / F.sum("t")).alias("rtfx"),
    )
    # R's runs have one reference only, so that some datasets lack the usual primary
    return out.select(
        F.concat("model", F.lit("__"), "dataset", F.lit(".json")).alias("file"),
        "model",
        "dataset",
        F.lit("").alias("language"),
        "num_samples",
        F.when(F.array_contains(F.map_keys("results"), "O"), "O").otherwise("F").alias("primary_reference"),
        "results",
        F.create_map(F.lit("rtfx"), F.when(F.col("dataset") == "N", 0.0).otherwise(F.col("rtfx"))).alias("speed"),
    )


def result_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with samples as a result file has them: a model for each role, a dataset for each conversation number modulo 3, a turn a sample."""
    turns = table(spark, sf_dir, "conversations")
    rates = F.struct((F.length("text") / 7000).alias("wer"), (F.length("text") / 9000).alias("cer"))
    sample = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.lit("a.wav").alias("audio_path"), F.col("text").alias("hypothesis"), F.lit(1.25).alias("duration"), F.create_map(F.lit("ort"), F.substring("text", 1, 9)).alias("references"), F.create_map(F.lit("ort"), rates).alias("metrics"), F.lit("s").alias("speaker_id"))
    keys = [F.col("role").alias("model"), F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("dataset")]
    out = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.to_json(sample).alias("sample")))).alias("each"), F.avg(rates["wer"]).alias("wer"), F.avg(rates["cer"]).alias("cer"), F.count("*").alias("num_samples"))
    results = F.create_map(F.lit("ort"), F.struct("wer", "cer", "num_samples"))
    fields = "struct<index:bigint,audio_path:string,hypothesis:string,duration:double,references:map<string,string>,metrics:map<string,struct<wer:double,cer:double>>,speaker_id:string>"
    return out.select(
        F.concat("model", F.lit("__"), "dataset", F.lit(".json")).alias("file"),
        "model",
        "dataset",
        F.lit("deu_Latn").alias("language"),
        "num_samples",
        F.lit(0).alias("num_skipped"),
        F.lit(2).alias("schema_version"),
        F.array(F.lit("ort")).alias("references"),
        F.lit("ort").alias("primary_reference"),
        F.lit("").alias("timestamp"),
        results.alias("results"),
        F.create_map(F.lit("rtfx"), F.col("num_samples").cast("double")).alias("speed"),
        F.transform("each", lambda x: F.from_json(x["sample"], fields)).alias("per_sample"),
    )


def result_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Those runs as result files in a folder of their own."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_results(result_runs(spark, sf_dir), folder)
    return folder


def old_result_folder(spark: SparkSession, sf_dir: str) -> str:
    """Runs by role and conversation number modulo 3 as result files of the older version, written by tasks; even roles' files are named in full."""
    folder = f"{shared_folder(spark)}/old-results-{uuid.uuid4().hex}"
    sample = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.col("text").alias("hypothesis"), F.substring("text", 1, 9).alias("ort_reference"), (F.length("text") / 7000).alias("ort_wer"), (F.length("text") / 9000).alias("ort_cer")))
    keys = [F.col("role").alias("model"), F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("dataset")]
    runs_ = table(spark, sf_dir, "conversations").groupBy(*keys).agg(F.concat_ws(",", F.collect_list(sample)).alias("samples"), F.avg(F.length("text") / 7000).alias("wer"), F.count("*").alias("n"))
    body = F.format_string('{"model":"%s","dataset":"%s","num_samples":%d,"results":{"ort_reference":{"wer":%s},"dialect_reference":{"wer":null}},"per_sample":[%s]}', "model", "dataset", "n", F.to_json(F.struct("wer")), "samples")
    body = F.regexp_replace(body, r'"wer":\{("wer":[^}]*)\}', "$1")
    rows = runs_.select(F.concat("model", F.lit("-"), "dataset", F.lit(".json")).alias("file"), body.alias("body"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = Folder(folder)
        place.make("")
        for frame in frames:
            for name, text in zip(frame["file"], frame["body"], strict=True):
                place.write(name, text.encode())
            yield frame[["file"]]

    rows.mapInPandas(write, "file string").collect()
    return folder
