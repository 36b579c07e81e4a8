"""The leaderboard: result runs to cells, averages, ranks, bounds and colours.

Runs are ordered by their file's name, and what is first or last is so by that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Anchors of the colour scale and the colour of an absent value (fixed values).
GREEN, YELLOW, RED, MISSING = (0, 200, 0), (220, 200, 0), (220, 0, 0), (90, 90, 90)
FAILED = 0.99


def display_name(model: Column, file: Column) -> Column:
    """A model's name with the mode that its file's name tells."""
    return F.when(file.contains("-online"), F.concat(model, F.lit(" (online)"))).when(model.contains("Realtime") & ~file.contains("online"), F.concat(model, F.lit(" (offline)"))).otherwise(model)


def named(runs: DataFrame) -> DataFrame:
    return runs.withColumn("name", display_name(F.col("model"), F.col("file")))


def without_failed(runs: DataFrame, threshold: float = FAILED) -> DataFrame:
    """The runs whose primary error rate is under the threshold or unknown."""
    wer = F.try_element_at("results", F.col("primary_reference"))["wer"]
    return runs.where(F.coalesce(wer, F.lit(0.0)) < threshold)


def latest(runs: DataFrame) -> DataFrame:
    """One run for each name and dataset, the last; ``position`` and ``ordinal`` are the first files of pair and name."""
    own = Window.partitionBy("name", "dataset")
    out = runs.withColumn("place", F.row_number().over(own.orderBy(F.desc("file")))).withColumn("position", F.min("file").over(own))
    return out.where("place = 1").drop("place").join(runs.groupBy("name").agg(F.min("file").alias("ordinal")), "name")


def dataset_primary(runs: DataFrame) -> DataFrame:
    """(dataset, primary, dataset_ordinal): the first primary that a run of the dataset names, and the dataset's first file."""
    named_one = F.when(F.coalesce("primary_reference", F.lit("")) != "", F.col("file"))
    return runs.groupBy("dataset").agg(F.min_by("primary_reference", named_one).alias("primary"), F.min("file").alias("dataset_ordinal"))


def cells(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(name, dataset, ref_name, wer, cer, is_primary) of the kept runs; the primary is the dataset's own."""
    each = kept.select("name", "dataset", F.explode("results").alias("ref_name", "m"))
    out = each.join(dataset_primary(runs), "dataset")
    return out.select("name", "dataset", "ref_name", "m.wer", "m.cer", F.coalesce(F.col("ref_name") == F.col("primary"), F.lit(False)).alias("is_primary"))


def ranked(averages: DataFrame) -> DataFrame:
    """Ranks from 1 by average error rate, unknown ones last, ties in the order in which the models were seen."""
    return averages.withColumn("rank", F.row_number().over(Window.orderBy(F.col("average_wer").asc_nulls_last(), "ordinal")))


def leaderboard(runs: DataFrame, exclude_failed: bool = False, threshold: float = FAILED) -> DataFrame:
    """(rank, model, average_wer, average_cer, rtfx): macro averages over the datasets' primary references.

    A run without its dataset's primary adds nothing to an average; a speed of 0 or none counts as unknown.
    """
    runs = named(runs)
    if exclude_failed:
        runs = without_failed(runs, threshold)
    kept = latest(runs)
    primary = cells(runs, kept).where("is_primary").groupBy("name").agg(F.avg("wer").alias("average_wer"), F.avg("cer").alias("average_cer"))
    fast = kept.groupBy("name").agg(F.min("ordinal").alias("ordinal"), F.avg(F.nullif(F.try_element_at("speed", F.lit("rtfx")), F.lit(0.0))).alias("rtfx"))
    return ranked(fast.join(primary, "name", "left")).select("rank", F.col("name").alias("model"), "average_wer", "average_cer", "rtfx")


def columns(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(dataset, ref_name, ordinal): the board's columns: datasets as first seen, the primary first, other references by name."""
    own = cells(runs, kept).select("dataset", "ref_name", "is_primary").distinct().join(dataset_primary(runs), "dataset")
    order = Window.orderBy("dataset_ordinal", F.col("is_primary").cast("int").desc(), "ref_name")
    return own.select("dataset", "ref_name", F.row_number().over(order).alias("ordinal"))


def column_bounds(values: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, vmin, vmax): least value, and the 90th percentile or, where that isn't above, the greatest, or a little more than the least."""
    low, high, top = F.min(value), F.percentile(value, 0.9), F.max(value)
    vmax = F.when(high > low, high).when(top > low, top).otherwise(low + 1e-6)
    return values.groupBy(*keys).agg(F.coalesce(low, F.lit(0.0)).alias("vmin"), F.coalesce(vmax, F.lit(1.0)).alias("vmax"))


def colour(value: Column, vmin: Column, vmax: Column) -> Column:
    """struct(r, g, b) of a value between its bounds: green over yellow to red, grey for none."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(vmax > vmin, (value - vmin) / (vmax - vmin)), F.lit(0.0))))

    def channel(k: int) -> Column:
        def between(a: int, b: int, share: Column) -> Column:
            return F.bround(F.lit(float(a)) + (b - a) * share, 0)

        scaled = F.when(t < 0.5, between(GREEN[k], YELLOW[k], t / 0.5)).otherwise(between(YELLOW[k], RED[k], (t - 0.5) / 0.5))
        return F.when(value.isNull(), F.lit(float(MISSING[k]))).otherwise(scaled).cast("int")

    return F.struct(*(channel(k).alias(n) for k, n in enumerate("rgb")))


def text_colour(rgb: Column) -> Column:
    """Black on light colours, white on dark ones."""
    return F.when(0.299 * rgb["r"] + 0.587 * rgb["g"] + 0.114 * rgb["b"] > 140, "#000000").otherwise("#ffffff")


def is_best(value: Column, *keys: str) -> Column:
    """Whether a value is the least of its column, but for rounding."""
    return F.coalesce(F.abs(value - F.min(value).over(Window.partitionBy(*keys))) < 1e-9, F.lit(False))


def pivoted(cells_: DataFrame, columns_: list[tuple[str, str]], value: str = "wer") -> DataFrame:
    """A row for each name, a column ``dataset::ref`` for each of ``columns_``."""
    labelled = cells_.withColumn("label", F.concat_ws("::", "dataset", "ref_name"))
    return labelled.groupBy("name").pivot("label", [f"{d}::{r}" for d, r in columns_]).agg(F.first(value))


def dataset_meta(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """(dataset, samples, models, language, references, primary): the most samples, the number of runs, the first language named, the board's columns."""
    spoken = F.when(F.coalesce("language", F.lit("")) != "", F.col("position"))
    facts = kept.groupBy("dataset").agg(F.max("num_samples").alias("samples"), F.count("*").alias("models"), F.coalesce(F.min_by("language", spoken), F.lit("")).alias("language"))
    names = columns(runs, kept).groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "ref_name"))), lambda c: c["ref_name"]).alias("references"))
    out = facts.join(names, "dataset", "left").join(dataset_primary(runs).select("dataset", "primary"), "dataset", "left")
    return out.select("dataset", "samples", "models", "language", F.coalesce("references", F.array().cast("array<string>")).alias("references"), F.coalesce("primary", F.lit("")).alias("primary"))


def ground_truth(kept: DataFrame) -> DataFrame:
    """(dataset, idx, speaker, duration, ref_name, reference): each reference by the first run that has a text for it."""
    each = kept.select("dataset", "position", F.explode("per_sample").alias("s")).select("dataset", "position", F.col("s.index").alias("idx"), "s.speaker_id", "s.duration", "s.references")
    who = each.groupBy("dataset", "idx").agg(F.min_by(F.struct("speaker_id", F.bround(F.coalesce("duration", F.lit(0.0)), 1).alias("duration")), "position").alias("w"))
    said = each.select("dataset", "idx", "position", F.explode("references").alias("ref_name", "reference")).where(F.coalesce("reference", F.lit("")) != "")
    said = said.groupBy("dataset", "idx", "ref_name").agg(F.min_by("reference", "position").alias("reference"))
    return who.join(said, ["dataset", "idx"], "left").select("dataset", "idx", F.col("w.speaker_id").alias("speaker"), F.col("w.duration").alias("duration"), "ref_name", "reference")


def drill_down(kept: DataFrame) -> DataFrame:
    """(name, dataset, idx, hypothesis, ref_name, reference, wer, cer): each hypothesis beside the ground truth, rates at four places."""
    said = kept.select("name", "dataset", F.explode("per_sample").alias("s")).select("name", "dataset", F.col("s.index").alias("idx"), "s.hypothesis", F.explode_outer("s.metrics").alias("ref_name", "m"))
    truth = ground_truth(kept).select("dataset", "idx", "ref_name", "reference")
    out = said.join(truth, ["dataset", "idx", "ref_name"], "left")
    return out.select("name", "dataset", "idx", "hypothesis", "ref_name", "reference", F.bround("m.wer", 4).alias("wer"), F.bround("m.cer", 4).alias("cer"))


def matching(details: DataFrame, text: str) -> DataFrame:
    """Utterances whose hypothesis or reference holds a text, whatever its case."""
    return details.where(F.contains(F.lower(F.concat_ws(" ", "hypothesis", "reference")), F.lower(F.trim(F.lit(text)))))


def utterance_order(by: str) -> list[Column]:
    """Sort keys for utterances (idx, wer): by ``index``, ``worst`` or ``best``; unknown rates last."""
    return {"index": [F.asc("idx")], "worst": [F.desc_nulls_last("wer"), F.asc("idx")], "best": [F.asc_nulls_last("wer"), F.asc("idx")]}[by]


#: What stands for a missing value where a table is sorted, so that it comes last in ascending order only (fixed value).
MISSING_LAST = 1e9


def table_order(column: str, descending: bool = False) -> list[Column]:
    """Sort keys for a board's table by a column of numbers, and then by its rank."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(MISSING_LAST))
    return [value.desc() if descending else value.asc(), F.asc("rank")]


def chart_rows(runs: DataFrame) -> DataFrame:
    """(name, dialect, ort, std): bars for charts in ascending order of the orthographic rate; none or 0 come last."""
    each = runs.select("name", *(F.try_element_at("results", F.lit(r))["wer"].alias(r) for r in ("dialect", "ort")), F.transform("per_sample", lambda s: F.try_element_at(s["metrics"], F.lit("ort"))["wer"]).alias("each"))
    std = each.select("name", F.explode("each").alias("w")).groupBy("name").agg(F.coalesce(F.stddev_pop("w"), F.lit(0.0)).alias("std"))
    out = each.drop("each").join(std, "name", "left").select("name", F.coalesce("dialect", F.lit(0.0)).alias("dialect"), "ort", F.coalesce("std", F.lit(0.0)).alias("std"))
    return out.orderBy(F.when(F.col("ort") > 0, F.col("ort")).asc_nulls_last(), "name")
