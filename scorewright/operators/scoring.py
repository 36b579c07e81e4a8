"""From hypotheses and references to error rates per sample, reference and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import prepared, spread, with_error_rates

KEYS = ("model", "dataset", "ref_name")


def present_references(references: Column) -> Column:
    """A map of references without null and empty ones."""
    return F.map_filter(references, lambda _, text: text.isNotNull() & (text != ""))


def completed_references(references: Column, primary: Column, transcript: Column, orthographic: Column) -> Column:
    """The references, or where there are none the transcript under the primary's name, and the orthographic text."""
    made = F.map_from_arrays(F.array(primary), F.array(transcript))
    both = F.when((primary != "ort") & orthographic.isNotNull() & (orthographic != ""), F.map_concat(made, F.map_from_arrays(F.array(F.lit("ort")), F.array(orthographic)))).otherwise(made)
    return present_references(F.when(F.size(F.coalesce(references, F.create_map().cast("map<string,string>"))) > 0, references).otherwise(both))


def sample_pairs(samples: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(model, dataset, idx, ref_name, reference, hypothesis): each hypothesis beside each reference with text.

    ``samples`` has dataset, idx and references; ``hypotheses`` has model, dataset, idx and hypothesis.
    A sample without a hypothesis of a model gives that model no row; none is dropped for its position.
    """
    each = samples.select("dataset", "idx", F.explode(present_references(F.col("references"))).alias("ref_name", "reference"))
    return hypotheses.select("model", "dataset", "idx", "hypothesis").join(each, ["dataset", "idx"]).select("model", "dataset", "idx", "ref_name", "reference", "hypothesis")


def sample_metrics(samples: DataFrame, hypotheses: DataFrame, split: bool = False, rates: tuple[str, ...] = ("wer", "cer")) -> DataFrame:
    """The pairs with their edits and rates; both sides are dealt out by sample, since the work grows with the texts' lengths.

    Each text is normalised once, before it meets those that it is held against.
    """
    keys = ("dataset", "idx")
    each = spread(samples.select(*keys, "references"), *keys).select(*keys, F.explode(present_references(F.col("references"))).alias("ref_name", "reference"))
    said = spread(hypotheses.select("model", *keys, "hypothesis"), *keys)
    pairs = prepared(said, "hypothesis", "hyp").join(prepared(each, "reference", "ref"), [*keys])
    own = ("model", *keys, "ref_name", "reference", "hypothesis")
    return with_error_rates(pairs.select(*own, *(c for c in pairs.columns if c not in own)), split=split, rates=rates, ready=True)


def reference_metrics(metrics: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Micro-averaged rates for each group: all edits over all reference units, and the number of samples.

    References that normalise to nothing are left out; a group of only such has rate 0 and no samples.
    """
    some = F.col("empty_reference") == F.lit(False)
    sums = [F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("word_edits", "word_n", "char_edits", "char_n") if c in metrics.columns]
    sums += [F.sum(c).cast("long").alias(name) for c, name in (("subs", "substitutions"), ("dels", "deletions"), ("ins", "insertions")) if c in metrics.columns]
    out = metrics.groupBy(*keys).agg(*sums, F.count_if(some).alias("num_samples"))
    rates = {n: F.coalesce(F.try_divide(f"{u}_edits", f"{u}_n"), F.lit(0.0)) for n, u in (("wer", "word"), ("cer", "char")) if f"{u}_n" in metrics.columns}
    return out.withColumns(rates)


def speed(batches: DataFrame, keys: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """Audio seconds, inference seconds and their ratio from batches (audio_s, infer_s); none where no time was measured."""
    out = batches.groupBy(*keys).agg(F.sum("audio_s").alias("total_audio_s"), F.sum("infer_s").alias("total_infer_s"))
    return out.where(F.col("total_infer_s") > 0).withColumn("rtfx", F.col("total_audio_s") / F.col("total_infer_s"))


def run_primary(samples: DataFrame, known: tuple[str, ...] | None = None) -> DataFrame:
    """(dataset, primary_reference): the primary of the first sample whose own primary is a reference of the dataset."""
    rows = samples.select("dataset", "idx", "primary_reference", F.map_keys(present_references(F.col("references"))).alias("names"))
    if known is None:
        names = rows.groupBy("dataset").agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("known"), F.min_by(F.try_element_at("names", F.lit(1)), F.when(F.size("names") > 0, F.col("idx"))).alias("first"))
        rows = rows.join(names, "dataset").withColumn("fits", F.array_contains("known", F.col("primary_reference")))
        return rows.groupBy("dataset").agg(F.coalesce(F.min_by("primary_reference", F.when(F.col("fits"), F.col("idx"))), F.first("first")).alias("primary_reference"))
    fits = F.col("primary_reference").isin(*known)
    return rows.groupBy("dataset").agg(F.coalesce(F.min_by("primary_reference", F.when(fits, F.col("idx"))), F.lit(known[0] if known else None)).alias("primary_reference"))


def reference_order(samples: DataFrame) -> DataFrame:
    """(dataset, ref_name, ordinal): the reference names in the order in which they are first seen."""
    seen = samples.select("dataset", "idx", F.posexplode(F.map_keys("references")).alias("pos", "ref_name"))
    return seen.groupBy("dataset", "ref_name").agg(F.min(F.struct("idx", "pos")).alias("ordinal"))
