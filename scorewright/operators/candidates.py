"""Speakers in a model's answer, and which of several candidate texts fits the references best."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.distance import spread, with_error_rates
from ..functions.text import cut_loop, strip

SEGMENTS = "array<struct<Start:double,End:double,Speaker:int,Content:string>>"
ANSWER = "struct<text:string,transcript:string,result:array<struct<result_index:double,transcript_formatted:string,transcript:string>>>"
OBJECT = "struct<Speaker:int,Content:string>"
#: A span of times and a numbered speaker, wherever they stand in a line (fixed values).
TIMES, SPOKEN_BY = r"\[\d{2}:\d{2}\.\d{2}\s*-\s*\d{2}:\d{2}\.\d{2}\]", r"(?i)speaker[_\s]?\d+:\s*"
#: A JSON string, an object without objects in it, and one that is cut off within a string.
STRING = r'"(?:[^"\\]|\\.)*+"'
CLOSED = rf'\{{(?:[^{{}}"]|{STRING})*+\}}'
CUT_OFF = rf'\{{(?:[^{{}}"]|{STRING})*+"(?:[^"\\]|\\.)*+$'


def objects(raw: Column, closed: bool) -> Column:
    """The flat JSON objects of a broken answer, each parsed on its own: the closed ones, or one that is cut off within a string, closed here."""
    if closed:
        parsed = F.transform(F.regexp_extract_all(raw, F.lit(f"(?s){CLOSED}"), F.lit(0)), lambda x: F.from_json(x, OBJECT))
    else:
        parsed = F.array(F.from_json(F.concat(F.regexp_extract(raw, f"(?s){CUT_OFF}", 0), F.lit('"}')), OBJECT))
    return F.filter(parsed, lambda x: x["Content"].isNotNull())


def plain_text(raw: Column) -> Column:
    """The spoken text of an answer: all of its contents, else one that is cut off, else its lines without times and names."""
    raw = F.coalesce(raw, F.lit(""))
    contents = F.transform(objects(raw, closed=True), lambda x: x["Content"])
    cut_off = strip(F.coalesce(F.try_element_at(objects(raw, closed=False), F.lit(1))["Content"], F.lit("")))
    lines = F.transform(F.split(strip(raw), "\n"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, TIMES, ""), SPOKEN_BY, "")))
    return F.when(F.size(contents) > 0, cut_loop(F.array_join(contents, " "))).when(cut_off != "", cut_loop(cut_off)).otherwise(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def speaker_texts(answers: DataFrame, raw: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, ordinal, speaker, text): each speaker's text in an answer, speakers in the order in which they appear.

    A JSON array is read as one; where it is broken, its complete pairs of speaker and content are, else a
    last one that is cut off, else the plain text counts as speaker 0's. Each step is a column of its own,
    so that none is evaluated again for each element.
    """
    said = "array<struct<speaker:int,text:string>>"
    out = answers.select(*keys, F.coalesce(F.col(raw), F.lit("")).alias("raw"))
    named = {name: F.filter(objects(F.col("raw"), closed), lambda x: x["Speaker"].isNotNull()) for name, closed in (("closed", True), ("open", False))}
    out = out.withColumns({"listed": F.from_json(F.regexp_extract("raw", r"(?s)(\[.*\])", 1), SEGMENTS), **named})
    valid = F.coalesce(F.exists("listed", lambda x: x["Speaker"].isNotNull() | x["Content"].isNotNull()), F.lit(False))
    from_json = F.transform(F.filter("listed", lambda x: x.isNotNull()), lambda x: F.struct(F.coalesce(x["Speaker"], F.lit(0)).alias("speaker"), F.coalesce(x["Content"], F.lit("")).alias("text")))
    closed, cut_off = (F.transform(c, lambda x: F.struct(x["Speaker"].alias("speaker"), strip(x["Content"]).alias("text") if c == "open" else x["Content"].alias("text"))) for c in ("closed", "open"))
    said_last = F.exists(cut_off, lambda x: x["text"] != "")
    out = out.withColumn("found", F.when(valid, from_json.cast(said)).when(F.size("closed") > 0, closed.cast(said)).when(said_last, cut_off.cast(said)))
    fallback = F.array(F.struct(F.lit(0).alias("speaker"), plain_text(F.col("raw")).alias("text"))).cast(said)
    out = out.withColumn("found", F.coalesce("found", fallback)).withColumn("order", F.array_distinct(F.transform("found", lambda x: x["speaker"])))
    each = out.select(*keys, "found", F.posexplode("order").alias("ordinal", "speaker"))
    own = F.filter("found", lambda x: (x["speaker"] == F.col("speaker")) & (x["text"] != ""))
    return each.select(*keys, "ordinal", "speaker", F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text")).withColumn("text", cut_loop(F.col("text")))


def answer_text(raw: Column) -> Column:
    """The transcript of a server's answer: a string, its text or transcript, or its results in their order."""
    answer = F.from_json(raw, ANSWER)
    ordered = F.array_sort(F.transform(answer["result"], lambda x, k: F.struct(F.coalesce(x["result_index"], F.lit(0.0)).alias("at"), k.alias("k"), strip(F.coalesce(F.nullif(x["transcript_formatted"], F.lit("")), x["transcript"], F.lit(""))).alias("text"))))
    parts = F.filter(F.transform(ordered, lambda x: x["text"]), lambda t: t != "")
    direct = F.coalesce(F.nullif(answer["text"], F.lit("")), F.nullif(answer["transcript"], F.lit("")))
    string = F.when(raw.rlike('^\\s*"'), F.get_json_object(F.concat(F.lit('{"s":'), raw, F.lit("}")), "$.s"))
    return F.coalesce(string, direct, F.array_join(parts, " "), F.lit(""))


def best_candidates(candidates: DataFrame, references: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each of ``keys`` the candidate (text, speaker, ordinal) with the least WER over its references.

    ``candidates`` has keys, ordinal, speaker, text; ``references`` has keys, ref_name, reference. The first
    of equals wins. Without references with text it is ('', 0).
    """
    pairs = candidates.join(references.where(F.coalesce("reference", F.lit("")) != ""), [*keys])
    scored = with_error_rates(spread(pairs, *keys, "ordinal"), "text", "reference", rates=("wer",)).where("wer is not null")
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("text", "speaker", "wer"), F.struct("wer", "ordinal")).alias("best"))
    all_ = candidates.select(*keys).distinct().join(best, [*keys], "left")
    return all_.select(*keys, F.coalesce("best.text", F.lit("")).alias("text"), F.coalesce("best.speaker", F.lit(0)).alias("speaker"), F.col("best.wer").alias("wer"))


def speaker_choice(answers: DataFrame, samples: DataFrame) -> DataFrame:
    """(model, dataset, idx, hypothesis, raw_hypothesis, selected_speaker, all_speakers): of each answer the speaker who fits a reference best.

    ``answers`` has model, dataset, idx and raw, ``samples`` has dataset, idx and references. A speaker's score
    is the least word error rate over the references with text; the first of equals wins. ``all_speakers`` has
    for each speaker, by number, the text and the rates against every reference: map<string, struct<text,
    rates: map<string, struct<wer, cer>>>>. An answer none of whose speakers has a rate has an empty
    hypothesis and speaker 0, but its speakers' texts are kept. Answers to no sample are left out.
    """
    keys = ("model", "dataset", "idx")
    said = speaker_texts(answers.select(*keys, "raw"), "raw", keys).select(*keys, "ordinal", F.coalesce("speaker", F.lit(0)).alias("speaker"), "text")
    references = samples.select("dataset", "idx", F.explode(F.map_filter("references", lambda _, t: F.coalesce(t, F.lit("")) != "")).alias("ref_name", "reference"))
    pairs = spread(said.join(references, ["dataset", "idx"]), *keys, "ordinal")
    scored = with_error_rates(pairs, "text", "reference")
    rates = F.sort_array(F.collect_list(F.struct("ref_name", F.struct("wer", "cer").alias("rates"))))
    each = scored.groupBy(*keys, "ordinal").agg(rates.alias("rates"), F.min("wer").alias("score"))
    all_ = said.join(samples.select("dataset", "idx"), ["dataset", "idx"], "left_semi").join(each, [*keys, "ordinal"], "left")
    none = F.array().cast("array<struct<ref_name:string,rates:struct<wer:double,cer:double>>>")
    entry = F.struct("ordinal", F.col("speaker").cast("string").alias("speaker"), "text", F.coalesce("rates", none).alias("rates"))
    place = F.when(F.col("score").isNotNull(), F.struct("score", "ordinal"))
    chosen = all_.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.min_by(F.struct("text", "speaker"), place).alias("best"))
    own = F.map_from_entries(F.transform("entries", lambda x: F.struct(x["speaker"], F.struct(x["text"].alias("text"), F.map_from_entries(x["rates"]).alias("rates")))))
    out = chosen.join(answers.select(*keys, F.col("raw").alias("raw_hypothesis")), [*keys])
    return out.select(*keys, F.coalesce("best.text", F.lit("")).alias("hypothesis"), "raw_hypothesis", F.coalesce("best.speaker", F.lit(0)).alias("selected_speaker"), own.alias("all_speakers"))


@F.pandas_udf(StringType())
def override_extra(selected: pd.Series, all_speakers: pd.Series) -> pd.Series:
    """What a sample of a result file keeps of its speakers, as JSON: the one chosen, and for each the text and every reference's rates."""

    def entry(said: dict) -> dict:
        return {"text": said["text"]} | {f"{ref}_{kind}": rates[kind] for ref, rates in dict(said["rates"]).items() for kind in ("wer", "cer")}

    return pd.Series([json.dumps({"selected_speaker": None if pd.isna(s) else int(s), "all_speakers": {k: entry(v) for k, v in dict(own).items()}}, ensure_ascii=False) for s, own in zip(selected, all_speakers, strict=True)])
