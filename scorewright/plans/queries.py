"""One query for each operator over the standard tables; ``oracle.py`` has the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import spread, with_error_rates
from ..functions.text import clean_dialect_token, clean_orthographic_token, clean_phonemic, clean_transliteration, cut_loop, hypothesis_tag, loaded_model, model_tag, normalize, words
from ..operators import board, candidates, choice, grouping, scoring, segments, transcribe
from ..operators.order import numbered
from ..operators.tables import shared_folder, written
from ..sources import corpus, manifest, matrix, migration, render, result_stream, runs
from ..streaming import board_state
from . import views

Query = Callable[[SparkSession, str], DataFrame]


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("norm"))


def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_error_rates(spread(views.turn_pairs(spark, sf_dir), "idx"), rates=("wer",))
    return out.select("idx", "word_edits", "word_n", F.round("wer", 6).alias("wer"))


def wer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spread(views.turn_pairs(spark, sf_dir), "idx").withColumns({"model": F.lit("assistant"), "dataset": F.lit("turns"), "ref_name": F.lit("user")})
    out = scoring.reference_metrics(with_error_rates(pairs, rates=("wer",)))
    return out.select("model", "dataset", "ref_name", "word_edits", "word_n", F.round("wer", 6).alias("wer"), "num_samples")


def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_error_rates(spread(views.turn_pairs(spark, sf_dir), "idx"), rates=("cer",))
    return out.select("idx", "char_edits", "char_n", F.round("cer", 6).alias("cer"))


def wer_by_model_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.reference_metrics(scoring.sample_metrics(views.samples(spark, sf_dir), views.hypotheses(spark, sf_dir), rates=("wer",)))
    return out.select("model", "dataset", "ref_name", "word_edits", "word_n", F.round("wer", 6).alias("wer"), "num_samples")


def edit_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split's totals, and how many samples break one of its two laws."""
    rows = scoring.sample_metrics(views.samples(spark, sf_dir), views.hypotheses(spark, sf_dir), split=True, rates=("wer",))
    broken = (F.col("subs") + F.col("dels") + F.col("ins") != F.col("word_edits")) | (F.col("dels") - F.col("ins") != F.col("word_n") - F.size(words(F.col("hyp_norm"))))
    out = rows.groupBy("model", "ref_name").agg(F.sum("word_edits").alias("edits"), (F.sum("dels") - F.sum("ins")).alias("dels_less_ins"), F.count_if(broken).alias("broken"))
    return out


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user turn the assistant turn of its conversation that is nearest to it."""
    turns = views.table(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", "turn", F.lit("ort").alias("ref_name"), F.col("text").alias("reference"))
    answers = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("ordinal"), F.col("turn").cast("int").alias("speaker"), "text")
    each = said.select("conv_id", "turn").join(answers, "conv_id")
    out = candidates.best_candidates(each, said, ("conv_id", "turn"))
    return out.select("conv_id", "turn", F.col("speaker").cast("long").alias("speaker"), F.round("wer", 6).alias("wer"))


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    named = board.named(views.runs(spark, sf_dir))
    return named, board.latest(named)


def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = board.leaderboard(views.runs(spark, sf_dir))
    return out.select("rank", "model", *(F.round(c, 6).alias(c) for c in ("average_wer", "average_cer", "rtfx")))


def exclude_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = board.leaderboard(views.runs(spark, sf_dir), exclude_failed=True, threshold=0.1565)
    return out.select("rank", "model", F.round("average_wer", 6).alias("average_wer"))


def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = board.pivoted(board.cells(*_kept(spark, sf_dir)), [("A", "F"), ("N", "F"), ("N", "O"), ("R", "F")])
    return out.select(F.col("name").alias("model"), *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("::", "_").lower()) for c in out.columns[1:]))


def board_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.columns(*_kept(spark, sf_dir))


def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = board.column_bounds(board.cells(*_kept(spark, sf_dir)), ("dataset", "ref_name"), "wer")
    return out.select("dataset", "ref_name", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


def cell_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = board.cells(*_kept(spark, sf_dir))
    both = cells.join(board.column_bounds(cells, ("dataset", "ref_name"), "wer"), ["dataset", "ref_name"])
    both = both.withColumn("rgb", board.colour(F.col("wer"), F.col("vmin"), F.col("vmax")))
    return both.select("name", "dataset", "ref_name", "rgb.r", "rgb.g", "rgb.b", board.text_colour(F.col("rgb")).alias("ink"))


def best_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = board.cells(*_kept(spark, sf_dir))
    return cells.select("name", "dataset", "ref_name", board.is_best(F.col("wer"), "dataset", "ref_name").cast("int").alias("best"))


def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.dataset_meta(*_kept(spark, sf_dir)).withColumn("references", F.array_join("references", ","))


def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    out = choice.last_wins(orders, ("o_custkey",), ("o_orderdate", "o_orderkey"))
    return out.select("o_custkey", "o_orderkey", "o_orderpriority", F.col("first_at.o_orderkey").alias("first_orderkey"))


def first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the first event type but clicks, which count as saying nothing, and the first value."""
    events = views.table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    kind = F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    return events.groupBy("user_id").agg(choice.first_said(kind, order).alias("event_type"), F.round(choice.first_said(F.col("value"), order), 6).alias("value"), F.count("*").alias("n"))


def sample_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart rows of runs that stand for event types, an event a sample."""
    rated = F.struct(F.col("value").alias("wer"), F.lit(None).cast("double").alias("cer"))
    samples = F.collect_list(F.struct(F.col("event_id").alias("index"), F.create_map(F.lit("ort"), rated).alias("metrics")))
    each = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.create_map(F.lit("ort"), F.struct(F.avg("value").alias("wer"))).alias("results"), samples.alias("per_sample"))
    return board.chart_rows(each.withColumnRenamed("event_type", "name")).select(F.col("name").alias("event_type"), F.round("ort", 6).alias("ort"), F.round("std", 6).alias("std"))


def worst_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in the order of their rates, the worst first."""
    pairs = with_error_rates(spread(views.turn_pairs(spark, sf_dir), "idx"), rates=("wer",)).select("idx", F.col("hypothesis"), "reference", "wer")
    kept = written(board.matching(pairs, " EN").select("idx", "wer"), "utterances")
    return numbered(kept, *board.utterance_order("worst")).select("idx", F.col("place").cast("int").alias("place"))


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines by their quantity, the greatest first, ties by order and line: a rank over a whole large table with few different keys."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return numbered(lines, F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), name="rank")


def speaker_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    known = labels.select(F.col("doc_id").cast("string").alias("speaker"), F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")), lambda _, v: v.isNotNull()).alias("attributes"))
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("speaker_id"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    out = corpus.with_speakers(rows, known)
    return out.select("doc_id", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("lang", "speaker_quality", "speaker_toxic")))


def wav_nis_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    return corpus.with_fallback(labels.select("doc_id", F.lit("wav").alias("kind")), docs.select("doc_id", F.lit("nis").alias("kind")), "doc_id")


def dense_index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents 10 to 59 of each language: an offset and a limit over a dense index."""
    docs = views.table(spark, sf_dir, "documents").select("lang", "doc_id")
    return manifest.indexed(docs, "doc_id", by=("lang",), pieces=(F.floor(F.col("doc_id") / manifest.PIECE),), offset=10, limit=50)


def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    models = nations.select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4).alias("batch_size"), F.when(F.col("n_regionkey") == 1, "eng_Latn").otherwise("").alias("language"), F.array().cast("array<string>").alias("extra_args"))
    datasets = regions.select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("data_dir"), F.create_map().cast("map<string,string>").alias("params"))
    out = matrix.jobs(models, datasets, {"batch_size": 8, "data_dir": "/data"})
    return out.select("model_ordinal", "dataset_ordinal", "model", "dataset", "batch_size", "language", "split", "data_dir", "backend")


def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back ends for names that are made of the parts' numbers and the words that routing looks for."""
    names = F.array(*(F.lit(n) for n in ("openai/whisper-large", "nyra/CrisperWhisper", "nv/parakeet", "x/canary-1b-v2", "x/canary-qwen", "Voxtral-Realtime-online", "Voxtral-Realtime", "voxtral-mini", "phi4", "granite-nar", "granite", "gemma", "stt_de_conformer", "cohere-transcribe", "https://asr", "omniASR_CTC")))
    parts = views.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", F.get(names, (F.col("p_partkey") % 16).cast("int")), F.col("p_partkey").cast("string")).alias("model"))
    return parts.select("p_partkey", model_tag(F.col("model")).alias("tag"), matrix.route(F.col("model")).alias("backend"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with blanks, brackets and suffixes: as part of a file's name, and what they load."""
    endings = F.array(*map(F.lit, ("", "-online", "-norepeat", " (server)", "-NoRepeat", "/x-online-norepeat")))
    parts = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("o/m "), F.col("p_partkey").cast("string"), F.get(endings, (F.col("p_partkey") % 6).cast("int"))).alias("model"))
    return parts.select("p_partkey", hypothesis_tag(F.col("model")).alias("tag"), loaded_model(F.col("model")).alias("l")).select("p_partkey", "tag", "l.name", "l.online", "l.no_repeat")


def table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's models by their speed, unknown speeds first as in a table that is sorted downwards."""
    out = board.leaderboard(views.runs(spark, sf_dir)).withColumn("rtfx", F.when(F.col("rank") % 4 != 0, F.col("rtfx")))
    return numbered(written(out, "board"), *board.table_order("rtfx", descending=True)).select(F.col("place").cast("int").alias("place"), "model")


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(segments.fixed_pieces(F.col("n_chars"), 300, 20, 350)).alias("k", "p")).select("doc_id", "k", "p.start", "p.end")


def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(segments.feed_pieces(F.col("n_chars"), 5, 20, 40, 200, 6)).alias("k", "p")).select("doc_id", "k", "p.start", "p.end")


def greedy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as speech of a second per unit of value, put together to pieces of at most a day."""
    start = F.unix_timestamp("ts")
    events = views.table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.floor(F.abs("value")) + 1).alias("end"))
    return grouping.greedy_groups(events, "user_id", 86_400)


def greedy_groups_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a status as one speaker's segments of up to 90 days, cut at 60 and put together to pieces of at most that: three speakers over all ranges."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("speaker"), (day * 86_400 + F.col("o_orderkey") % 86_400).alias("start"))
    return grouping.greedy_groups(orders.withColumn("end", F.col("start") + 1 + (F.col("start") * 37) % (90 * 86_400)), "speaker", 60 * 86_400)


def loop_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", F.length(cut_loop(F.col("text"))).alias("n"))


def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a diarised answer, cut off every third time, and read back."""
    turns = views.table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", 0).otherwise(1)
    answer = F.concat(F.lit("assistant "), F.to_json(F.array(F.struct(F.lit(0.0).alias("Start"), F.lit(1.0).alias("End"), speaker.alias("Speaker"), F.regexp_replace("text", r'["\\\n]', " ").alias("Content")))))
    cut = F.when(F.col("turn") % 3 == 2, F.regexp_replace(answer, r'"\}\]$', "")).otherwise(answer)
    read = candidates.speaker_texts(turns.select("conv_id", "turn", cut.alias("raw")), "raw", ("conv_id", "turn"))
    return read.select("conv_id", "turn", "speaker", F.length("text").alias("n"))


def answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a server's answer in three shapes, read back."""
    turns = views.table(spark, sf_dir, "conversations")
    plain = F.regexp_replace("text", r'["\\\n]', " ")
    listed = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("result_index"), F.lit(None).cast("string").alias("transcript_formatted"), F.lit("end").alias("transcript")), F.struct(F.lit(0).alias("result_index"), plain.alias("transcript_formatted"), F.lit("other").alias("transcript"))).alias("result")))
    shapes = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"'), plain, F.lit('"'))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(plain.alias("text")))).otherwise(listed)
    return turns.select("conv_id", "turn", candidates.answer_text(shapes).alias("text"))


def rtfx(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    batches = events.select(F.col("event_type").alias("model"), F.lit("d").alias("dataset"), F.abs("value").alias("audio_s"), (F.col("user_id") % 7).cast("double").alias("infer_s"))
    return scoring.speed(batches).select("model", *(F.round(c, 6).alias(c) for c in ("total_audio_s", "total_infer_s", "rtfx")))


def transcribe_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = manifest.indexed(views.table(spark, sf_dir, "conversations").select(F.col("role").alias("dataset"), "conv_id", "turn", "text"), "conv_id", "turn", pieces=(F.floor(F.col("conv_id") / manifest.PIECE),))
    rows = samples.select("dataset", "idx", F.col("text").alias("audio_path"), F.lit(1.0).alias("duration"))
    out = transcribe.transcribe(rows, "doubled", lambda: transcribe.Echo(lambda path: path.replace("a", "bb")), batch_size=16)
    return out.select("model", "dataset", "idx", "batch", F.length("hypothesis").alias("n"))


def marker_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with transcription marks put in, and cleaned by each tier's rules, as lengths and a digest."""
    docs = views.table(spark, sf_dir, "documents")
    marked = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(' <P> +/the/+ "a ')), F.lit(". "), F.lit(" . <!1 hab> "))
    return docs.select("doc_id", F.md5(clean_transliteration(marked).cast("binary")).alias("transliteration"), F.md5(clean_phonemic(marked).cast("binary")).alias("phonemic"))


def token_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all turns with marks put in by their length, and cleaned as orthographic and dialect words."""
    turns = views.table(spark, sf_dir, "conversations")
    w = F.col("w")
    marked = F.when(F.length("w") % 5 == 0, F.concat(w, F.lit("<!1 "), F.reverse("w"), F.lit(">"))).when(F.length("w") % 5 == 1, F.concat(F.lit("*"), w, F.lit("=_#"))).when(F.length("w") % 5 == 2, F.concat(F.lit('<"a'), w, F.lit(">"))).when(F.length("w") % 5 == 3, F.concat(w, F.lit("/x:>"))).otherwise(F.concat(F.lit("+/"), w, F.lit("/+")))
    each = turns.select("conv_id", "turn", F.posexplode(words(F.regexp_replace("text", r"[\s<>\"'`~$%#*=_/\\:;!-]+", " "))).alias("k", "w")).withColumn("marked", marked)
    return each.select("conv_id", "turn", "k", clean_orthographic_token(F.col("marked")).alias("ort"), clean_dialect_token(F.col("marked")).alias("dialect"))


def drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation's run beside its ground truth: conversations are datasets, a run for each role."""
    return board.drill_down(_turn_runs(spark, sf_dir)).select("name", "dataset", "idx", F.length("hypothesis").alias("hyp_n"), "ref_name", F.length("reference").alias("ref_n"), "wer")


def _turn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by conversation and role: a turn a sample, the user's as its first three and the assistant's as its first five letters' reference."""
    first = F.when(F.col("role") == "user", F.substring("text", 1, 3 + F.col("turn") % 2)).otherwise(F.substring("text", 1, 5))
    references = F.create_map(F.lit("ort"), F.when(F.col("turn") % 7 == 0, F.lit("")).otherwise(first))
    metrics = F.create_map(F.lit("ort"), F.struct((F.length("text") / 7000).alias("wer"), F.lit(None).cast("double").alias("cer")))
    sample = F.struct(F.floor(F.col("turn") / 2).alias("index"), F.lit("s").alias("speaker_id"), F.lit(1.25).alias("duration"), references.alias("references"), F.col("text").alias("hypothesis"), metrics.alias("metrics"))
    return views.table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.collect_list(sample).alias("per_sample")).select(F.col("role").alias("name"), F.col("conv_id").cast("string").alias("dataset"), F.col("role").alias("position"), "per_sample")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = board.ground_truth(_turn_runs(spark, sf_dir))
    return out.select("dataset", "idx", "speaker", "duration", "ref_name", "reference")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of runs that stand for orders, the last for each customer and priority, with its first place and the customer's."""
    orders = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("file"), F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("dataset"))
    return board.latest(orders).select("name", "dataset", "file", "position", "ordinal")


def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("b"), F.col("text"), F.lit("a"), F.col("text"))).otherwise(F.create_map(F.lit("c"), F.col("text")))
    rows = views.table(spark, sf_dir, "conversations").select(F.col("role").alias("dataset"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), names.alias("references"))
    out = scoring.reference_order(rows)
    return out.select("dataset", "ref_name", F.col("ordinal.idx").alias("idx"), F.col("ordinal.pos").alias("pos"))


def run_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.samples(spark, sf_dir).withColumn("primary_reference", F.when(F.col("idx") % 3 == 0, "kan").otherwise(F.when(F.col("idx") % 3 == 1, "dialect").otherwise("ort")))
    return scoring.run_primary(rows, ("ort", "dialect"))


def speaker_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two turns of a conversation as a diarised answer, held against the next two: all speakers' rates, and who is chosen."""
    turns = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("t"))

    def said(k: int) -> Column:
        return F.regexp_replace(F.coalesce(F.try_element_at("t", F.lit(k).cast("long")), F.lit("")), r'["\\\n]', " ")

    raw = F.to_json(F.array(*(F.struct(F.lit(k).alias("Speaker"), said(k).alias("Content")) for k in (0, 1))))
    keys = [F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.col("conv_id").alias("idx")]
    samples = turns.select(*keys[1:], F.create_map(F.lit("a"), said(2), F.lit("b"), said(3)).alias("references"))
    out = candidates.speaker_choice(turns.select(*keys, raw.alias("raw")), samples)
    each = out.select(F.col("idx").alias("conv_id"), "selected_speaker", F.explode("all_speakers").alias("speaker", "said"))
    each = each.select("conv_id", "selected_speaker", "speaker", F.explode("said.rates").alias("ref_name", "r"))
    return each.select("conv_id", F.col("selected_speaker").cast("long").alias("selected_speaker"), F.col("speaker").cast("long").alias("speaker"), "ref_name", F.round("r.wer", 6).alias("wer"))


def override_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of the chosen speakers by the engine that scores every run."""
    turns = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = [F.regexp_replace(F.coalesce(F.try_element_at("t", F.lit(k).cast("long")), F.lit("")), r'["\\\n]', " ") for k in range(3)]
    raw = F.to_json(F.array(*(F.struct(F.lit(k).alias("Speaker"), said[k].alias("Content")) for k in (0, 1))))
    samples = turns.select(F.lit("d").alias("dataset"), F.col("conv_id").alias("idx"), F.create_map(F.lit("a"), said[2]).alias("references"))
    chosen = candidates.speaker_choice(turns.select(F.lit("m").alias("model"), F.lit("d").alias("dataset"), F.col("conv_id").alias("idx"), raw.alias("raw")), samples)
    out = scoring.reference_metrics(scoring.sample_metrics(samples, chosen, rates=("wer",)))
    return out.select("model", "dataset", "ref_name", "word_edits", "word_n", "num_samples")


def result_file_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written from the turns, read as runs without their samples."""
    out = result_stream.runs_of_any_size(spark, views.result_folder(spark, sf_dir, "result-files"))
    return out.select("file", "model", "dataset", "num_samples", "samples", "primary_reference", F.round(F.col("results")["ort"]["wer"], 6).alias("wer"))


def result_file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files written from the turns, read sample by sample."""
    out = result_stream.samples_of_any_size(spark, views.result_folder(spark, sf_dir, "result-files"))
    return out.select("file", F.col("sample.index").alias("idx"), F.length("sample.hypothesis").alias("hyp_n"), F.length(F.col("sample.references")["ort"]).alias("ref_n"), F.round(F.col("sample.metrics")["ort"]["wer"], 6).alias("wer"))


def migrated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of the older version, written from the turns, migrated in place and read again."""
    folder = views.old_result_folder(spark, sf_dir)
    counts = migration.migrate_in_place(spark, folder)
    out = runs.read_runs(spark, folder)
    return out.select("file", "model", "schema_version", "primary_reference", "num_samples", F.size("per_sample").alias("n"), F.round(F.col("results")["ort"]["wer"], 6).alias("wer"), F.lit(counts["migrated"]).alias("migrated"), F.lit(counts["failed"]).alias("failed"))


def manifest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written from the documents, with blank, broken and incomplete lines, read as samples."""
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    docs = views.table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_filepath"), F.concat(F.lit(" "), F.substring("text", 1, 50)).alias("text"), (F.col("doc_id") / 4).alias("duration")))
    kind = F.col("doc_id") % 11
    docs.select(F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("{"), line)).when(kind == 2, F.regexp_replace(line, "audio_filepath", "file")).otherwise(line).alias("value")).write.text(folder)
    out = manifest.read_manifest(spark, folder, audio_root="/root")
    return out.select("audio_path", F.col("transcript").alias("text"), F.round("duration", 6).alias("duration"), "primary_reference")


def hypothesis_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written from the turns as lines with an index, read back; references and answers without blanks at their ends."""
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    turns = views.table(spark, sf_dir, "conversations")
    own = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.substring("text", 1, 20), F.lit(" ")))
    turns.select(F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), own.alias("ref"), F.substring("text", 1, 9).alias("text"), F.concat("text", F.lit("\t")).alias("hyp"))).alias("value")).write.text(folder)
    out = manifest.read_hypotheses(spark, folder, "m", "d")
    return out.select("idx", "reference", F.length("hypothesis").alias("n"), "duration")


def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every back end's name for every language, and for codes that none knows, by the parts' numbers."""
    backends, codes = matrix.backends(), [*matrix.SPOKEN, "Xyz_Latn"]
    parts = views.table(spark, sf_dir, "part").select("p_partkey")
    rows = parts.select("p_partkey", F.get(F.array(*map(F.lit, backends)), (F.col("p_partkey") % len(backends)).cast("int")).alias("backend"), F.get(F.array(*map(F.lit, codes)), (F.floor(F.col("p_partkey") / len(backends)) % len(codes)).cast("int")).alias("code"))
    return rows.select("p_partkey", "backend", "code", matrix.language(F.col("backend"), F.col("code")).alias("language"))


def utterance_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drill-down's files: conversations are datasets, two utterances a file."""
    index = render.write_shards(_turn_runs(spark, sf_dir), f"{shared_folder(spark)}/page-{uuid.uuid4().hex}", size=2)
    return spark.createDataFrame([(x["dataset"], x["first"], x["last"], x["n"]) for x in index], "dataset string, first long, last long, n long")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the drill-down's files for each utterance, read out of their JSON."""
    rows = render.shard_rows(_turn_runs(spark, sf_dir), size=2)
    truth = F.from_json("truth", "spk string, dur double, refs map<string,string>")
    said = F.from_json("said", "map<string,struct<hyp:string,m:map<string,array<double>>>>")
    each = rows.select("dataset", "shard", "idx", truth.alias("t"), F.explode(said).alias("name", "s"))
    return each.select("dataset", "shard", "idx", "name", F.length("s.hyp").alias("hyp_n"), F.length(F.col("t.refs")["ort"]).alias("ref_n"), F.col("s.m")["ort"][0].alias("wer"))


def board_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of result files written from the turns, as the stream with state leaves it."""
    folder, own = views.result_folder(spark, sf_dir, "result-stream"), f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    board_state.follow_with_state(spark, folder, f"{own}/facts", f"{own}/board", f"{own}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{own}/board").select("rank", "model", *(F.round(c, 6).alias(c) for c in ("average_wer", "average_cer", "rtfx")))


def queries() -> dict[str, Query]:
    own = (
        normalize_text, wer_pairs, wer_corpus, cer_pairs, wer_by_model_ref, edit_split_totals, best_candidate, leaderboard_rank, exclude_failed,
        leaderboard_pivot, board_columns, column_bounds, cell_color, best_flags, dataset_meta, last_wins_dedupe, first_nonempty, sample_std, worst_utterances,
        speaker_join, wav_nis_fallback, dense_index_slice, job_matrix, model_route, fixed_chunks, sliding_chunks, greedy_groups, greedy_groups_hot, ranked_lines, loop_truncate,
        speaker_segments, answer_text, rtfx, transcribe_stub, marker_clean, token_clean, drilldown, ground_truth, latest_runs, reference_order, run_primary,
        speaker_override, override_rates, result_file_runs, result_file_samples, migrated_files, manifest_samples, hypothesis_lines, language_names, utterance_shards, utterances, board_by_state, model_names, table_order,
    )
    return {f.__name__: f for f in own}
