import pytest
from pyspark.sql import functions as F

from scorewright.operators import board, candidates, choice, scoring, segments, transcribe
from scorewright.sources import render

RUN = "file string, model string, dataset string, language string, num_samples long, primary_reference string, results map<string,struct<wer:double,cer:double>>, speed map<string,double>"


def runs(spark):
    rows = [
        ("a.json", "A", "d1", "", 3, "ort", {"ort": (0.2, None), "dialect": (0.5, None)}, {"rtfx": 10.0}),
        ("b.json", "A", "d2", "deu", 4, "ref", {"ref": (0.4, 0.1)}, {"rtfx": 0.0}),
        ("c.json", "B", "d1", "eng", 5, "ort", {"ort": (0.1, None)}, {}),
        ("d.json", "C", "d1", "", 1, "ort", {"ort": (1.0, None)}, {"rtfx": 5.0}),
        ("e.json", "A", "d1", "", 2, "ort", {"ort": (0.3, None)}, {"rtfx": 20.0}),
    ]
    return spark.createDataFrame(rows, RUN)


def test_leaderboard(spark):
    out = [(r["rank"], r["model"], r["average_wer"], r["rtfx"]) for r in board.leaderboard(runs(spark)).orderBy("rank").collect()]
    assert out == [(1, "B", 0.1, None), (2, "A", pytest.approx(0.35), 20.0), (3, "C", 1.0, 5.0)]
    assert [r["model"] for r in board.leaderboard(runs(spark), exclude_failed=True).orderBy("rank").collect()] == ["B", "A"]


def test_columns_and_meta(spark):
    named = board.named(runs(spark))
    kept = board.latest(named)
    assert [(r["dataset"], r["ref_name"]) for r in board.columns(named, kept).orderBy("ordinal").collect()] == [("d1", "ort"), ("d2", "ref")]
    meta = {r["dataset"]: (r["samples"], r["models"], r["language"]) for r in board.dataset_meta(named, kept).collect()}
    assert meta == {"d1": (5, 3, "eng"), "d2": (4, 1, "deu")}


def test_names(spark):
    rows = spark.createDataFrame([("Voxtral-Realtime", "x-online__d.json"), ("Voxtral-Realtime", "x__d.json"), ("w", "w.json")], "model string, file string")
    assert [r["name"] for r in board.named(rows).collect()] == ["Voxtral-Realtime (online)", "Voxtral-Realtime (offline)", "w"]


def test_bounds_and_colours(spark):
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 0.3), ("c", None)], "k string, v double")
    bounds = {r["k"]: (r["vmin"], r["vmax"]) for r in board.column_bounds(values, ("k",), "v").collect()}
    assert bounds["a"] == (1.0, pytest.approx(3.6)) and bounds["b"] == (0.3, pytest.approx(0.300001)) and bounds["c"] == (0.0, 1.0)
    shades = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (5.0,), (None,)], "v double").select(board.colour(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("c")).collect()
    assert [tuple(r["c"]) for r in shades] == [(0, 200, 0), (110, 200, 0), (220, 200, 0), (220, 0, 0), (220, 0, 0), (90, 90, 90)]


def test_rendered(spark):
    shown = render.Board(runs(spark))
    assert "B" in render.text(shown).splitlines()[1]
    assert "**10.0%**" in render.markdown(shown) and render.markdown(shown).count("\n") == 4
    page = render.page(shown)
    assert "</script>" in page and "rgb(" in page and render.payload({"x": "</a>"}) == '{"x": "<\\/a>"}'


def test_micro_average(spark):
    samples = spark.createDataFrame([("d", 0, {"ort": "a b c d", "x": ""}), ("d", 1, {"ort": "a b"}), ("d", 2, {"ort": "??"})], "dataset string, idx long, references map<string,string>")
    hyps = spark.createDataFrame([("m", "d", 0, "a x c"), ("m", "d", 1, "A, B!"), ("m", "d", 2, "a")], "model string, dataset string, idx long, hypothesis string")
    (row,) = scoring.reference_metrics(scoring.sample_metrics(samples, hyps, split=True)).collect()
    assert (row["word_edits"], row["word_n"], row["num_samples"]) == (2, 6, 2) and row["wer"] == pytest.approx(1 / 3)
    assert row["substitutions"] + row["deletions"] + row["insertions"] == 2


def test_references_made_up(spark):
    rows = spark.createDataFrame([({"a": "x", "b": ""}, "ref", "t", None), (None, "ref", "t", "o"), ({}, "ort", "t", "o")], "r map<string,string>, p string, t string, o string")
    out = rows.select(scoring.completed_references(F.col("r"), F.col("p"), F.col("t"), F.col("o")).alias("r")).collect()
    assert [r["r"] for r in out] == [{"a": "x"}, {"ref": "t", "ort": "o"}, {"ort": "t"}]


def test_speakers(spark):
    raws = [
        'assistant [{"Speaker":0,"Content":"hallo"},{"Speaker":1,"Content":"ja"},{"Speaker":0,"Content":"welt"}]',
        '[{"Speaker":0,"Content":"hallo"},{"Speaker":1,"Content":"ja',
        '[{"Speaker":2,"Content":"nur',
        "[00:00.00 - 00:05.00] Speaker 1: Hello world",
        "",
        None,
    ]
    rows = spark.createDataFrame([*enumerate(raws)], "k int, raw string")
    out: dict = {}
    for r in candidates.speaker_texts(rows, "raw", ("k",)).orderBy("k", "ordinal").collect():
        out.setdefault(r["k"], {})[r["speaker"]] = r["text"]
    assert out == {0: {0: "hallo welt", 1: "ja"}, 1: {0: "hallo"}, 2: {2: "nur"}, 3: {0: "Hello world"}, 4: {0: ""}, 5: {0: ""}}


def test_answers(spark):
    raws = ['"plain"', '{"text":"t"}', '{"transcript":"u"}', '{"result":[{"result_index":1,"transcript":"b"},{"result_index":0,"transcript_formatted":"A","transcript":"x"}]}', "{}", None]
    out = [r["t"] for r in spark.createDataFrame([(r,) for r in raws], "r string").select(candidates.answer_text(F.col("r")).alias("t")).collect()]
    assert out == ["plain", "t", "u", "A b", "", ""]


def test_best_candidate(spark):
    texts = spark.createDataFrame([(1, 0, 0, "x y"), (1, 1, 1, "a c"), (1, 2, 2, "a b"), (2, 0, 7, "z")], "s int, ordinal int, speaker int, text string")
    references = spark.createDataFrame([(1, "ort", "a b"), (1, "dialect", "a c"), (2, "ort", "")], "s int, ref_name string, reference string")
    out = {r["s"]: (r["text"], r["speaker"]) for r in candidates.best_candidates(texts, references, ("s",)).collect()}
    assert out == {1: ("a c", 1), 2: ("", 0)}


def pieces(spark, column):
    return [tuple(p) for p in spark.range(1).select(column.alias("p")).first()["p"]]


def test_fixed_pieces(spark):
    rate = 16_000

    def lengths(seconds):
        return [b - a for a, b in pieces(spark, segments.fixed_pieces(F.lit(seconds * rate), 30 * rate, 2 * rate, 35 * rate))]

    assert lengths(35) == [35 * rate] and lengths(61) == [480000, 496000] and lengths(62) == [480000, 480000, 32000]


def test_grouped_pieces(spark):
    speech = F.expr("array(named_struct('start', 0L, 'end', 100000L), named_struct('start', 120000L, 'end', 400000L), named_struct('start', 410000L, 'end', 500000L), named_struct('start', 600000L, 'end', 1200000L))")
    assert pieces(spark, segments.grouped_pieces(speech, F.lit(1_200_000), 448_000)) == [(0, 400000), (410000, 500000), (600000, 1048000), (1048000, 1200000)]
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    assert pieces(spark, segments.grouped_pieces(none, F.lit(1000), 448)) == [(0, 448), (448, 896), (896, 1000)]
    assert pieces(spark, segments.grouped_pieces(none, F.lit(0), 448)) == []


def test_feed_pieces(spark):
    def expected(n, first=5, hop=20, window=40, size=200, stride=6):
        out, frame = [], first
        while (start := frame * hop - window // 2) + size < n:
            out.append((start, start + size))
            frame += stride
        return out

    for n in (0, 100, 280, 281, 1000):
        assert pieces(spark, segments.feed_pieces(F.lit(n), 5, 20, 40, 200, 6)) == expected(n)


def test_transcribe_policies(spark):
    rows = spark.createDataFrame([("d", k, f"p{k}", 1.0) for k in range(10)], "dataset string, idx long, audio_path string, duration double")

    class Bad:
        def transcribe_batch(self, paths):
            if "p5" in paths:
                raise OSError("broken")
            return ["x"] if "p9" in paths else list(paths)

    out = {r["idx"]: (r["hypothesis"], r["error"]) for r in transcribe.transcribe(rows, "m", Bad, batch_size=4).collect()}
    assert out[0] == ("p0", None) and out[5][0] == "" and "broken" in out[5][1] and "1 answers for 2" in out[9][1]
    single = {r["idx"]: r["hypothesis"] for r in transcribe.transcribe(rows, "m", lambda: transcribe.OneByOne(Bad()), batch_size=4).collect()}
    assert single[4] == "p4" and single[5] == ""
    speed = scoring.speed(transcribe.batch_times(transcribe.transcribe(rows, "m", lambda: transcribe.Echo(str.upper)))).first()
    assert speed["total_audio_s"] == 10.0 and speed["rtfx"] > 0


def test_coerced():
    assert transcribe.coerced((" a ", 1)) == "a" and transcribe.coerced(None) == ""


def test_choice(spark):
    rows = spark.createDataFrame([("k", 1, "", "a"), ("k", 2, "x", None), ("k", 3, "y", "c")], "k string, o int, v string, w string")
    (last,) = choice.last_wins(rows, ("k",), ("o",)).collect()
    assert (last["v"], last["w"], last["first_at"]["o"]) == ("y", "c", 1)
    (first,) = rows.groupBy("k").agg(choice.first_said(F.col("v"), F.col("o")).alias("v"), choice.first_said(F.col("w"), F.col("o")).alias("w")).collect()
    assert (first["v"], first["w"]) == ("x", "a")


def test_run_primary_and_order(spark):
    rows = spark.createDataFrame([("d", 0, {"b": "x"}, "zz"), ("d", 1, {"a": "x", "b": "y"}, "a")], "dataset string, idx long, references map<string,string>, primary_reference string")
    assert scoring.run_primary(rows).first()["primary_reference"] == "a"
    assert [r["ref_name"] for r in scoring.reference_order(rows).orderBy("ordinal").collect()] == ["b", "a"]
