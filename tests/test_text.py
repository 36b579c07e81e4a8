import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.functions import distance, text


def applied(spark, function, values):
    rows = spark.createDataFrame([*enumerate(values)], "k int, v string").select("k", function(F.col("v")).alias("out"))
    return [r["out"] for r in sorted(rows.collect(), key=lambda r: r["k"])]


@pytest.mark.parametrize(
    ("function", "pairs"),
    [
        (text.normalize, [(None, ""), ("", ""), ("Hallo,  Welt!", "hallo welt"), ("E-Mail", "email"), ("a - b", "a b"), ("„Ja“", "„ja“"), ("???", ""), ("a b\u001cc", "a b c")]),
        (text.clean_orthographic_token, [("a<>b", "a<>b"), ("<>", ""), ("ja::>>", "ja"), ("a<b<c>d>e", "a d>e"), ("``Ja''", "Ja"), ('``a', "ä"), ("<", "<"), ("x<P>y", "x y"), (" # ", ""), ('sch"on', "schön"), ('gro"s', "groß"), ("<P>", ""), ("#", ""), ("a_b", "a b"), ("*Haus=t", "Haust"), ("ja:>", "ja"), (None, "")]),
        (text.clean_dialect_token, [("a<>b", "ab"), ("ja::>>", "ja:>"), ("a<b<c>d>e", "ad>e"), ("<~~ah>", "ah"), ("<z><so>", "so"), ("<;x><:y>", ""), ("12<!2 zwölf><!>", "zwölf"), ("+/+", ""), ("-/ab/-", ""), ("ge\\'h", "ge'h"), ("<!1 a#b>das", "das"), ("..<ja>", "ja"), ("a+/b", "ab"), ("das", "das"), ("das<!1 des>", "des"), ("x<!1 y><!2 z>", "z"), ("+/h/+", ""), ('<"ah>', "äh"), ("<A>", "<A>"[0:0]), ("<#Klopfen>", ""), ("zwei_drei", "zweidrei"), ("ge/gangen", "gegangen"), ("", "")]),
        (text.clean_transliteration, [("ich +/wir/+ gehe .", "ich wir gehe."), ("-/aber/- und", "aber und"), ("<!1 hab> so", "hab so"), ("<P> ja", "ja")]),
        (text.clean_phonemic, [('h"aUs#t', "haUs t"), ("+/Qa/+", "?a"), ("a/b", "a b")]),
        (text.clean_attribute, [("-", None), ("", None), (' M"unchen ', "München"), ('Bad  T"olz', "Bad Tölz")]),
        (text.model_tag, [("a/b\\c", "a_b_c")]),
        (text.hypothesis_tag, [("a/b c (x)", "a_b_c_x")]),
        (lambda c: text.loaded_model(c)["name"], [("m-online", "m"), ("m-NoRepeat", "m"), ("m-norepeat-online", "m-norepeat"), ("m", "m")]),
    ],
)
def test_vectors(spark, function, pairs):
    assert applied(spark, function, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_cut_loop(spark):
    distinct = [f"w{k}" for k in range(60)]
    loop = ["ja", "ja", "nein"]
    short = " ".join(["x"] * 99)
    values = [" ".join(distinct + loop * 20), " ".join(loop * 40), short, "", " ".join(f"v{k}" for k in range(150))]
    assert applied(spark, text.cut_loop, values) == [" ".join(distinct), "ja ja", short, "", values[4]]


def rates(spark, pairs, split=False):
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, hypothesis string, reference string")
    return [r.asDict() for r in sorted(distance.with_error_rates(rows, split=split).collect(), key=lambda r: r["k"])]


def test_error_rates(spark):
    out = rates(spark, [("a x c", "a b c d"), ("", "a b"), ("a b c", "a"), ("A, B!", "a b"), ("x", "???"), (None, None)])
    assert [(r["word_edits"], r["word_n"], r["wer"]) for r in out] == [(2, 4, 0.5), (2, 2, 1.0), (2, 1, 2.0), (0, 2, 0.0), (0, 0, None), (0, 0, 1.0)]
    assert [(r["char_edits"], r["char_n"]) for r in out[:4]] == [(3, 7), (3, 3), (4, 1), (0, 3)]
    assert [r["empty_reference"] for r in out] == [False] * 4 + [True] * 2


def words_distance(h, r):
    row = [*range(len(r) + 1)]
    for k, a in enumerate(h, 1):
        new = [k]
        for j, b in enumerate(r, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


WORDS = st.lists(st.sampled_from("a b c dd ee".split()), max_size=9)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_split_laws(h, r):
    edits, subs, dels, ins = distance.split_counts(h, r)
    assert edits == words_distance(h, r) == subs + dels + ins
    assert dels - ins == len(r) - len(h) and min(subs, dels, ins) >= 0


def test_symbolised_distance_agrees(spark):
    import random

    random.seed(5)
    pairs = [(" ".join(random.choices("a bb ccc ö".split(), k=random.randrange(9))), " ".join(random.choices("a bb ccc ö".split(), k=random.randrange(1, 9)))) for _ in range(60)]
    plain, split = rates(spark, pairs), rates(spark, pairs, split=True)
    want = [words_distance(h.split(), r.split()) for h, r in pairs]
    assert [r["word_edits"] for r in plain] == [r["word_edits"] for r in split] == want


def test_normalize_twice(spark):
    values = ["Ä b-C  d!", " x\ty ", "İstanbul"]
    once = applied(spark, text.normalize, values)
    assert applied(spark, text.normalize, once) == once


def test_filter_on_a_rate_evaluates_it_once(spark):
    pairs = spark.createDataFrame([("a b c " * 40, "a x c " * 40, 1)] * 3, "hypothesis string, reference string, k int")
    rated = distance.with_error_rates(pairs, rates=("wer",))
    for condition in ("wer is not null", "wer > 0.2", "word_edits > 3"):
        kept = rated.where(condition).select("k", "wer", "word_edits")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("levenshtein(") == 1, plan
        assert [tuple(r) for r in kept.collect()] == [(1, 40 / 120, 40)] * 3
    assert "k#" in rated.where("k = 1")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1].split("Filter")[-1]


def test_loops_at_the_end_of_long_texts(spark):
    """A tail is read from the end, or from all of the text where its words are long; each text is taken apart once."""
    import time

    def want(t):
        w = t.split()
        if len(w) < 100:
            return t
        for n in (3, 4, 5):
            e, f = " ".join(w[-n:]), " ".join(w)
            if len(e) >= 5 and " ".join(w[-60:]).count(e) >= 5 and (before := f[: f.index(e)].strip()):
                return before
        return t

    head = " ".join(f"w{k}" for k in range(90))
    loops = [head + sep + sep.join(["a b c"] * 20) for sep in (" ", "\n", " \t ")] + [head + " " + "　".join(["x" * 40 + " y z u"] * 15) + "  "]
    plain = [head, head + " one", head + " b c a" * 9, "a b c " * 40, " ".join(["z" * 50] * 99), ("z" * 50 + " ") * 61, head.replace(" ", " \n") + " aa bb cc dd ee" * 12]
    frame = spark.createDataFrame([(t,) for t in loops + plain + [None]], "t string")
    got = [r[0] for r in frame.select(text.cut_loop(F.col("t"))).collect()]
    assert got == [want(t) for t in loops + plain] + [None] and all(g.split()[-1] in head for g in got[:3])
    long = spark.range(0, 400, 1, 4).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda k: F.concat(F.lit("w"), k + F.col("id"))), " ").alias("t")).cache()
    assert long.count() == 400
    began = time.monotonic()
    assert long.where(text.cut_loop(F.col("t")) != F.col("t")).count() == 0
    assert time.monotonic() - began < 4
