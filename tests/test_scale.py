"""What must hold for tables and texts of any size: distances of long texts, ranks and groups over ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scorewright.functions import distance
from scorewright.operators import grouping
from scorewright.operators.order import numbered
from scorewright.operators.tables import written


def table_of(a, b):
    row = [*range(len(b) + 1)]
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n, letters):
    out = [*text]
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 and out:
            out[k % len(out)] = rng.choice(letters)
        elif kind == 1:
            out.insert(k, rng.choice(letters))
        elif out:
            del out[k % len(out)]
    return "".join(out)


def test_long_distance_in_narrow_bands(monkeypatch):
    monkeypatch.setattr(distance, "NARROWEST", 3)
    rng = random.Random(1)
    for _ in range(1500):
        letters = "ab" if rng.random() < 0.5 else "abcdeäß日"
        a = "".join(rng.choices(letters, k=rng.randrange(40)))
        b = changed(rng, a, rng.randrange(12), letters) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.randrange(60)))
        assert distance.long_distance(a, b) == table_of(a, b), (a, b)


def test_near_long_texts_take_less_than_a_second():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdefghij ", k=100_000))
    b = changed(rng, a, 60, "xyz")
    distance.long_distance(a[:5000], b[:5000])
    began = time.process_time()
    found = distance.long_distance(a, b)
    assert time.process_time() - began < 1 and 40 <= found <= 60
    assert distance.long_distance(a, a) == 0 and distance.long_distance(a, "") == 100_000


def test_distance_equals_the_built_in_one_beyond_its_cells(spark):
    rng = random.Random(3)
    pairs = []
    for n in (30, 361, 363, 900, 2000):
        a = "".join(rng.choices("abcdefg üß", k=n))
        pairs += [(a, changed(rng, a, n // 10, "abcz")), (a, "".join(rng.choices("abcdefg", k=n + 50)))]
    pairs += [("", "x" * 500), (None, "ab"), ("x" * 500, None), ("ab cd", "")]
    frame = spark.createDataFrame(pairs, "hypothesis string, reference string")
    rows = distance.with_error_rates(frame).withColumn("plain", F.levenshtein("hyp_norm", "ref_norm")).collect()
    for r in rows:
        assert r["char_edits"] == (0 if r["empty_reference"] else r["plain"])
        assert r["word_edits"] == (0 if r["empty_reference"] else table_of(r["hyp_norm"].split(), r["ref_norm"].split()))


def test_words_with_one_code(spark, monkeypatch):
    """With few symbols most pairs have two words with one code, and go by their positions instead."""
    pairs = [("a b c d e f g h", "a c b d x f g"), ("one two", "one two"), ("a", "b c d e f g h i j")]
    frame = spark.createDataFrame(pairs, "hypothesis string, reference string")
    monkeypatch.setattr(distance, "SYMBOLS", 13)
    rows = distance.with_error_rates(frame, rates=("wer",)).select("hypothesis", "reference", "word_edits").collect()
    assert [r["word_edits"] for r in rows] == [table_of(h.split(), r.split()) for h, r in pairs]
    monkeypatch.setattr(distance, "SYMBOLS", 4)
    with pytest.raises(Exception, match="more different words than symbols"):
        distance.with_error_rates(frame, rates=("wer",)).collect()


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_numbered_is_the_rank(spark, ranges):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.5, 0.5, 0.5, 1.0, rng.random()]), k, "x") for k in range(700)]
    frame = spark.createDataFrame(rows, "wer double, idx long, at string")
    got = numbered(frame, F.desc_nulls_last("wer"), F.asc("idx"), ranges=ranges)
    assert got.columns == ["wer", "idx", "at", "place"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [r["idx"] for r in sorted(got.collect(), key=lambda r: r["place"])] == [r[1] for r in want]
    assert sorted(r["place"] for r in got.collect()) == [*range(1, 701)]
    assert numbered(frame.limit(0), "idx", ranges=ranges).count() == 0


def brute_groups(rows, most):
    out = []
    for by in {r[0] for r in rows if None not in r}:
        pieces = set()
        for b, s, e in rows:
            if b == by and s is not None and e is not None:
                pieces |= {(x, min(x + most, e)) for x in range(s, e, most)} if e - s > most else {(s, e)}
        (start, end), *rest = sorted(pieces)
        k = 0
        for s, e in rest:
            if e - start <= most:
                end = e
            else:
                out.append((by, k, start, end))
                k, start, end = k + 1, s, e
        out.append((by, k, start, end))
    return sorted(x for x in out if x[3] > x[2])


@pytest.mark.parametrize("span,ranges,collected", [(30, 9, True), (400, 1, True), (400, 23, False), (5000, 7, True), (5000, 12, False)])
def test_greedy_groups_over_ranges(spark, monkeypatch, span, ranges, collected):
    monkeypatch.setattr(grouping, "MOST_COLLECTED", 200_000 if collected else -1)
    rng = random.Random(span)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", "c"]), s := rng.randrange(20_000), s + rng.randrange(span)) for _ in range(600)]
    rows += rows[:50] + [(None, 1, 2), ("a", None, 2), ("a", 3, None), ("empty", 5, 5), ("one", 7, 9)]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "speaker string, start long, end long, at string")
    got = grouping.greedy_groups(frame, "speaker", 1000, ranges)
    assert got.columns == ["speaker", "k", "start", "end"]
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, 1000)


def test_greedy_groups_of_nobody(spark):
    frame = spark.createDataFrame([], "speaker long, start int, end int")
    assert grouping.greedy_groups(frame, "speaker", 10).count() == 0


def test_last_starts_by_doubling():
    rng = random.Random(7)
    start = sorted(rng.randrange(500) for _ in range(200))
    import numpy as np

    s, e = np.array(start), np.array([x + rng.randrange(20) for x in start])
    successor = grouping.successors(s, e, 20)
    last = grouping.last_starts(successor)
    for k in range(200):
        assert successor[k] == next((j for j in range(k + 1, 200) if e[j] - s[k] > 20), 200)
        at = k
        while successor[at] < 200:
            at = successor[at]
        assert last[k] == at


def test_written_tables_are_read_back(spark):
    frame = written(spark.range(5).withColumn("x", F.rand()), "t")
    assert sorted(frame.collect()) == sorted(frame.collect()) and "scorewright" not in frame.schema.simpleString()


def costs_of(h, r):
    """(edits, most substitutions of so few edits) by the plain table."""
    row = [(j, 0) for j in range(len(r) + 1)]
    for i, x in enumerate(h, 1):
        new = [(i, 0)]
        for j, y in enumerate(r, 1):
            swapped = row[j - 1] if x == y else (row[j - 1][0] + 1, row[j - 1][1] - 1)
            new.append(min(swapped, (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return row[-1][0], -row[-1][1]


def test_many_pairs_are_split_together():
    import pyarrow as pa

    rng = random.Random(8)
    kind = pa.list_(pa.string())
    h = [rng.choices("a b c dd ee".split(), k=rng.randrange(25)) for _ in range(1500)] + [None, [], ["a"], None]
    r = [[w for w in x or () if rng.random() < 0.8] + rng.choices("a b f".split(), k=rng.randrange(9)) for x in h[:-2]] + [[], None]
    got = distance.split_words(pa.array(h, kind), pa.array(r, kind)).to_pylist()
    for x, y, s in zip(h, r, got, strict=True):
        x, y = x or [], y or []
        assert (s["edits"], s["subs"]) == costs_of(x, y) and s["edits"] == s["subs"] + s["dels"] + s["ins"] and s["dels"] - s["ins"] == len(y) - len(x)
    assert distance.split_words(pa.array(h, kind).slice(90, 20), pa.array(r, kind).slice(90, 20)).to_pylist() == got[90:110]
    words = [rng.choices("abcdefghij", k=150) for _ in range(4000)]
    began = time.process_time()
    distance.split_words(pa.array(words, kind), pa.array(words[1:] + words[:1], kind))
    assert time.process_time() - began < 3


def test_texts_are_normalised_before_they_meet(spark):
    """Each text is normalised and its words are hashed once, however many models or references it is held against."""
    from scorewright.operators import scoring

    rows = [("d", k, {"ort": f"The cat {k} sat.", "dialect": f"de Katz {k}"}) for k in range(20)]
    samples = spark.createDataFrame(rows, "dataset string, idx long, references map<string,string>")
    hypotheses = spark.createDataFrame([(m, "d", k, f"the cat {k}") for m in ("x", "y") for k in range(20)], "model string, dataset string, idx long, hypothesis string")
    out = scoring.sample_metrics(samples, hypotheses, rates=("wer",))
    assert out.columns == ["model", "dataset", "idx", "ref_name", "reference", "hypothesis", "hyp_norm", "ref_norm", "empty_reference", "word_edits", "word_n", "wer"]
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "regexp_replace" not in above and "regexp_replace" in below
    assert {(r["ref_name"], r["word_edits"], r["word_n"]) for r in out.collect()} == {("ort", 1, 4), ("dialect", 2, 3)}


def test_ranges_of_groups_grow_with_the_pieces(spark, monkeypatch):
    """A task holds about A_RANGE pieces, however many there are; so in both passes."""
    import pyarrow as pa

    monkeypatch.setattr(grouping, "A_RANGE", 100, raising=False)
    used, in_ranges = [], grouping.in_ranges
    monkeypatch.setattr(grouping, "in_ranges", lambda *a, ranges=None: used.append(ranges) or in_ranges(*a, ranges=ranges))
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 5 + [f"s{k}" for k in range(9)]), s := rng.randrange(-90_000, 90_000), s + rng.randrange(900)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "speaker string, start long, end long")
    assert sorted(map(tuple, grouping.greedy_groups(frame, "speaker", 1000).collect())) == brute_groups(rows, 1000)
    assert len(used) == 1 and used[0] == 15
    batches = [pa.record_batch([pa.array(p, pa.int64()), pa.array(range(len(p)))], names=["part", "at"]) for p in ([3, 3], [3, 8], [], [8], [1, 1, 2])]
    assert [(p, t["part"].to_pylist()) for p, t in grouping._parts(iter(batches))] == [(3, [3, 3, 3]), (8, [8, 8]), (1, [1, 1]), (2, [2])]
