"""Quality scores, the divergence of sources and ranked search, each with brute force or a law beside it."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scorewright.llm import divergence, lexical, quality
from scorewright.llm.common import read

SMALL = "/root/testdata/sf0.01"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WITH_DIGITS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# quality


def test_shapes():
    assert [quality.shape(w) for w in ("Hello", "ABC!!", "x9-10", "$$$", "Été", "")] == ["Aa", "A!", "a9-9", "$", "Aa", ""]


def test_ngrams_are_present_or_absent():
    words = quality.Words()
    once, twice = quality.ngrams("one two. three", words), quality.ngrams("one two. three " * 2, words)
    assert set(once.tolist()) < set(twice.tolist()) and len(quality.ngrams("", words)) == 0
    assert len(quality.ngrams("no no", words)) == 4  # the word, its shape, that shape again, and the run of both
    assert len(quality.ngrams(" ".join(["w" * 70 + str(k) for k in range(9)]), words)) and not any(len(w) > 64 for w in words)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    ratios = rng.normal(size=30)
    rows = [np.flatnonzero(rng.random(30) < 0.3).astype(np.uint16) for _ in range(120)]
    good = np.array([ratios[r].sum() + rng.normal() > 0 for r in rows])
    weight = np.where(good, 1.0, 0.5)
    x = np.zeros((120, 31))
    for k, r in enumerate(rows):
        x[k, r] = quality.scaled(r, ratios)
    x[:, 30] = 1

    def risk(w):
        return w @ w / 2 + (quality.BOUND * weight * np.maximum(0, 1 - np.where(good, 1, -1) * (x @ w))).sum()

    got, best = quality.fit(rows, good, weight, ratios), np.zeros(31)
    lowest = math.inf
    for step in range(1, 30_001):  # a subgradient method as the other way to the same optimum
        push = np.where(good, 1, -1) * (quality.BOUND * weight * (np.where(good, 1, -1) * (x @ best) < 1))
        best = best - (best - push @ x) / (step + 10)
        lowest = min(lowest, risk(best))
    assert risk(got) <= lowest * 1.02


def test_curve_and_small_samples():
    margins, good = np.array([-2.0, -1, 0.1, 1, 2, 3]), np.array([False, False, False, True, True, True])
    slope, offset = quality.curve(margins, good, np.ones(6))
    assert slope > 0 and 0.1 < -offset / slope < 1
    assert len(quality.trained([np.array([0], np.uint16)], np.array([True]), np.ones(1), np.array([1.0]))) == 2


def test_held_out_quality(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    rows = quality.held_out_scores(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    assert np.mean([r["predicted"] for r in held if r["quality"] == 0]) < 0.15


def test_quality_of_odd_rows(spark):
    schema = "doc_id long, text string, quality string, score string"
    rows = [(1, None, "x", "y"), (2, "", None, None), (2, "fine words here", None, None), (None, "fine words here", None, None), (3, "word " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, quality int")
    got = sorted(((r["doc_id"], r["score"]) for r in quality.held_out_scores(docs, labels).collect()), key=repr)
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got)
    none = quality.held_out_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    only_good = quality.held_out_scores(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in only_good)
    assert quality.held_out_scores(docs.limit(0), labels).count() == 0


# divergence


def brute_divergence(rows, least=3, ranks=200):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(s, LETTERS.findall(t.translate(LOWER))) for t, g, s in rows if g == lang]
        docs = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        sources = sorted({s for s, _ in own})
        count = {s: Counter(w for o, ws in own if o == s for w in ws if docs[w] >= least) for s in sources}
        total = sum(count.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s in sources:
            pairs = [(sum((share(count[s], w) - share(count[o], w)) ** 2 // share(count[o], w) for w in kept), o) for o in sources if o != s]
            told = [((share(count[s], w) - share(total, w)) ** 2 // share(total, w), w) for w in kept if count[s][w] and share(count[s], w) > share(total, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", told, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def divergence_rows():
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("pre", "prefix", "prefixes", "Ärger", "x", "日本", "longlonglonglonglonglong" * 3) for b in ("", "A", "b", "cc", "Ünter", "zzzz" * 5)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))) + rng.choice([".", "!9", "\x00end", " 12 "]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None, "Ä"])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), ("12 !", "fr", None), ("rare word", "xx", "one"), ("y" * 200_000, "en", "a"), ("y" * 200_000, "en", "b"), ("y" * 200_000, "en", "b")]
    return rows + rows[:20]


def test_divergence_against_brute_force(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, "term", 7) for r in rows], "text string, lang string, source string, item string, value int").repartition(5)
    got = divergence.divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows)
    few = sorted(map(tuple, divergence.divergence(docs, least=2, ranks=2).collect()))
    assert few == brute_divergence(rows, 2, 2)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_refinement_keeps_all_frequent_terms_and_few_others(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    cut = divergence.chunks(docs)
    living = divergence.refine(cut, 3)
    for lang in ("en", "de", ""):
        docs_of = Counter(w for t, g, _ in rows if (g or "") == lang for w in set(LETTERS.findall((t or "").translate(LOWER))))
        for w, n in docs_of.items():
            assert divergence.lives(living, divergence.hashes(lang, [w.encode()], None))[0] == (n >= 3)


def test_prefixes_and_whole_terms_never_meet():
    words = [b"prefix", b"prefixes"]
    assert len({*divergence.hashes("en", words, None).tolist(), *divergence.hashes("en", words, 6).tolist()}) == 3
    assert divergence.hashes("en", words, None)[0] != divergence.hashes("de", words, None)[0]


def test_shares_are_exact_beyond_eight_bytes():
    n = np.array([[0, 5, 10**10, 2**60]])
    of = np.array([7, 12, 3 * 10**10, 2**61])
    assert divergence.shares(n, of).tolist() == [[1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n[0], of, strict=True)]]


# ranked search


def brute_ranked(docs, items, k=20):
    held = [(i, Counter(WITH_DIGITS.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(w for _, c in held for w in c), []
    for item, text in items:
        asked, scores = Counter(WITH_DIGITS.findall((text or "").translate(LOWER))), []
        for doc_id, c in held:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if c[w])
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ranked_rows():
    rng = random.Random(5)
    words = ["the", "of"] * 20 + [f"w{k}" for k in range(60)] + ["Ünder", "日本", "x9"]
    docs = [(k * 7 % 401, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(400)]
    docs += [(1000 + k, docs[3][1]) for k in range(30)] + [(2000, None), (2001, ""), (2002, " .,;"), (None, docs[5][1]), (2003, "the w1 " * 30_000), (1000, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(25)] + [(50, docs[3][1]), (51, None), (52, "..."), (53, "nowhere"), (54, "The THE the")]
    return docs, items


@pytest.mark.parametrize("leaf", [0, 3, 2048])
def test_search_of_a_segment(monkeypatch, leaf):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    docs, items = ranked_rows()
    docs = [(i, t) for i, t in docs if i is not None]
    table = lexical.term_table(digits=True)
    held = {i: Counter(lexical.terms((t or "").encode(), table)) for i, t in items}
    known = {t: k for k, t in enumerate(sorted(set().union(*held.values())))}
    made = [lexical.Open(True) for _ in range(3)]
    for k, (i, t) in enumerate(docs):
        made[k % 3].add(i, lexical.terms((t or "").encode(), table), known)
    n, total = sum(x.with_terms for x in made), sum(x.all_terms for x in made)
    df = Counter(t for x in made for t in x.term)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in range(len(known))], np.int64)
    got = []
    parts = [lexical.Segment(x.row().to_pylist()[0], weights, n, total) for x in made]
    for i, c in held.items():
        found = []
        for segment in parts if c else []:
            segment.search(np.array([known[t] for t in c]), np.array([*c.values()]), found, 20)
        got += [(i, rank, -d, s) for rank, (s, d) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1])), 1)]
    assert sorted(got) == brute_ranked(docs, items)


def test_tables_answer_the_maximum():
    rng = np.random.default_rng(9)
    own = lexical.Open(True)
    for k in range(200):
        own.add(k, [b"a"] * int(rng.integers(1, 9)) + [b"b"] * int(rng.integers(0, 3)), {b"a": 0, b"b": 1})
    segment = lexical.Segment(own.row().to_pylist()[0], np.array([100, 900]), 200, 1000)
    for _ in range(300):
        t = int(rng.integers(2))
        a, b = np.sort(rng.choice(np.arange(segment.start[t], segment.start[t + 1] + 1), 2, replace=False))
        assert segment.impact[segment.best(np.array([a]), np.array([b]))[0]] == segment.impact[a:b].max()


def test_ranked_against_brute_force(spark):
    docs, items = ranked_rows()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    i = spark.createDataFrame([(*r, 5) for r in items] + [(None, "the w1", 5), (50, "zz", 5)], "item_id long, text string, rank int")
    got = lexical.ranked(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_ranked(docs, items)
    assert lexical.ranked(d.limit(0), i).count() == 0 and lexical.ranked(d, i.limit(0)).count() == 0
    assert {r["rank"] for r in lexical.ranked(d, i, k=3).collect()} == {1, 2, 3}
