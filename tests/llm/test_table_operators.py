"""Operators that hold rows against each other, with brute force beside them, and the pipeline."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from scorewright.llm import decontaminate, near_dedup, secrets, topk, toxicity
from scorewright.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id long, label long, node long, print string"


def sets_of(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute(rows, percent):
    sets = [sets_of(t) for _, t in rows]
    above = [*range(len(rows))]

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                above[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return sorted(((d, len(sets[k]), None if d is None else least[top(k)], d is None or d == least[top(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def near_rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=150) for _ in range(3)]
    rows = []
    for k in range(150):
        own = [*base[k % 3]]
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((1000 - k, " ".join(own)))
    passage = " ".join(rng.choices(words, k=60))
    rows += [(2000 + k, passage + " " + " ".join(rng.choices(words, k=200))) for k in range(40)]
    rows += [(3000 + k, rows[k % 5][1]) for k in range(30)] + [(None, rows[0][1]), (5000, None), (5001, ""), (5002, " \n"), (5003, "too short"), (5004, "Too SHORT"), (5005, "Ü x"), (5006, "ü x"), (5007, "word " * 30_000)]
    return rows


@pytest.mark.parametrize("leaf", [1024, 16])
def test_near_duplicates(spark, monkeypatch, leaf):
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rows = near_rows()
    frame = spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], SCHEMA)
    got = near_dedup.near_duplicates(frame, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == brute(rows, 85)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, "x"), (2, "other words are in this text", 1, 2, 3, "x"), (2, "other words are in this text", 1, 2, 3, "x")], SCHEMA)
    assert near_dedup.without_copies(alone).count() == 3 and near_dedup.without_copies(alone).columns == alone.columns


def test_near_duplicates_below_many_levels(spark, monkeypatch):
    """Pairs just above the threshold in a group of half similarity, whose nodes are cut down to the last level."""
    monkeypatch.setattr(near_dedup, "LEAF", 2)
    rng, passage = random.Random(8), " ".join(f"p{k}" for k in range(100))
    rows = []
    for k in range(250):
        own = [f"o{k}x{j}" for j in range(60)]
        other = [*own]
        other[-14:] = [f"z{k}x{j}" for j in range(14)]
        rows += [(2 * k, f"{passage} {' '.join(own)}"), (2 * k + 1, f"{passage} {' '.join(other)}")]
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sum(r["component_id"] == r["doc_id"] // 2 * 2 for r in got) >= 499


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_rarely_reject_a_pair_at_the_threshold(percent):
    n, p = near_dedup.SKETCH, percent / 100 + (1 - percent / 100) / 256
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup._least(percent / 100))) < 1e-7


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200), (300, 205)]
    got = {r["v"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {200: 200, 201: 200, 300: 205, 205: 205}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(k, rng.integers(-6, 6, 8).tolist()) for k in range(300)]
    rows[5] = (5, rows[4][1])
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    queries = frame.where("vec_id % 30 = 0")
    got = sorted(tuple(r) for r in topk.top_k(frame, queries, 10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, [r for r in rows if r[0] % 30 == 0], 10)


def test_top_k_edges(spark):
    raw = [(0, [0.5, -0.25]), (1, [0.1, 0.2]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in raw], "vec_id long, embedding array<float>, score int, rank string")
    vectors = topk.integer_vectors(frame)
    got = topk.top_k(vectors, vectors.where("vec_id = 0"), 10).collect()
    want = {1: 512 * int(np.floor(1024 * np.float64(np.float32(0.1)))) - 256 * int(np.floor(1024 * np.float64(np.float32(0.2)))), 6: 0, 7: 512 * 1024}
    assert {r["vec_id"]: r["score"] for r in got} == want and sorted(r["rank"] for r in got) == [1, 2, 3]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_top_k_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 50, rng.integers(-(2**29), 2**29, 6).tolist()) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    asked = [(0, min(r[1] for r in rows if r[0] == 0)), (20, rows[20][1])]
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.where("vec_id in (0, 20)"), 7).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, asked, 7)


def toxic_rows():
    rng = random.Random(11)
    plain, bad = [f"word{k}" for k in range(300)], ["vilebad", "nastyone", "rudething"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 8 == 0
        text = rng.choices(plain, k=rng.randrange(20, 80))
        for w in rng.sample(bad, rng.randrange(1, 4)) if toxic else ():
            text.insert(rng.randrange(len(text)), w.upper() if k % 3 else w)
        rows.append((k, " ".join(text), "score"))
        if k % 2 == 0:
            labels.append((k, int(toxic), 1))
    return rows + [(None, "word1", "x"), (9000, None, "x"), (9001, "", "x")], labels + [(None, 1, 1), (1, None, 1)]


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    out = {r["doc_id"]: r for r in toxicity.held_out_scores(docs, known).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(r["predicted"], int(i % 8 == 0)) for i, r in out.items() if r["held_out"] and i < 600]
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and out[9000]["predicted"] == out[9001]["predicted"] == 0
    assert toxicity.held_out_scores(docs.limit(0), known).count() == 0
    none = toxicity.held_out_scores(docs, known.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["predicted"] for r in none)


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.3) for _ in range(200)]
    positive = toxicity.Sparse([np.union1d(r, [6]) for r in rows[:40]], 7)
    unlabelled = toxicity.Sparse(rows + [np.union1d(r, [6]) for r in rows[:25]], 7)
    weights = toxicity.fit(positive, unlabelled, 25 / 225, 1)
    assert np.isfinite(weights).all() and weights[6] == max(weights)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (None, "no id", "en", "s", 5), (10**6 + 1, "", None, None, None)], docs.schema)
    for frame in (docs.unionByName(odd), docs.limit(0)):
        kept, n = frame, frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SMALL)
            path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{n}"
            kept.write.mode("overwrite").parquet(path)
            kept = spark.read.parquet(path)
            assert kept.columns == docs.columns
            assert kept.where("doc_id >= 1000000 or doc_id is null").count() == (3 if n else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).count() == kept.count()


def test_the_pipeline_equals_its_parts_one_by_one(spark):
    """run() against the learned model's own scores, similarities of all pairs, every item against every whole text, and the tokenizer's library."""
    docs, labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = toxicity.Scorer(*model)([t or "" for _, t in rows])
    rows = [r for r, x in zip(rows, scores, strict=True) if x < 0.5]
    assert 0 < docs.count() - len(rows) < docs.count() / 2
    first = {d for d, _, _, kept in brute(rows, 80) if kept}
    assert len(first) < len(rows)
    rows = [r for r in rows if r[0] in first]
    asked = [f" {decontaminate.normalised(r['text'])} " for r in items.collect()]

    def leaks(text):
        plain = f" {decontaminate.normalised(text or '')} "
        return any(decontaminate.best_fit(item, plain, int(decontaminate.ERRORS * (len(item) - 2))) for item in asked)

    clean = [(d, t) for d, t in rows if not leaks(t)]
    assert len(clean) < len(rows)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in clean:
        out, at = "", 0
        for _, start, end in secrets.findings(t or ""):
            if end > at:
                out, at = (out + (t or "")[at:start] + "[SECRET]" if start >= at else out), end
        ids = library.encode_ordinary(out + (t or "")[at:])
        want[d] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_the_cut_weighs_classes_by_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 50)
    seen, plain = [], toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda m, t, *w: seen.append((t, *w)) or plain(m, t, *w))
    docs = spark.createDataFrame([(k, "vile words" if k % 5 == 0 else f"calm words {k}") for k in range(500)], "doc_id long, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) toxic"))
    toxic, weights = seen[0]
    assert weights[toxic].sum() == 100 and weights[~toxic].sum() == 400 and (~toxic).sum() == 50


def test_a_weight_counts_as_so_many_rows():
    margins, toxic = np.array([5.0, 4, 3, 2, 1, 0]), np.array([True, True, False, True, False, False])
    weights = np.array([1, 1, 8, 1, 8, 8])
    assert toxicity.calibrated(margins, toxic, weights) == toxicity.calibrated(np.repeat(margins, weights), np.repeat(toxic, weights), np.ones(27)) == 3.5
    assert toxicity.calibrated(margins, toxic, np.ones(6)) == 1.5


@pytest.mark.parametrize("percent", [80, 85])
def test_recall_in_large_mixed_nodes(spark, monkeypatch, percent):
    """All texts share a passage, so nodes are large and mixed down to deep levels; pairs near the threshold are planted among them."""
    monkeypatch.setattr(near_dedup, "LEAF", 24)
    rng = random.Random(percent)
    words = [f"w{k}" for k in range(5000)]
    passage, rows = rng.choices(words, k=60), []
    for k in range(450):
        own = [*passage, *rng.choices(words, k=50)]
        rows.append((k, " ".join(own)))
        other = [*own]
        for at in rng.sample(range(5, 105, 6), rng.randrange(1, 4)):
            other[at] = rng.choice(words)
        rows.append((10_000 + k, " ".join(other)))
    want = {d: c for d, _, c, _ in brute(rows, percent)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, percent).collect()}
    linked = [d for d in want if want[d] != d]
    assert len(linked) > 80 and all(got[d] >= want[d] for d in want)
    assert sum(got[d] == want[d] for d in linked) >= 0.99 * len(linked)


def test_nodes_of_two_blocks_are_compared_at_once(spark, monkeypatch):
    """300 texts that are alike, few of them linked, in nodes over LEAF: each was dealt out to 20 nodes and more."""
    monkeypatch.setattr(near_dedup, "LEAF", 160)
    made, plain = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name="table", *more: (made.append(plain(df, name, *more)) or made[-1]) if name == "nodes" else plain(df, name, *more))
    rng = random.Random(6)
    passage, rows = " ".join(f"p{k}" for k in range(100)), []
    for k in range(250):
        own = [f"o{k}x{j}" for j in range(30)]
        rows.append((k, f"{passage} {' '.join(own)}"))
        if k % 5 == 0:
            own[-12:] = [f"z{k}x{j}" for j in range(12)]
            rows.append((1000 + k, f"{passage} {' '.join(own)}"))
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == brute(rows, 80)
    assert not sum(t.count() for t in made[1:])


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_miss_few_pairs_at_the_threshold(percent):
    n, places = near_dedup.bands(percent / 100), near_dedup.places(percent / 100)
    assert sum(near_dedup.missed(percent / 100, k, of_level) for k, of_level in enumerate(n, 1)) <= near_dedup.MOST_MISSED
    assert all(len({*row}) == len(row) for row in (r[r >= 0].tolist() for r in places))
    # pairs that agree in each place of their sketches with the probability of their similarity, over all levels
    rng, lost = np.random.default_rng(percent), 0
    for _ in range(10):
        agree = rng.random((10_000, near_dedup.SKETCH)) < percent / 100
        gone = np.zeros(len(agree), bool)
        for level, of_level in enumerate(n, 1):
            gone |= ~np.any([agree[:, places[band, :level]].all(axis=1) for band in range(of_level)], axis=0)
        lost += int(gone.sum())
    assert lost <= 40
