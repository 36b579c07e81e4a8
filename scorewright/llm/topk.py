"""Exact top-k inner products in three phases with a uniform threshold.

The components are dealt out over a few slices; a vector's score is the sum of its slices' scores.
First each task gathers, for every query, the best entries of each slice's local score list with their
whole scores, and each slice's least score. The k-th best of these whole scores is a cutoff that the
true k-th best can't fall below. Raised by the least scores, the cutoff is divided evenly over the
slices: a vector that is under its share in every slice can't reach the cutoff. The second phase
collects the entries that reach it in some slice, and the third resolves just their scores.

The queries are taken in blocks of bounded size, each against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches

SLICES = 4
#: Queries in a block: with their cutoffs what is broadcast at once.
BLOCK = 4096
#: Scores stay exact as doubles below this, and as whole numbers of eight bytes below the other.
EXACT, LARGEST = 2**53, 2**63
#: Scores that a task holds at once, and entries that it gathers before it keeps the best of them.
CELLS, ENTRIES = 1 << 20, 1 << 20
SCHEMA = "query_id long, kind long, vec_id long, score long"


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled with zeros."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), column.offsets[n].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False)
    out = np.zeros((n, width), kind)
    out[np.repeat(np.arange(n), sizes), np.concatenate([np.arange(s) for s in sizes]) if n else []] = flat
    return out


def _bounds(width: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, width, min(SLICES, max(width, 1)) + 1).astype(int)
    return [*zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _tops(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _best(entries: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k highest whole scores of each query; an entry that leads several slices counts once."""
    q, v, s = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    q, v, s = q[fresh], v[fresh], s[fresh]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


def _first(block, width: int, k: int):
    """Phase 1: (query, vec_id, score) of each slice's best entries, and (query, slice, least) as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value
        best, held, least = [], 0, None
        for batch in small_batches(batches, max(16, CELLS // len(ids))):
            names, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width, queries.dtype.type)
            parts = [queries[:, a:b] @ rows[:, a:b].T for a, b in _bounds(width)]
            whole = sum(parts)
            own = ids[:, None] == names[None, :]
            lows = np.stack([p.min(axis=1) for p in parts])
            least = lows if least is None else np.minimum(least, lows)
            for p in parts:
                at = _tops(np.where(own, -np.inf, p), k)
                q = np.broadcast_to(np.arange(len(ids))[:, None], at.shape)
                fair = ~np.take_along_axis(own, at, 1)
                best.append((ids[q[fair]], names[at[fair]], np.take_along_axis(whole, at, 1)[fair]))
                held += len(best[-1][0])
            if held > ENTRIES:
                best = [_best(best, k)]
                held = len(best[0][0])
        if least is None:
            return
        q, v, s = _best(best, k)
        yield _rows(q, np.zeros(len(q), int), v, s)
        for n, lows in enumerate(least):
            yield _rows(ids, np.full(len(ids), n + 1), np.zeros(len(ids), int), lows)

    return run


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names=["query_id", "kind", "vec_id", "score"])


def _resolved(block, width: int, k: int):
    """Phases 2 and 3: of the entries that reach their share of the cutoff in some slice, the task's best by whole score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, cutoff, share = block.value
        for batch in small_batches(batches, max(16, CELLS // len(ids))):
            names, rows = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), width, queries.dtype.type)
            reach = np.zeros((len(ids), len(names)), bool)
            for n, (a, b) in enumerate(_bounds(width)):
                reach |= queries[:, a:b] @ rows[:, a:b].T >= share[n][:, None]
            reach &= ids[:, None] != names[None, :]
            q, v = np.nonzero(reach)
            for at in range(0, len(q), 1 << 15):
                x, y = q[at : at + (1 << 15)], v[at : at + (1 << 15)]
                s = np.einsum("ij,ij->i", queries[x], rows[y])
                keep = s >= cutoff[x]
                x, y, s = x[keep], y[keep], s[keep]
                order = np.lexsort((names[y], -s, x))
                x, y, s = x[order], y[order], s[order]
                keep = np.arange(len(x)) - np.searchsorted(x, x) < k
                yield _rows(ids[x[keep]], np.zeros(keep.sum(), int), names[y[keep]], s[keep])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other vectors.

    Both inputs have vec_id and ``vector``, an array of whole numbers; others by ``integer_vectors``.
    Ties go to the smaller vec_id; ranks count from 1; fewer rows where there are fewer vectors. A
    vector takes no part as a candidate of a query of its own vec_id. Shorter vectors count as filled
    with zeros. Scores must fit in eight bytes, or it raises. Rows without vec_id take no part; of queries that repeat a vec_id one is taken; a
    candidate that repeats is a candidate each time. Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select("vec_id", "vector")
    size = rows.select(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    width, most = size["width"] or 0, size["most"] or 0
    if most * most * max(width, 1) >= LARGEST:
        raise ValueError("scores beyond whole numbers of eight bytes")
    kind = np.float64 if most * most * max(width, 1) < EXACT else np.int64
    asked = materialize(queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n_blocks = -(-asked.count() // BLOCK)
    done = []
    for n in range(n_blocks):
        own = sorted(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == n).collect(), key=lambda r: r["vec_id"])
        if not own:
            continue
        ids, matrix = np.array([r["vec_id"] for r in own]), np.zeros((len(own), width), kind)
        for r, x in zip(matrix, own, strict=True):
            r[: len(x["vector"])] = x["vector"]
        block = spark.sparkContext.broadcast((ids, matrix))
        gathered = materialize(rows.mapInArrow(_first(block, width, k), SCHEMA), "first-lists")
        kth = gathered.where("kind = 0").distinct().withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
        cut = {r["query_id"]: r["score"] for r in kth.where(F.col("place") == k).select("query_id", "score").collect()}
        lows = {(r["query_id"], r["kind"]): r["low"] for r in gathered.where("kind > 0").groupBy("query_id", "kind").agg(F.min("score").alias("low")).collect()}
        slices = len(_bounds(width))
        least = np.array([[lows.get((i, s + 1), 0) for i in ids.tolist()] for s in range(slices)], float)
        cutoff = np.array([cut.get(i, -np.inf) for i in ids.tolist()], float)
        share = least + (cutoff - least.sum(axis=0)) / slices
        # what is above them stays above them, however their doubles were rounded
        share -= 1e-6 * (1 + np.abs(share))
        cutoff = np.where(np.isfinite(cutoff), cutoff - 1e-6 * (1 + np.abs(cutoff)), cutoff)
        second = spark.sparkContext.broadcast((ids, matrix, cutoff, np.where(np.isfinite(cutoff), share, -np.inf)))
        found = rows.mapInArrow(_resolved(second, width, k), SCHEMA)
        done.append(found.select("query_id", "vec_id", "score"))
    if not done:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = reduce(DataFrame.unionByName, done)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, vector) with floor(scale * x) of each component x; without null vectors and such as hold a null or no finite number."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))
