"""The best documents for each query text, by range-maximum tables over posting lists.

The documents are cut into segments, each with the posting lists of the queries' terms alone. A posting's
impact is what it adds to a document's score, and each list has a sparse table that tells the posting of
the highest impact between any two places. A query's search in a segment takes intervals of documents in
the order of their bounds, best first: an interval's bound is the sum of the maxima that its terms'
tables answer. It is split at the document of the greatest of them, which is scored; an interval with few
postings is scored whole. The search ends where no bound reaches the last of the best documents so
far, which a task carries from segment to segment.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, small_batches
from .terms import term_table, terms

#: Queries in a block, whose terms are broadcast at once.
BLOCK = 2048
#: Documents and postings that make a segment, and postings in an interval that is scored whole.
DOCUMENTS, POSTINGS, LEAF = 8192, 1 << 19, 2048
SEGMENTS = "named boolean, docs long, terms long, doc_id binary, size binary, term binary, doc binary, tf binary"


class Open:
    """A segment in the making: documents' names and sizes, and a posting for each query term that they hold."""

    def __init__(self, named: bool) -> None:
        self.named, self.ids, self.sizes = named, [], []
        self.with_terms = self.all_terms = 0
        self.term, self.doc, self.tf = [], [], []

    def add(self, doc_id: int | None, words: list[bytes], known: dict[bytes, int]) -> None:
        if not words:
            return
        self.with_terms += 1
        self.all_terms += len(words)
        counts = Counter(filter(known.__contains__, words))
        self.term += map(known.__getitem__, counts)
        self.tf += counts.values()
        self.doc += [len(self.ids)] * len(counts)
        self.ids.append(doc_id or 0)
        self.sizes.append(len(words))

    def full(self) -> bool:
        return len(self.ids) >= DOCUMENTS or len(self.term) >= POSTINGS

    def row(self) -> pa.RecordBatch:
        """The segment, its postings by term and document; the documents lie in the order of their sizes, so that near ones have near impacts."""
        sizes = np.array(self.sizes, np.int64)
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        term, doc, tf = np.array(self.term, np.int32), place[np.array(self.doc, np.int64)], np.array(self.tf, np.int32)
        by = np.lexsort((doc, term))
        parts = np.array(self.ids, np.int64)[order], sizes[order], term[by], doc[by].astype(np.int32), tf[by]
        counts = [pa.array([self.named]), pa.array([self.with_terms]), pa.array([self.all_terms])]
        return pa.record_batch([*counts, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["named", "docs", "terms", "doc_id", "size", "term", "doc", "tf"])


def segments(docs: DataFrame, known) -> DataFrame:
    """The documents with at least one term, as segments; ``known``: a broadcast of the query terms' numbers."""
    table = term_table(digits=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {named: Open(named) for named in (True, False)}
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = open_[doc_id is not None]
                own.add(doc_id, terms(text, table), known.value)
                if own.full():
                    yield own.row()
                    open_[own.named] = Open(own.named)
        yield from (x.row() for x in open_.values() if x.ids)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SEGMENTS)


def document_counts(cut: DataFrame, width: int) -> dict[int, int]:
    """In how many documents each query term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(term, np.int32), minlength=width)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["term", "df"])

    summed = cut.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in summed.collect()}


class Segment:
    """Posting lists with their impacts and range-maximum tables; ``weights``: of the query terms, ``n``, ``total``: documents and terms in all."""

    def __init__(self, row: dict[str, bytes], weights: np.ndarray, n: int, total: int) -> None:
        self.ids, size = np.frombuffer(row["doc_id"], np.int64), np.frombuffer(row["size"], np.int64)
        term, self.doc = np.frombuffer(row["term"], np.int32), np.frombuffer(row["doc"], np.int32)
        tf = np.frombuffer(row["tf"], np.int32).astype(np.int64)
        self.n_docs = len(self.ids)
        fits = 25 * n * int(size.max()) < 2**63
        m = 75 + (25 * size * n // total if fits else np.array([25 * int(x) * n // total for x in size], np.int64))
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.keys = term.astype(np.int64) * self.n_docs + self.doc
        longest = int(np.diff(self.start).max(initial=0))
        # table[j][p]: the place of the highest impact among 2**j postings from p on; it is asked for within one list only
        table = [np.arange(len(term), dtype=np.int32)]
        while 2 ** len(table) <= longest:
            left, half = table[-1], 2 ** (len(table) - 1)
            right = np.append(left[half:], np.full(min(half, len(left)), len(term) - 1, np.int32))
            table.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.table = np.stack(table)
        self.log = np.log2(np.maximum(np.arange(longest + 1), 1)).astype(np.int64)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each list the place of the highest impact from ``a`` to before ``b``, none of which may be empty."""
        j = self.log[b - a]
        left, right = self.table[j, a], self.table[j, b - (1 << j)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def interval(self, term: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple | None:
        """(bound, document to split at, lists that go on) of the documents whose postings are from ``a`` to before ``b``."""
        some = b > a
        if not some.any():
            return None
        term, times, a, b = term[some], times[some], a[some], b[some]
        top = self.best(a, b)
        parts = self.impact[top] * times
        return int(parts.sum()), int(self.doc[top[int(parts.argmax())]]), term, times, a, b

    def whole(self, times: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of an interval with few postings, and their scores."""
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
        docs, back = np.unique(self.doc[at], return_inverse=True)
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, back, self.impact[at] * np.repeat(times, size))
        return docs, scores

    def search(self, term: np.ndarray, times: np.ndarray, found: list[tuple[int, int]], k: int) -> None:
        """Puts the segment's documents that belong to the ``k`` best into ``found``, a heap of (score, -doc_id)."""

        def take(docs: np.ndarray, scores: np.ndarray) -> None:
            least = found[0][0] if len(found) >= k else 1
            for at in np.flatnonzero(scores >= least):
                entry = int(scores[at]), -int(self.ids[docs[at]])
                if entry[0] > 0:
                    (heapq.heappush if len(found) < k else heapq.heappushpop)(found, entry)

        first = self.interval(term, times, self.start[term], self.start[term + 1])
        waiting, n = ([(-first[0], 0, *first[1:])] if first else []), 0
        while waiting:
            bound, _, doc, term, times, a, b = heapq.heappop(waiting)
            if bound == 0 or len(found) >= k and -bound < found[0][0]:
                return
            if int((b - a).sum()) <= LEAF:
                take(*self.whole(times, a, b))
                continue
            at = np.searchsorted(self.keys, term.astype(np.int64) * self.n_docs + doc)
            there = at < b
            there[there] = self.doc[at[there]] == doc
            take(np.array([doc]), np.array([int((self.impact[at[there]] * times[there]).sum())]))
            for x in (self.interval(term, times, a, at), self.interval(term, times, at + there, b)):
                if x is not None:
                    n += 1
                    heapq.heappush(waiting, (-x[0], n, *x[1:]))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) that score highest for each of ``items`` (item_id, text).

    Equal scores go by ascending doc_id, ranks count from 1, and a score of 0 has no rank. Null and empty texts
    have no terms; an item without any has no rows. Documents without doc_id count in the statistics, but have
    no rank; items without item_id take no part, and of items that repeat one the smallest text is taken;
    documents that repeat a doc_id are ranked each. Other columns take no part. Empty tables give an empty
    result. Items are taken in blocks of BLOCK.
    """
    spark, table = docs.sparkSession, term_table(digits=True)
    asked = materialize(items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")), "asked")
    n_blocks = -(-asked.count() // BLOCK)
    done = []
    for n in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == n).collect()
        held = {r["item_id"]: Counter(terms((r["text"] or "").encode(), table)) for r in own}
        known = {t: at for at, t in enumerate(sorted(set().union(*held.values())))}
        if known:
            done.append(_of_block(docs, held, known, k))
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    out = reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(place))
    return out.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _of_block(docs: DataFrame, held: dict[int, Counter], known: dict[bytes, int], k: int) -> DataFrame:
    """(item_id, doc_id, score) of what may be among the best for a block of items."""
    sc = docs.sparkSession.sparkContext
    cut = materialize(segments(docs, sc.broadcast(known)), "segments")
    size = cut.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n, total = size["docs"] or 0, size["terms"] or 0
    df = document_counts(cut, len(known))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))], np.int64)
    queries = {i: (np.array([known[t] for t in c], np.int64), np.array([*c.values()], np.int64)) for i, c in sorted(held.items()) if c}
    given = sc.broadcast((queries, weights, n, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n, total = given.value
        best: dict[int, list[tuple[int, int]]] = {i: [] for i in queries}
        for batch in small_batches(batches, 1):
            segment = Segment(batch.to_pylist()[0], weights, n, total)
            if len(segment.doc):
                for i, (term, times) in queries.items():
                    segment.search(term, times, best[i], k)
        rows = [(i, -doc_id, score) for i, found in best.items() for score, doc_id in found]
        if rows:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["item_id", "doc_id", "score"])

    return cut.where("named").select("doc_id", "size", "term", "doc", "tf").mapInArrow(run, "item_id long, doc_id long, score long")
