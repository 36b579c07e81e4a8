"""Toxicity scores by non-negative positive-unlabelled learning.

The learner sees texts that are confirmed toxic and texts of which nothing is known. Its risk weighs
the loss on the confirmed ones by the class prior, and takes the loss of calling unlabelled texts
toxic less the share of it that the prior owes to toxic texts among them; where that difference would
fall below zero, the step goes back against the overfitted part. Several linear classifiers are
trained in numpy on their own draws, each in a task of its own, and their margins are averaged.

A text's features are its words and the beginnings of its longer words, each counted once, so that a
word weighs the same in a long text as in a short one. Features are kept if confirmed texts hold
them significantly more often than unlabelled ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, texts_of

#: Bounds of the training sample: confirmed and unlabelled texts, and those labelled clean that only place the cut.
MOST_POSITIVE, MOST_UNLABELLED, MOST_CLEAN = 4000, 12000, 8000
#: Beginnings of words that serve as features, in characters.
BEGINNINGS = range(4, 10)
BUCKETS = 1 << 22
MOST_FEATURES = 4096
#: A feature's least number of confirmed texts, and standard deviations above what unlabelled texts lead to expect.
LEAST_TEXTS, LEAST_Z = 4, 4.5
MEMBERS, STEPS, RATE, DECAY = 5, 500, 0.05, 1e-4
WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """Hash buckets of a lower-cased word itself and of its beginnings that go on."""
    out = [xxhash.xxh3_64_intdigest(word + "\n") % BUCKETS]
    out += [xxhash.xxh3_64_intdigest(word[:n]) % BUCKETS for n in BEGINNINGS if len(word) > n]
    return tuple(out)


class Features(dict):
    """Features by word, remembered up to a bound; with ``of``, only those in it, by their positions there."""

    def __init__(self, of: dict[int, int] | None = None, most: int = 150_000) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = word_features(word)
        if self.of is not None:
            found = tuple(self.of[f] for f in found if f in self.of)
        self[word] = found
        return found

    def text(self, text: str) -> set[int]:
        return set().union(*map(self.__getitem__, set(WORD.findall(text.lower()))))


def select(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """The buckets that confirmed texts hold significantly more often than unlabelled ones, the clearest first."""
    n, m = len(positive), len(unlabelled)
    if not n or not m:
        return np.empty(0, np.int64)
    has = np.bincount(np.concatenate(positive), minlength=1)
    at = np.nonzero(has >= min(LEAST_TEXTS, n))[0]
    has = has[at]
    rate = (np.bincount(np.concatenate(unlabelled), minlength=BUCKETS)[at] + 0.5) / (m + 1)
    z = (has / n - rate) / np.sqrt(rate * (1 - np.minimum(rate, 1 - 1e-9)) * (1 / n + 1 / m))
    at, z = at[z > LEAST_Z], z[z > LEAST_Z]
    return at[np.argsort(-z, kind="stable")][:MOST_FEATURES]


class Sparse:
    """Rows of binary features: for each row the positions that it has."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.at = np.concatenate(rows) if rows else np.empty(0, np.int64)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) + w[-1]

    def slope(self, push: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the mean of a loss over the rows, weighted, by its slope in each row's margin."""
        push = push * weight / weight.sum()
        return np.append(np.bincount(self.at, push[self.row], self.width), push.sum())


def fit(positive: Sparse, unlabelled: Sparse, prior: float, seed: int) -> np.ndarray:
    """Weights, the last one the bias, that lower the non-negative risk with the logistic loss on a draw of the rows."""
    rng = np.random.default_rng(seed)
    of_p, of_u = (rng.multinomial(x.n, np.full(x.n, 1 / x.n)).astype(float) for x in (positive, unlabelled))
    w, first, second = np.zeros(positive.width + 1), np.zeros(positive.width + 1), np.zeros(positive.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        on_p, on_u = (1 / (1 + np.exp(-np.clip(x.margins(w), -30, 30))) for x in (positive, unlabelled))
        negative_risk = np.average(-np.log(1 - on_u + 1e-13), weights=of_u) + prior * np.average(np.log(1 - on_p + 1e-13), weights=of_p)
        g = unlabelled.slope(on_u, of_u) - prior * positive.slope(on_p, of_p)
        g = -g if negative_risk < 0 else g + prior * positive.slope(on_p - 1, of_p)
        g[:-1] += DECAY * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def calibrated(margins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The margin at which calling what lies above it toxic agrees best with the labels, by weighted F1; midway between two rows."""
    order = np.argsort(-margins, kind="stable")
    m, held = margins[order], weights[order]
    hits = np.cumsum(toxic[order] * held)
    f1 = 2 * hits / (np.cumsum(held) + hits[-1])
    f1[:-1][m[1:] == m[:-1]] = 0
    best = int(np.argmax(f1))
    return float(m[best] + m[best + 1]) / 2 if best + 1 < len(m) else float(m[best]) - 1


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Confirmed texts are a sample of at most MOST_POSITIVE labelled 1, unlabelled ones at most
    MOST_UNLABELLED of all ``docs``, by a hash of doc_id; at most MOST_CLEAN that are labelled 0 take
    no part in the risk, but serve to place the cut at a score of a half; there each class weighs as much
    as all its labels, however few of them the bounds let in. The prior is the share of toxic labels
    unless it is given. Without confirmed texts nothing is toxic. Labels that are null count as none.
    """
    labelled = labels.where("doc_id is not null and toxic is not null")
    share = labelled.agg(F.avg(F.col("toxic").cast("double")).alias("share")).first()["share"]
    prior = min(max(share or 0.01, 1e-3), 0.5) if prior is None else prior
    of_label = {r["toxic"]: r["count"] for r in labelled.select("doc_id", "toxic").distinct().groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))

    def drawn(ids: DataFrame, kind: int, most: int) -> DataFrame:
        return ids.select("doc_id").distinct().orderBy(order, "doc_id").limit(most).withColumn("kind", F.lit(kind))

    chosen = drawn(labelled.where("toxic = 1"), 1, MOST_POSITIVE).unionByName(drawn(labelled.where("toxic = 0"), 2, MOST_CLEAN))
    chosen = chosen.unionByName(drawn(docs.where("doc_id is not null"), 0, MOST_UNLABELLED))
    sample = documents(docs).join(F.broadcast(chosen), "doc_id").select("kind", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in small_batches(batches):
            found = [np.fromiter(features.text(t), np.int32).tobytes() for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["kind", "features"])

    rows = sample.mapInArrow(extract, "kind int, features binary").toPandas()
    unlabelled, positive, clean = ([np.frombuffer(x, np.int32) for x in rows.features[rows.kind == k]] for k in (0, 1, 2))
    buckets = select(positive, unlabelled)
    if not len(buckets):
        return buckets, np.array([-5.0])
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def sparse(texts: list[np.ndarray]) -> Sparse:
        return Sparse([at[at >= 0] for at in (place[x] for x in texts)], len(buckets))

    p, u, n = map(sparse, (positive, unlabelled, clean))
    given = docs.sparkSession.sparkContext.broadcast((p, u, prior))

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"weights": [fit(*given.value, int(seed)).tolist() for seed in frame["id"]]})

    fitted = docs.sparkSession.range(0, MEMBERS, 1, MEMBERS).mapInPandas(members, "weights array<double>").collect()
    weights = np.mean([r["weights"] for r in fitted], axis=0)
    margins = np.concatenate([p.margins(weights), n.margins(weights)])
    if n.n:
        stand_for = np.repeat([max(1.0, of_label.get(1, 0) / MOST_POSITIVE), max(1.0, of_label.get(0, 0) / MOST_CLEAN)], [p.n, n.n])
        weights[-1] -= calibrated(margins, np.arange(len(margins)) < p.n, stand_for)
    return buckets, weights


class Scorer:
    """Scores of texts by a model of buckets and weights."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray) -> None:
        self.weights = weights
        self.features = Features({b: k for k, b in enumerate(buckets.tolist())})

    def __call__(self, texts: list[str]) -> np.ndarray:
        margins = np.array([self.weights[-1] + sum(self.weights[k] for k in sorted(self.features.text(t))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score: 0 to 1) for each row of ``docs`` (doc_id, text), from the whole text.

    A null or empty text gets the score that the bias alone gives.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*given.value)
        for batch in small_batches(batches):
            yield pa.record_batch([batch.column(0), pa.array(scorer(texts_of(batch)), pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``cut``; a null text counts as empty."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*given.value)
        for batch in small_batches(batches):
            yield batch.filter(pa.array(scorer(texts_of(batch)) < cut))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Whether a row is kept from training: CRC-32 of its doc_id as text, modulo 5, is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, learned from the rows that aren't held out."""
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
