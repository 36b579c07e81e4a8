"""Quality scores by naive Bayes support vectors.

A text's n-grams are its words and runs of one to five word shapes, each present or absent. A shape is a
word with its letters, digits and signs as classes and repeats of a class as one, marked where the word
is the one before it again; so runs of shapes tell shouting, signs, lists and loops in any language. Each
n-gram is scaled by its class log-count ratio: the logarithm of how much oftener good texts hold it than
bad ones. A linear model with the hinge loss is fitted to these rows, of length one, by dual coordinate
descent, and its margins become scores by a logistic curve through rows that the fit hasn't seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, documents, materialize, mix64, small_batches, texts_of

#: Bound of the training sample: labelled texts of each class.
MOST_EACH = 12_000
#: Features kept, the most telling first, and the least number of sampled texts that hold one.
MOST_FEATURES, LEAST_TEXTS = 8192, 5
#: Longest run of shapes, bound of the dual variables, passes over the rows, and the share of rows (one in) that place the scores.
LONGEST_RUN, BOUND, PASSES, APART = 5, 1.0, 10, 5
#: Words remembered by a task, and the longest of them.
MOST_WORDS, LONGEST_WORD = 200_000, 64
STEP, AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ENDS = ".,;:!?\"'()"


def shape(word: str) -> str:
    """A word with each run of upper-case letters, other letters, digits or one and the same sign as one character."""
    classes = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", classes, flags=re.DOTALL)


class Words(dict):
    """(hash of the word without case and marks at its ends, hash of its shape) by word, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        found = xxhash.xxh3_64_intdigest("w" + word.lower().strip(ENDS)), xxhash.xxh3_64_intdigest("s" + shape(word))
        if len(word) <= LONGEST_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = found
        return found


def ngrams(text: str, words: Words) -> np.ndarray:
    """The different n-grams of a text as sorted 32-bit hashes."""
    pairs = np.array([words[w] for w in text.split()], np.uint64).reshape(-1, 2)
    word, shapes = pairs[:, 0], pairs[:, 1].copy()
    shapes[1:] ^= np.where(word[1:] == word[:-1], AGAIN, np.uint64(0))
    run = mix64(shapes)
    found = [word, run]
    for n in range(2, LONGEST_RUN + 1):
        if len(run) < 2:
            break
        run = mix64(run[:-1] * STEP + shapes[n - 1 :] + np.uint64(n))
        found.append(run)
    return distinct((np.concatenate(found) >> np.uint64(32)).astype(np.uint32))


def positions(found: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where in the sorted ``features`` the hashes are that are there."""
    at = np.minimum(np.searchsorted(features, found), max(len(features) - 1, 0))
    return at[features[at] == found] if len(features) else at[:0]


def fit(rows: list[np.ndarray], good: np.ndarray, weight: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights of the scaled indicators, the last one the bias, that lower the hinge loss, each row weighted.

    A row is the positions of its features; scaled by their ratios it gets length one. Each step solves the
    dual problem in one variable exactly, within 0 and BOUND times the row's weight.
    """
    w, rng = np.zeros(len(ratios) + 1), np.random.default_rng(11)
    values = [scaled(at, ratios) for at in rows]
    square = np.array([v @ v + 1 for v in values])
    dual, sign = np.zeros(len(rows)), np.where(good, 1.0, -1.0)
    for _ in range(PASSES):
        for k in rng.permutation(len(rows)):
            at, v = rows[k], values[k]
            new = min(max(dual[k] - (sign[k] * (w[at] @ v + w[-1]) - 1) / square[k], 0.0), BOUND * weight[k])
            if new != dual[k]:
                push = (new - dual[k]) * sign[k]
                w[at] += push * v
                w[-1] += push
                dual[k] = new
    return w


def scaled(at: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The ratios at a row's positions, brought to length one."""
    v = ratios[at]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def curve(margins: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the share of good rows, by Newton steps on smoothed targets."""
    of_good, of_bad = weight[good].sum(), weight[~good].sum()
    target = np.where(good, (of_good + 1) / (of_good + 2), 1 / (of_bad + 2))
    x, b = np.stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        slope = x @ (weight * (p - target)) + 1e-6 * b
        bend = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        b -= step / max(1.0, float(np.abs(step).max()))
    return float(b[0]), float(b[1])


def trained(rows: list[np.ndarray], good: np.ndarray, weight: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights of the scaled indicators and the bias, such that the logistic function of a margin is its score.

    One row in APART places the curve and isn't fitted to; where those lack a class, or the curve would turn
    scores round, the margins stand as they are.
    """
    apart = np.arange(len(rows)) % APART == 0
    w = fit([r for r, x in zip(rows, apart, strict=True) if not x], good[~apart], weight[~apart], ratios)
    of_apart = good[apart]
    if of_apart.any() and not of_apart.all():
        margins = np.array([w[at] @ scaled(at, ratios) + w[-1] for at, x in zip(rows, apart, strict=True) if x])
        slope, offset = curve(margins, of_apart, weight[apart])
        if slope > 0:
            w *= slope
            w[-1] += offset
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, ratios, weights) from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality: 1 good, 0 bad).

    Learned from at most MOST_EACH labelled texts of each class, those first by a hash of doc_id; each
    class weighs as much as all its labels, however few of them the bound lets in. A doc_id that repeats
    counts each time, one with both labels as each; null labels count as none. With one class or none there
    are no features, and the bias alone tells the classes' shares.
    """
    labelled = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct()
    order = F.xxhash64("doc_id", F.lit(11))
    total = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    if len(total) < 2:
        share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
        return np.empty(0, np.uint32), np.empty(0), np.array([np.log(share / (1 - share))])
    drawn = [labelled.where(F.col("quality") == c).orderBy(order, "doc_id").limit(MOST_EACH) for c in (0, 1)]
    sample = documents(docs).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").select("doc_id", "quality", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in small_batches(batches):
            found = [ngrams(t, words).tobytes() for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "found"])

    rows = materialize(sample.mapInArrow(extract, "doc_id long, quality int, found binary"), "quality-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            quality = batch.column(0).to_numpy()
            each = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            hashes, at = np.unique(np.concatenate(each), return_inverse=True)
            good = np.bincount(at, np.repeat(quality, [len(x) for x in each]), len(hashes)).astype(np.int64)
            yield pa.record_batch([pa.array(hashes.astype(np.int64)), pa.array(good), pa.array(np.bincount(at, minlength=len(hashes)) - good)], names=["feature", "good", "bad"])

    held = rows.groupBy().agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).first()
    n_good, n_bad = held["good"], held["bad"]
    counts = rows.select("quality", "found").mapInArrow(count, "feature long, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rate = (F.col("good") + F.col("bad") + 1) / F.lit(n_good + n_bad + 2)
    clear = F.abs(F.col("good") / max(n_good, 1) - F.col("bad") / max(n_bad, 1)) / F.sqrt(rate * (1 - rate))
    told = counts.where(F.col("good") + F.col("bad") >= LEAST_TEXTS).orderBy(F.desc(clear), "feature").limit(MOST_FEATURES).collect()
    told.sort(key=lambda r: r["feature"])
    features = np.array([r["feature"] for r in told], np.uint32)
    ratios = np.array([np.log((r["good"] + 1) / (n_good + 2) / ((r["bad"] + 1) / (n_bad + 2))) for r in told])
    heavy = np.array([total[0] / max(n_bad, 1), total[1] / max(n_good, 1)])
    heavy /= heavy.max()
    given = docs.sparkSession.sparkContext.broadcast((features, ratios, heavy))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at = [positions(np.frombuffer(x, np.uint32), given.value[0]).astype(np.uint16).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["doc_id", "quality", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sorted(x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        if kept:
            good = np.array([q == 1 for _, q, _ in kept])
            w = trained([np.frombuffer(x, np.uint16) for _, _, x in kept], good, given.value[2][good.astype(int)], given.value[1])
            yield pa.record_batch([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["weights"])

    # all rows in one task: at most 2 * MOST_EACH of them, of 2 * MOST_FEATURES bytes each
    fitted = rows.mapInArrow(narrow, "doc_id long, quality int, at binary").repartition(1).mapInArrow(learn, "weights array<double>").collect()
    return features, ratios, np.array(fitted[0]["weights"]) if fitted else np.zeros(len(features) + 1)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score: 0 to 1, higher where good is likelier) for each row of ``docs`` (doc_id, text), from the whole text.

    A null or empty text gets the score that the bias alone gives; rows that repeat a doc_id are scored each
    by its own text; other columns take no part.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (features, ratios, w), words = given.value, Words()
        for batch in small_batches(batches):
            margins = []
            for text in texts_of(batch):
                at = positions(ngrams(text, words), features)
                margins.append(float(w[at] @ scaled(at, ratios) + w[-1]))
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))), pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Whether a row is kept from training: CRC-32 of its doc_id as text, modulo 3, is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, learned from the rows that aren't held out.

    Null and empty texts, repeats and further columns as in ``score``; empty tables give an empty result.
    """
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
