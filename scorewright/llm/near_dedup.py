"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Sets that are equal form a class; one document
stands for it. Each of several independent bands deals the classes out by minwise tokens: a node of
level k holds the classes that agree on a band's first k tokens. Small nodes are compared
exhaustively; in large ones each band goes on with a further token, unless all they hold is known to
be one component. A pair that shares a node agrees on the next token only with the probability of
its similarity, so at each level the classes of large nodes get new bands, just so many that loss
doesn't grow with depth. A node that stays large to the last level is compared in blocks, so no pair
is given up for its size; one of few blocks is compared so at once.
Every link is confirmed on the full sets.

The work on a group of copies stays near its size: equal sets collapse first; then every class of a
node is held against the node's most central class, and only pairs that this has not put into one
component already are compared later.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, distinct, documents, materialize, mix64, small_batches, texts_of
from .components import connected_components

SHINGLE = 5
TREES = 10
LEVELS = 8
#: The probability that a pair at the threshold shares no node at some level.
MOST_MISSED = 1e-4
#: Minwise values whose low bytes estimate a similarity before it is confirmed.
SKETCH = 256
#: Standard deviations below the threshold at which an estimate is still confirmed.
SLACK = 6.0
#: Classes in a node that are compared exhaustively.
LEAF = 1024
#: Blocks of LEAF classes up to which a node is compared in blocks instead of being dealt out further.
AT_ONCE = 2
#: Ids that are broadcast to pick the texts that links are confirmed on; more of them are joined by a shuffle.
MOST_BROADCAST = 2_000_000
_SEED = np.random.default_rng(20)
_PLACES = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FACTORS = (_SEED.integers(1, 2**32, SKETCH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_set(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text, A-Z lower-cased.

    Words end at ASCII white space, where bytes.split() splits. With fewer words than ``size``
    the whole sequence is the only shingle; without words there is none.
    """
    words = hashes.of(text.encode("utf-8", "replace").lower().split())
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < size:
            return mix64((words * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += words[k : n - size + 1 + k] * _PLACES[k]
        return distinct(mix64(total + np.uint64(size)))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """SKETCH minwise values of a set of hashes, in slices so that long sets need little memory."""
    low = (tokens >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 8192):
            np.minimum(out, (low[at : at + 8192, None] * _FACTORS).min(axis=0), out=out)
    return out


def missed(similarity: float, level: int, n: int) -> float:
    """The probability that a pair agrees on all tokens of none of ``n`` bands of ``level`` tokens."""
    return (1 - similarity**level) ** n


@lru_cache
def bands(similarity: float) -> tuple[int, ...]:
    """The number of bands at each level: so many that what all levels together miss is at most MOST_MISSED.

    The bands of a level are those of the level before and new ones. A level may miss half of what
    those before it have left, the last one all. No more than three times SKETCH tokens are taken;
    that binds far below a similarity of 0.8.
    """
    out, left = [TREES], MOST_MISSED - missed(similarity, 1, TREES)
    for level in range(2, LEVELS + 1):
        most = max(out[-1], 3 * SKETCH // level)
        fit = (n for n in range(out[-1], most) if missed(similarity, level, n) <= max(left if level == LEVELS else left / 2, MOST_MISSED / 100))
        out.append(next(fit, most))
        left -= missed(similarity, level, out[-1])
    return tuple(out)


@lru_cache
def places(similarity: float) -> np.ndarray:
    """Where in the sketch band j has its token of level k: row j, column k - 1.

    Each has a token of its own, taken again from the first on beyond the sketch, but never twice in a band.
    """
    n = bands(similarity)
    out, taken = np.full((n[-1], LEVELS), -1), 0
    for level in range(1, LEVELS + 1):
        for band in range(n[level - 1]):
            for k in np.nonzero(out[band, :level] < 0)[0]:
                while taken % SKETCH in out[band]:
                    taken += 1
                out[band, k] = taken % SKETCH
                taken += 1
    return out


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seeds = np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(40)
        for batch in small_batches(batches):
            n, prints, nodes, bits = [], [], [], []
            for text in texts_of(batch):
                tokens = shingle_set(text, hashes, size)
                n.append(len(tokens))
                if not len(tokens):
                    for out in (prints, nodes, bits):
                        out.append(None)
                    continue
                prints.append(_fingerprint(tokens))
                values = minwise(tokens)
                nodes.append(mix64(values[:TREES].astype(np.uint64) + seeds).view(np.int64))
                bits.append(values.astype(np.uint8).tobytes())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "n_shingles", "print", "nodes", "bits"],
            )

    return run


def _fingerprint(tokens: np.ndarray) -> bytes:
    """16 bytes that equal sets share and others don't, but for an accident of 128 bits."""
    with np.errstate(over="ignore"):
        a, b = mix64(tokens).sum(), mix64(tokens ^ _PLACES[63]).sum() + np.uint64(len(tokens))
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def _least(threshold: float) -> int:
    """Of SKETCH agreeing bytes, how many a pair needs to be confirmed."""
    mean = threshold + (1 - threshold) / 256
    return math.ceil(SKETCH * (mean - SLACK * math.sqrt(mean * (1 - mean) / SKETCH)))


def _agreeing(least: int):
    """Of rows (a, b, bits_a, bits_b) the pairs whose sketches agree in ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: what is shuffled to confirm links."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        yield pa.record_batch([batch.column(0), pa.array([pack.compress(t.encode("utf-8", "replace")) for t in texts_of(batch)], pa.binary())], names=["id", "packed"])


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


class _Sets:
    """Shingle sets of packed texts, the recent ones remembered by id."""

    def __init__(self, size: int, most: int = 1100) -> None:
        self.size, self.most, self.hashes, self.unpack = size, most, WordHashes(), zstandard.ZstdDecompressor()
        self.recent: OrderedDict[int, np.ndarray] = OrderedDict()
        self.held = 0

    def of(self, key: int, packed) -> np.ndarray:
        if (known := self.recent.get(key)) is not None:
            self.recent.move_to_end(key)
            return known
        packed = packed.as_py() if isinstance(packed, pa.Scalar) else packed
        out = self.recent[key] = shingle_set(self.unpack.decompress(packed).decode("utf-8"), self.hashes, self.size)
        self.held += len(out)
        while self.held > 4_000_000 and len(self.recent) > 2 or len(self.recent) > self.most:
            self.held -= len(self.recent.popitem(last=False)[1])
        return out


def _confirmed(percent: int, size: int):
    """Of rows (a, b, packed_a, packed_b) the pairs that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for batch in small_batches(batches):
            kept = [(a, b) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if alike(sets.of(a, x), sets.of(b, y), percent)]
            yield pa.record_batch([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in tables that hold whole runs of rows with one node; rows arrive sorted by node."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        node = held.column(0).to_numpy()
        earlier = np.nonzero(node != node[-1])[0]
        if len(earlier):
            yield held.slice(0, int(earlier[-1]) + 1)
            held = held.slice(int(earlier[-1]) + 1)
    if held is not None:
        yield held


def _alike(rows: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, place, agreeing bytes) of pairs of one node with different labels whose sketches agree enough.

    Rows (node, block, id, label, bits) are in runs of one node. Rows of a node that was dealt out in
    blocks are compared only across its two blocks, or within a block that is alone.
    """
    node, block, _, labels = (rows.column(k).to_numpy() for k in range(4))
    bits = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH)
    found, at, step = [], np.arange(len(node)), 1
    while True:
        at = at[at + step < len(node)]
        at = at[node[at] == node[at + step]]
        if not len(at):
            break
        for start in range(0, len(at), 20_000):
            x = at[start : start + 20_000]
            x = x[(labels[x] != labels[x + step]) & ((block[x] < 0) | (block[x] != block[x + step]))]
            if len(x):
                agree = (bits[x] == bits[x + step]).sum(axis=1)
                x, agree = x[agree >= least], agree[agree >= least]
                found.append((x, x + step, agree))
        step += 1
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _involved(least: int):
    """Of the rows of leaf nodes, those that may have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            x, y, _ = _alike(rows, least)
            yield from rows.take(pa.array(np.unique(np.concatenate([x, y])))).to_batches()

    return run


def _linked(least: int, percent: int, size: int):
    """Links (a, b) between the labels of rows (node, block, id, label, bits, packed) of leaf nodes, confirmed on the full sets.

    Pairs are taken from the likeliest on; a pair that the links of its node connect already is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(size)
        for rows in _runs(small_batches(batches, 2048)):
            x, y, agree = _alike(rows, least)
            node, _, ids, labels = (rows.column(k).to_numpy() for k in range(4))
            packed = rows.column(5)
            above: dict[tuple[int, int], tuple[int, int]] = {}

            def top(key: tuple[int, int]) -> tuple[int, int]:
                while above.get(key, key) != key:
                    key = above[key]
                return key

            left, right = [], []
            for k in np.lexsort((y, x, -agree)):
                i, j = int(x[k]), int(y[k])
                a, b = top((node[i], labels[i])), top((node[j], labels[j]))
                if a != b and alike(sets.of(ids[i], packed[i]), sets.of(ids[j], packed[j]), percent):
                    above[max(a, b)] = min(a, b)
                    left.append(labels[i])
                    right.append(labels[j])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _next_nodes(level: int, similarity: float):
    """Of rows (node, id, label, tree, bits) of ``level`` those of the next one.

    ``tree`` is a row's band, which goes on by its next token; a row with -1 is a class that gets the
    next level's new bands, all their tokens at once. A token's low byte stands for it: equal tokens
    agree on it, others by accident once in 256 times.
    """
    n, at = bands(similarity), places(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = batch.column(3).to_numpy(zero_copy_only=False)
            for old in (True, False):
                rows = batch.filter(pa.array((tree >= 0) == old))
                if not rows.num_rows:
                    continue
                bits = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.uint64)
                if old:
                    node = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                    yield _at_nodes(rows, _further(node, bits[np.arange(len(bits)), at[tree[tree >= 0], level]]), rows.column(3))
                    continue
                for band in range(n[level - 1], n[level]):
                    node = np.full(len(bits), band, np.uint64)
                    for k in at[band, : level + 1]:
                        node = _further(node, bits[:, k])
                    yield _at_nodes(rows, node, pa.array(np.full(len(bits), band, np.int32)))

    return run


def _further(node: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(node) + token)


def _at_nodes(rows: pa.RecordBatch, node: np.ndarray, tree: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([pa.array(node.view(np.int64)), rows.column(1), rows.column(2), tree, rows.column(4)], names=["node", "id", "label", "tree", "bits"])


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable by links, and kept marks the row that has it.
    A null or empty text, or one of white space, has no shingles and is linked with nothing. A row
    without doc_id takes no part in links: its component_id is null and it is kept. Rows that
    repeat a doc_id fall into one component. Extra columns of ``docs`` are left out.
    """
    least, n_bands = _least(percent / 100), bands(percent / 100)
    base = materialize(documents(docs).mapInArrow(_sketches(size), "doc_id long, n_shingles long, print binary, nodes array<long>, bits binary"), "sketches")
    classes = base.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "nodes", "bits")).alias("x"))
    classes = materialize(classes.select("print", "x.*").withColumnRenamed("doc_id", "id"), "classes")

    seen = classes.select("id", F.posexplode("nodes").alias("tree", "node"))
    shared = materialize(seen.groupBy("node").count().where("count > 1"), "shared")
    members = seen.join(shared, "node").groupBy("id").agg(F.collect_list(F.struct("node", "tree", "count")).alias("at"), F.sum("count").alias("weight"))
    members = materialize(members.select("id", "weight", F.explode("at").alias("at")).select("id", "weight", "at.*"), "members")
    wanted = materialize(members.select("id").distinct(), "wanted")
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = documents(docs).join(wanted, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text")
    texts = materialize(texts.mapInArrow(_packed, "id long, packed binary"), "texts")

    centres = materialize(members.groupBy("node").agg(F.max(F.struct("weight", "id")).alias("x")).select("node", F.col("x.id").alias("a")), "centres")
    spokes = members.join(centres, "node").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    bits = classes.select("id", "bits")
    sketched = _with_both(spokes, bits, "bits").mapInArrow(_agreeing(least), "a long, b long")
    links = materialize(_confirm(sketched, texts, percent, size), "links")
    labels = connected_components(links)

    labelled = members.join(labels, members.id == labels.v, "left").select("node", "id", F.coalesce("label", "id").alias("label"), "tree")
    found = None
    for level in range(1, LEVELS + 1):
        labelled = materialize(labelled, "nodes")
        per_label = labelled.groupBy("node", "label").count()
        mixed = materialize(per_label.groupBy("node").agg(F.sum("count").alias("n"), F.count("*").alias("n_labels")).where("n_labels > 1"), "mixed")
        large = mixed.where(F.col("n") > AT_ONCE * LEAF)
        any_large = level < LEVELS and large.limit(1).count() > 0
        rows = labelled.join(mixed, "node")
        if level == 1:  # what may be compared carries its sketch from here on
            rows = materialize(rows.join(bits, "id").select("node", "id", "label", "tree", "n", "bits"), "mixed-rows")
        leaf = rows.where(F.col("n") <= AT_ONCE * LEAF) if any_large else rows
        involved = _leaf_rows(leaf).mapInArrow(_involved(least), LEAF_ROW)
        found = involved if found is None else found.unionByName(involved)
        if not any_large:
            break
        deeper = rows.where(F.col("n") > AT_ONCE * LEAF).select("node", "id", "label", "tree", "bits")
        if n_bands[level] > n_bands[level - 1]:
            deeper = deeper.union(deeper.dropDuplicates(["id", "bits"]).withColumn("tree", F.lit(-1)))
        labelled = deeper.mapInArrow(_next_nodes(level, percent / 100), "node long, id long, label long, tree int, bits binary")
    found = materialize(found, "involved").join(texts, "id").select("node", "block", "id", "label", "bits", "packed")
    more = found.repartition("node").sortWithinPartitions("node").mapInArrow(_linked(least, percent, size), "a long, b long")
    # what the first links have joined is one vertex for the others, its smallest id
    joined = connected_components(more).select(F.col("v").alias("was"), F.col("label").alias("component"))
    of_class = classes.select("print", "id").join(labels, F.col("id") == F.col("v"), "left").select("print", F.coalesce("label", "id").alias("was"))
    of_class = materialize(of_class.join(joined, "was", "left").select("print", F.coalesce("component", "was").alias("component")), "class-components")
    out = base.select("doc_id", "n_shingles", "print").join(of_class, "print", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, but for those of a component that isn't its smallest doc_id's."""
    copies = materialize(near_duplicates(docs, percent, size).where("not kept").select(F.col("doc_id").alias("_copy")).distinct(), "copies")
    if copies.count() <= MOST_BROADCAST:
        copies = F.broadcast(copies)
    return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti")


LEAF_ROW = "node long, block int, id long, label long, bits binary"


def _leaf_rows(leaf: DataFrame) -> DataFrame:
    """The rows of ``leaf`` (node, id, label, n, bits), gathered by node; over LEAF rows, in blocks.

    A row of a large node goes to one task for each pair of blocks that its own block is in.
    """
    n_blocks = F.ceil(F.col("n") / LEAF).cast("int")
    own = F.when(F.col("n") > LEAF, F.pmod(F.hash("id"), n_blocks)).otherwise(F.lit(-1))
    dealt = leaf.withColumn("block", own).withColumn("other", F.explode(F.when(F.col("block") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), n_blocks - 1))))
    # a block is compared with itself in the one task where both are the same; there its rows carry -1
    dealt = dealt.select(
        F.when(F.col("block") < 0, F.col("node")).otherwise(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))).alias("node"),
        F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).alias("block"),
        "id",
        "label",
        "bits",
    )
    return dealt.repartition("node").sortWithinPartitions("node")


def _with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """(a, b, what ``of`` has for a, what it has for b); the joins of a hub's rows can be split."""
    one = pairs.join(of.select(F.col("id").alias("b"), F.col(name).alias("for_b")), "b")
    return one.join(of.select(F.col("id").alias("a"), F.col(name).alias("for_a")), "a").select("a", "b", "for_a", "for_b")


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    return _with_both(materialize(pairs, "pairs"), texts, "packed").mapInArrow(_confirmed(percent, size), "a long, b long")
