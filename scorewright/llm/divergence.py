"""How far the sources of a language differ in their terms, over terms found by iceberg prefix refinement.

The texts are cut into terms once, and written as chunks of documents with their own small vocabularies.
Then prefixes of the terms' bytes are extended level by level, from FIRST bytes on, each level twice as
long. At each level the tasks count in how many documents a prefix that still lives stands; those in too
few are discarded with all terms that begin with them, as a term can't stand in more documents than its
prefix. A term that a level covers whole counts as itself, and the last level is the one where no
longer prefix lives. Only the terms that are left are gathered by source.

Between levels prefixes are 64-bit hashes, and what lives is a bitmap of fixed size that goes to all
tasks. Two hashes at one bit only let a prefix live on; whole terms are counted exactly in the end. Counts
are dealt out by slices of the bitmap, each task's for a slice in one piece, and added up slice by slice.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import distinct, materialize, small_batches
from .terms import term_table, terms

#: Bytes of the shortest prefixes, and bits of a map of living ones (8 MB).
FIRST, BITS = 6, 1 << 26
#: Slices of the map: at least and at most, and terms of documents that make one more.
LEAST_SLICES, MOST_SLICES, OF_SLICE = 1 << 9, 1 << 16, 1 << 22
#: Terms of documents that make a chunk, chunks in a file, and counts that a task gathers before it adds them up.
CHUNK, IN_FILE, GATHERED = 1 << 19, 4, 1 << 20
#: Counts below FITTING times SCALE fit in eight bytes.
SCALE, FITTING = 10**9, 9 * 10**9
CHUNKS = "lang string, sources array<string>, source binary, vocabulary binary, doc binary, term binary, n binary"


class Chunk:
    """Documents of one language, gathered: of each its source, of each of their terms the document, the term and its count."""

    def __init__(self, lang: str) -> None:
        self.lang, self.sources, self.vocabulary = lang, {}, {}
        self.source, self.doc, self.term, self.n = (array("i") for _ in range(4))

    def add(self, source: str, words: list[bytes]) -> None:
        counts = Counter(words)
        known = self.vocabulary
        self.doc += array("i", [len(self.source)]) * len(counts)
        self.term.extend([known.setdefault(t, len(known)) for t in counts])
        self.n.extend(counts.values())
        self.source.append(self.sources.setdefault(source, len(self.sources)))

    def row(self) -> pa.RecordBatch:
        numbers = [pa.array([x.tobytes()], pa.binary()) for x in (self.source, self.doc, self.term, self.n)]
        rest = pa.array([self.lang]), pa.array([[*self.sources]], pa.list_(pa.string())), pa.array([b" ".join(self.vocabulary)], pa.binary())
        return pa.record_batch([rest[0], rest[1], numbers[0], rest[2], *numbers[1:]], names=["lang", "sources", "source", "vocabulary", "doc", "term", "n"])


def chunks(docs: DataFrame) -> DataFrame:
    """The terms of all ``docs`` (text, lang, source) as chunks; nulls in them are empty strings."""
    table = term_table()
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Chunk] = {}
        held = 0
        for batch in small_batches(batches):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                chunk = open_.get(lang) or open_.setdefault(lang, Chunk(lang))
                held -= len(chunk.doc)
                chunk.add(source, terms(text, table))
                held += len(chunk.doc)
                if held >= CHUNK:
                    yield from (c.row() for c in open_.values())
                    open_, held = {}, 0
        yield from (c.row() for c in open_.values())

    return own.mapInArrow(run, CHUNKS)


def hashes(lang: str, words: list[bytes], length: int | None) -> np.ndarray:
    """64-bit hashes of a language's words, whole and odd, or of their first ``length`` bytes and even; the two never meet."""
    digest, seed = xxhash.xxh3_64_intdigest, xxhash.xxh3_64_intdigest(lang)
    of = np.fromiter((digest(w[:length], seed) for w in words), np.uint64, len(words))
    return of | np.uint64(1) if length is None else of & ~np.uint64(1)


def bit(of: np.ndarray) -> np.ndarray:
    """A hash's place in the map."""
    return (of >> np.uint64(1)).astype(np.int64) & (BITS - 1)


def lives(bitmap: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = bit(of)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sliced(slice_: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each slice with the places that have it."""
    order = np.argsort(slice_, kind="stable")
    different, first = np.unique(slice_[order], return_index=True)
    yield from zip(different.tolist(), np.split(order, first[1:]) if len(order) else (), strict=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and numbers of documents, added up by hash."""
    of, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    different, at = np.unique(of, return_inverse=True)
    return different, np.bincount(at, n, len(different)).astype(np.int64)


def _level(length: int, before: int | None, living, width: int):
    """Counts the documents of each prefix of ``length`` bytes, or shorter whole term, whose prefix of ``before`` bytes lives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in small_batches(batches, 1):
            lang, vocabulary, doc, term = (batch.column(k)[0].as_py() for k in range(4))
            words = vocabulary.split()
            longer = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > (before or 0))
            if before is not None:
                longer = longer[lives(living.value, hashes(lang, [words[k] for k in longer], before))]
            some = [words[k] for k in longer]
            whole = np.fromiter((len(w) <= length for w in some), bool, len(some))
            of = np.where(whole, hashes(lang, some, None), hashes(lang, some, length))
            different, at = np.unique(of, return_inverse=True)
            place = np.full(len(words), -1, np.int64)
            place[longer] = at
            place, doc = place[np.frombuffer(term, np.int32)], np.frombuffer(doc, np.int32)
            pairs = distinct(place[place >= 0] << 32 | doc[place >= 0])
            gathered.append((different, np.bincount(pairs >> 32, minlength=len(different))))
            held += len(different)
            if held >= GATHERED:
                gathered = [_summed(gathered)]
                held = len(gathered[0][0])
        if gathered:
            of, n = _summed(gathered)
            rows = [(k, of[own].tobytes(), n[own].tobytes()) for k, own in sliced(bit(of) // width)]
            if rows:
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "of", "docs"])

    return run


def refine(cut: DataFrame, least: int) -> np.ndarray:
    """The map of the whole terms that no level has discarded."""
    spark = cut.sparkSession
    rows, width = cut.select("lang", "vocabulary", "doc", "term"), BITS // _slices(cut)

    def living_of(table: pa.Table) -> pa.Table:
        """A slice's maps of the prefixes and of the whole terms in enough documents."""
        of, docs = (np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()]) for c in ("of", "docs"))
        of, docs = _summed([(of.view(np.uint64), docs)])
        out = []
        for odd in (0, 1):
            flags = np.zeros(width, np.uint8)
            flags[bit(of[(docs >= least) & (of & np.uint64(1) == odd)]) % width] = 1
            out.append(pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary()))
        return pa.table([table["slice"].combine_chunks()[:1], *out], names=["slice", "prefixes", "terms"])

    kept, living, length, before = np.zeros(BITS // 8, np.uint8), None, FIRST, None
    while True:
        counted = rows.mapInArrow(_level(length, before, living, width), "slice int, of binary, docs binary")
        parts = counted.groupBy("slice").applyInArrow(living_of, "slice int, prefixes binary, terms binary").collect()
        prefixes = np.zeros(BITS // 8, np.uint8)
        for r in parts:
            own = slice(r["slice"] * width // 8, (r["slice"] + 1) * width // 8)
            prefixes[own] = np.frombuffer(r["prefixes"], np.uint8)
            kept[own] |= np.frombuffer(r["terms"], np.uint8)
        if not prefixes.any():
            return kept
        living, before, length = spark.sparkContext.broadcast(prefixes), length, 2 * length


def _slices(cut: DataFrame) -> int:
    """A power of two of slices, by the number of terms of documents."""
    size = (cut.agg(F.sum(F.length("doc"))).first()[0] or 0) // 4
    return min(MOST_SLICES, max(LEAST_SLICES, 1 << (size // OF_SLICE).bit_length()))


GATHERED_ROWS = "slice int, langs array<string>, sources array<string>, lang binary, terms binary, at binary, docs binary, n binary"


class Gathered:
    """Counts of terms by source that a task has met: documents and occurrences for each term and source, by their numbers here."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.of = array("Q")
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    @staticmethod
    def places(known: dict, names: Iterator, n: int) -> np.ndarray:
        return np.fromiter((known.setdefault(x, len(known)) for x in names), np.int64, n)

    def add(self, at: np.ndarray, docs: np.ndarray | None, n: np.ndarray) -> None:
        different, back = np.unique(at, return_inverse=True)
        self.parts.append((different, np.bincount(back, docs, len(different)).astype(np.int64), np.bincount(back, n, len(different)).astype(np.int64)))
        self.held += len(different)

    def rows(self, width: int) -> Iterator[pa.RecordBatch]:
        """A row for each slice, with its own terms and languages and all the sources."""
        if not self.held:
            return
        at, docs, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        self.add(at, docs, np.zeros(len(at)))
        n = np.bincount(np.searchsorted(self.parts[0][0], at), n, len(self.parts[0][0])).astype(np.int64)
        at, docs, _ = self.parts[0]
        names, langs = [k.rpartition(b"\0") for k in self.terms], {}
        lang_of = np.array([langs.setdefault(lang.decode(), len(langs)) for lang, _, _ in names], np.int32)
        term = at >> 32
        rows = []
        for k, own in sliced(bit(np.frombuffer(self.of, np.uint64))[term] // width):
            different, local = np.unique(term[own], return_inverse=True)
            packed = local.astype(np.int64) << 32 | at[own] & 0xFFFFFFFF
            rows.append((k, [*langs], [*self.sources], lang_of[different].tobytes(), b" ".join(names[t][2] for t in different), packed.tobytes(), docs[own].tobytes(), n[own].tobytes()))
        kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 5)
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in GATHERED_ROWS.split(", ")])


def kept_terms(cut: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, sources: array of (source, n)) for the terms in at least ``least`` documents of a language, n in all of a source."""
    kept = cut.sparkSession.sparkContext.broadcast(refine(cut, least))
    width = BITS // _slices(cut)
    columns = ["lang", "term", "source", "docs", "n"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Gathered()
        for batch in small_batches(batches, 1):
            lang, sources, source, vocabulary, doc, term, n = (batch.column(k)[0].as_py() for k in range(7))
            words = vocabulary.split()
            of = hashes(lang, words, None)
            source, doc, term, n = (np.frombuffer(x, np.int32) for x in (source, doc, term, n))
            living = np.flatnonzero(lives(kept.value, of))
            place = np.full(len(words), -1, np.int64)
            mark = lang.encode() + b"\0"
            place[living] = own.places(own.terms, (mark + words[k] for k in living), len(living))
            own.of.frombytes(of[living[place[living] >= len(own.of)]].tobytes())
            source = own.places(own.sources, iter(sources), len(sources))[source]
            place = place[term]
            own.add(place[place >= 0] << 32 | source[doc[place >= 0]], None, n[place >= 0])
            if own.held >= GATHERED // 2:
                yield from own.rows(width)
                own = Gathered()
        yield from own.rows(width)

    def merge(table: pa.Table) -> pa.Table:
        """A slice's terms with the sums of their sources, by the terms themselves."""
        parts = []
        for r in table.to_pylist():
            at, docs, n = (np.frombuffer(r[c], np.int64) for c in ("at", "docs", "n"))
            names, sources = pa.array(r["terms"].split(b" "), pa.binary()).cast(pa.string()), pa.array(r["sources"], pa.string())
            langs = pa.array(r["langs"], pa.string()).take(pa.array(np.frombuffer(r["lang"], np.int32)))
            term = pa.array(at >> 32)
            parts.append(pa.table([langs.take(term), names.take(term), sources.take(pa.array(at & 0xFFFFFFFF)), pa.array(docs), pa.array(n)], names=columns))
        all_ = pa.concat_tables(parts).group_by(columns[:3]).aggregate([("docs", "sum"), ("n", "sum")])
        all_ = all_.sort_by([(c, "ascending") for c in columns[:3]]).combine_chunks()
        fresh = np.ones(len(all_), bool)
        for c in columns[:2] if len(all_) > 1 else ():
            same = pc.equal(all_[c][1:], all_[c][:-1]).to_numpy(zero_copy_only=False)
            fresh[1:] = same == 0 if c == "lang" else fresh[1:] | (same == 0)
        first = np.flatnonzero(fresh)
        frequent = np.add.reduceat(all_["docs_sum"].to_numpy(), first) >= least
        all_ = all_.filter(pa.array(np.repeat(frequent, np.diff([*first, len(all_)]))))
        sizes = np.diff([*first, len(fresh)])[frequent]
        ends = np.cumsum(sizes)
        starts = pa.array(ends - sizes)
        struct = pa.StructArray.from_arrays([all_["source"].combine_chunks(), all_["n_sum"].combine_chunks()], ["source", "n"])
        return pa.table([all_["lang"].take(starts), all_["term"].take(starts), pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), struct)], names=["lang", "term", "sources"])

    dealt = cut.mapInArrow(gather, GATHERED_ROWS)
    return dealt.groupBy("slice").applyInArrow(merge, "lang string, term string, sources array<struct<source:string,n:bigint>>")


def shares(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / of), exact for any whole numbers of eight bytes."""
    small = n < FITTING
    out = 1 + SCALE * (np.where(small, n, 0) + 1) // of
    for k in np.argwhere(~small):
        at = tuple(k)
        out[at] = 1 + SCALE * (int(n[at]) + 1) // int(np.broadcast_to(of, n.shape)[at])
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def divergence(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of how the sources of each language differ from each other and from all of it.

    ``docs`` has text, lang and source, nulls in them counting as empty strings; other columns take no part,
    and rows that repeat count each time. Part ``pair`` holds each other source with the value summed over
    the kept terms, part ``term`` the first ``ranks`` terms that a source uses more than its language does.
    An empty table gives an empty result; a language without kept terms has pairs of value 0. A
    language may have 3e9 kept terms before sums leave eight bytes. The result has a row for each two
    sources of a language, so what is gathered for each source is smaller than it.
    """
    spark = docs.sparkSession
    cut = materialize(chunks(docs), "term-chunks", IN_FILE)
    kept = materialize(kept_terms(cut, least), "kept-terms")
    used = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("n"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = cut.select("lang", F.explode("sources").alias("source")).distinct().join(used, ["lang", "source"], "left").join(size, "lang", "left")
    held: dict[str, list[tuple[str, int, int]]] = {}
    for r in groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")).collect():
        held.setdefault(r["lang"], []).append((r["source"], r["n"], r["v"]))
    given = spark.sparkContext.broadcast({k: sorted(v) for k, v in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {lang: {s: k for k, (s, _, _) in enumerate(v)} for lang, v in given.value.items()}
        sums = {lang: np.zeros((len(v), len(v)), np.int64) for lang, v in given.value.items()}
        for batch in small_batches(batches, 2048):
            langs, words, of = (batch.column(k) for k in range(3))
            each = np.repeat(np.arange(batch.num_rows), np.diff(of.offsets.to_numpy()))
            entries = of.flatten()
            names, counts = entries.field(0).to_pylist(), entries.field(1).to_numpy()
            lang_of = langs.to_pylist()
            for lang in dict.fromkeys(lang_of):
                rows = np.flatnonzero(np.array([x == lang for x in lang_of]))
                line = np.full(batch.num_rows, -1)
                line[rows] = np.arange(len(rows))
                own = np.flatnonzero(line[each] >= 0)
                at = np.array([places[lang][names[k]] for k in own], np.int64)
                n = np.zeros((len(rows), len(places[lang])), np.int64)
                n[line[each[own]], at] = counts[own]
                total, v = np.array([x[1] for x in given.value[lang]]), given.value[lang][0][2]
                p, q = shares(n, total + v), shares(n.sum(axis=1), total.sum() + v)[:, None]
                for k in range(p.shape[1]):
                    sums[lang][:, k] += distance(p, p[:, k : k + 1]).sum(axis=0)
                row, source = np.nonzero((n > 0) & (p > q))
                value = distance(p, q)[row, source]
                sources = pa.array([x[0] for x in given.value[lang]], pa.string())
                yield pa.record_batch([pa.array([lang] * len(row), pa.string()), sources.take(pa.array(source)), pa.array(["term"] * len(row), pa.string()), words.take(pa.array(rows[row])), pa.array(value)], names=["lang", "source", "part", "item", "value"])
        for lang, total in sums.items():
            names = [x[0] for x in given.value[lang]]
            pairs = [(s, o, int(total[k, j])) for k, s in enumerate(names) for j, o in enumerate(names) if k != j]
            if pairs:
                source, item, value = zip(*pairs, strict=True)
                yield pa.record_batch([pa.array([lang] * len(pairs)), pa.array(source), pa.array(["pair"] * len(pairs)), pa.array(item), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    found = materialize(kept.mapInArrow(run, "lang string, source string, part string, item string, value long"), "divergence")
    none = [(lang, a[0], "pair", b[0], 0) for lang, v in held.items() for a in v for b in v if a[0] != b[0]]
    zero = spark.createDataFrame(none, "lang string, source string, part string, item string, value long")
    pairs = found.where("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = found.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(told)
