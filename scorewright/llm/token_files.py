"""Token ids in files of independent zstandard frames, one for each document, with a seek table at the end.

A file holds, in ascending order of doc_id, one frame for each document with its ids as little-endian
integers of 2 bytes (4 where the vocabulary needs them) and a checksum; then a skippable frame with
the doc_ids and that number of bytes; then the seek table of zstandard's seekable format: for each frame its compressed and
its decompressed size and a checksum of what it holds. A reader that knows a file's name reads the
table and then decompresses just the frames of the documents that it wants.
"""

from __future__ import annotations

import os
import re
import string
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_path, materialize, small_batches, texts_of

#: Numbers of zstandard's seekable format (fixed values).
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_END = 0x8F92EAB1
CHECKSUMS = 0x80
#: Stands for a null doc_id in a file.
NO_ID = -(2**63)
#: Documents that one row of a read plan asks for.
AT_ONCE = 2000


class ChunkIds(dict):
    """Ids of a text's chunks, as bytes; remembered up to a bound of chunks and of their characters.

    Chunks end at blanks and line feeds, which neither a token nor the tokenizer's normal form reaches
    across. A new chunk is cut further before ASCII punctuation, but only after letters and digits that
    the tokenizer itself parts from it; letters that it turns into one with a mark are none of them.
    """

    #: Without apostrophes, dashes and the marks that special tokens are written with (fixed values).
    PUNCTUATION = ".,;:!?*$%&#"
    #: Below this code point letters and digits are tried; other scripts are cut at white space alone.
    TRIED = 0x530

    def __init__(self, vocabulary: str, most: int = 800_000, most_chars: int = 16_000_000) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.most, self.most_chars, self.chars = most, most_chars, 0
        self.tokenizer = Tokenizer.from_file(vocabulary)
        # strings of added tokens in a text are these tokens, as the library has it; what holds one is left to it whole
        added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()} - {""}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.signed = not any(t.isalnum() for t in added)  # so that a word of letters and digits holds none
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a mark between chunks that is one token, so that many are encoded at once
        alone = ((c, self.encoded(c)) for c in "~^_@\u00a7")
        self.mark, self.mark_id = next(((c, ids[0]) for c, ids in alone if len(ids) == 1), (None, -1))
        tried = [c for c in map(chr, range(self.TRIED)) if c.isalnum()]
        apart = "".join(c for c in tried if self.parts(c + ".")[-1:] == ["."])
        self.cut = re.compile(f"(?<=[{apart}])(?=[{re.escape(self.PUNCTUATION)}])") if apart else None
        # letters that the tokenizer leaves together: what it turns each into goes to its model as it is
        self.letters = {ord(c): self.parts(c)[0] for c in apart if c.isalpha() and len(self.parts(c)) == 1}
        together = "".join(map(chr, self.letters))
        if not {*map(ord, string.ascii_letters)} <= self.letters.keys() or self.parts(together * 2) != [together.translate(self.letters) * 2]:
            self.letters, together = {}, "a"
        self.word = re.compile(f"[{together}]+")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def parts(self, text: str) -> list[str]:
        """What the tokenizer itself takes a text apart into before it looks for tokens."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [part for part, _ in cutter.pre_tokenize_str(text)] if cutter else [text]

    def chunks(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Makes sure that all of ``chunks`` are known; what was known before may be forgotten for them."""
        new = [c for c in chunks if c not in self]
        if len(self) + 2 * len(new) > self.most or self.chars > self.most_chars:
            self.clear()
            self.chars, new = 0, list(chunks)
        special = {c for c in new if not (self.signed and c.isalnum()) and self.added.search(c.lower())} if self.added else set()
        for chunk in special:
            self[chunk] = np.array(self.encoded(chunk), self.kind).tobytes()
        new = [c for c in new if c not in special] if special else new
        more = [c for c in new if not c.isalnum()] if self.cut else []
        cut = [*map(self.cut.split, more)] if more else []
        stems = {c for c in new if c.isalnum()}.union(*cut) if self.cut else new
        self._encode([c for c in stems if c not in self])
        for chunk, parts in zip(more, cut, strict=True):
            if len(parts) > 1:
                self[chunk] = b"".join(map(self.__getitem__, parts))
        self.chars += sum(map(len, new))

    def _encode(self, stems: list[str]) -> None:
        plain = [c for c in stems if c.isascii() and c.isalpha()] if self.mark and self.letters else []
        others = [c for c in stems if not (c.isascii() and c.isalpha())] if plain else stems
        alone = [c for c in others if self.mark is None or self.mark in c]
        words = [c for c in others if self.mark and self.mark not in c and self.letters and self.word.fullmatch(c)]
        rest = {*others}.difference(alone, words)
        for stem in alone:
            self[stem] = np.array(self.encoded(stem), self.kind).tobytes()
        for many, letters in ((plain, True), (words, True), ([*rest], False)):
            for at in range(0, len(many), 500):
                own = many[at : at + 500]
                joined = f" {self.mark} ".join(own)
                if letters:
                    ids = self.model.encode_batch_fast([joined.translate(self.letters)], add_special_tokens=False)[0].ids
                else:
                    ids = self.encoded(joined)
                ids = np.array(ids, self.kind)
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * self.kind.itemsize
                raw, start = ids.tobytes(), 0
                for stem, end in zip(own, ends.tolist(), strict=True):
                    self[stem] = raw[start:end]
                    start = end + self.kind.itemsize


@lru_cache(maxsize=1)
def _known(vocabulary: str) -> ChunkIds:
    """A worker's own; it outlives a task where workers are used again."""
    return ChunkIds(vocabulary)


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a place; Hadoop's names of S3 count as S3."""
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _writer(vocabulary: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        store, path = _store(folder)
        known = _known(vocabulary)
        end = np.array([end_id], known.kind).tobytes()
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        own, final = f"{path}/.{part:06d}-{context.taskAttemptId()}", f"{path}/{part:06d}.ids"
        ids, table = [], bytearray()
        count = 0
        store.create_dir(path, recursive=True)
        with store.open_output_stream(own) as out:
            for batch in small_batches(batches, 256):
                ids += batch.column(0).to_pylist()
                chunks = [*map(known.chunks, texts_of(batch))]
                known.learn(set().union(*chunks))
                for c in chunks:
                    raw = b"".join(map(known.__getitem__, c)) + end
                    count += len(raw) // known.kind.itemsize
                    frame = pack.compress(raw)
                    out.write(frame)
                    table += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            names = np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()
            out.write(struct.pack("<II", SKIPPABLE_IDS, len(names) + 1) + names + bytes([known.kind.itemsize]))
            table += struct.pack("<IBI", len(ids), CHECKSUMS, SEEKABLE_END)
            out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + bytes(table))
        if ids:
            store.move(own, final)
            yield pa.record_batch([pa.array([f"{part:06d}.ids"]), pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([count], pa.int64())], names=["file", "part", "n_docs", "n_ids"])
        else:
            store.delete_file(own)

    return run


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the ids of every text; (folder, table of the files: file, part, n_docs, n_ids).

    The documents are dealt out by ranges of doc_id and sorted within them; the files in the order of
    their names hold ascending doc_ids, null ones first. Rows that repeat a doc_id are in the order
    of their texts. A null or empty text is just the end id. A task writes under a name of its own
    and renames the file when it is whole, so one that is run again leaves the same file.
    """
    folder = folder or fresh_path(docs.sparkSession, "ids")
    dealt = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = dealt.mapInArrow(_writer(vocabulary, end_id, folder), "file string, part int, n_docs long, n_ids long")
    return folder, materialize(done, "id-files")


class Reader:
    """Random access to one file; reads its tail first and then only what is asked for."""

    def __init__(self, uri: str) -> None:
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_END or flags != CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        tail = self._at(size - 9 - 12 * n - 8 - 8 * n - 1, 20 * n + 9)
        width = tail[8 * n]
        table = np.frombuffer(tail[8 * n + 9 :], "<u4").reshape(n, 3)
        self.kind = np.dtype(f"<u{width}")
        self.doc_ids = np.frombuffer(tail[: 8 * n], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(table[:, 1].astype(np.int64) // width)])
        self.places = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        self.sums = table[:, 2]
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of the documents at positions ``first`` to ``last``, the latter left out."""
        raw = memoryview(self._at(self.places[first], self.places[last] - self.places[first]))
        for k in range(first, last):
            body = self.unpack.decompress(raw[self.places[k] - self.places[first] : self.places[k + 1] - self.places[first]])
            if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k}: its checksum differs")
            yield np.frombuffer(body, self.kind)


def _reading(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:  # the rows of a file come one after the other, so its tail is read once
                    name, reader = row["file"], Reader(f"{folder}/{row['file']}")
                first, last = row["first"], min(row["first"] + AT_ONCE, len(reader))
                for at in range(first, last, 250):
                    to = min(at + 250, last)
                    names = [None if i == NO_ID else i for i in reader.doc_ids[at:to].tolist()]
                    yield pa.record_batch(
                        [pa.array(names, pa.int64()), pa.array(reader.starts[at:to] + row["base"]), pa.array([x.astype("<u4").tobytes() for x in reader.ids(at, to)], pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return run


def read_ids(folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in ``files``; ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. The files' totals are summed on the driver:
    a row for each file. The files are read in pieces of AT_ONCE documents, dealt out over as many tasks
    as there are files.
    """
    spark = files.sparkSession
    base, plan = 0, []
    for row in sorted(files.collect(), key=lambda r: r["part"]):
        plan.append((row["file"], base, row["n_docs"]))
        base += row["n_ids"]
    asked = spark.createDataFrame(plan, "file string, base long, n_docs long")
    asked = asked.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(AT_ONCE).cast("long"))).alias("first"))
    dealt = asked.repartitionByRange(max(len(plan), 1), "file", "first").sortWithinPartitions("file", "first")
    return dealt.mapInArrow(_reading(folder), "doc_id long, start long, ids binary")


def digests(ids: DataFrame) -> DataFrame:
    """Number of ids and their unsigned CRC-32."""
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
