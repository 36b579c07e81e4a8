"""Byte-level BPE encoding and decoding by a sentencepiece model that is written straight from a rank file.

Each byte of a pre-token becomes one printable character; the model's pieces are the rank file's byte
strings mapped so, in the order of their ranks and scored by the negative rank. Sentencepiece joins
the best-scored neighbours first, leftmost on a tie, which is the merge order of the ranks. The model
normalises nothing, so that the mapped characters reach the merges as they are.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, texts_of


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank; the ranks must run from 0 without a gap."""
    with open(path, "rb") as lines:
        by_rank = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError(f"{path}: the ranks have gaps")
    return [by_rank[k] for k in range(len(by_rank))]


def _varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the id after the last one is for unknown characters."""
    characters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    # trainer: BPE, size of the vocabulary, ids of unk, bos, eos, pad; normaliser: its name, then what it would add, remove and escape
    out += _block(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Encoder(dict):
    """Ids of pre-tokens, remembered up to a bound of their number and of their characters together."""

    def __init__(self, tokens: list[bytes], most: int = 400_000, most_characters: int = 8_000_000) -> None:
        super().__init__()
        self.most, self.most_characters, self.held = most, most_characters, 0
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.characters = dict(enumerate(byte_characters()))

    def learn(self, pieces: set[str]) -> None:
        """Encode those of ``pieces`` that aren't known; a pre-token that is itself a token is that token."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.most or self.held + sum(map(len, new)) > self.most_characters:
            self.clear()
            self.held, new = 0, list(pieces)
        self.held += sum(map(len, new))
        rest = []
        for p in new:
            raw = p.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                self[p] = (rank,)
            else:
                rest.append((p, raw.decode("latin-1").translate(self.characters)))
        for (p, _), ids in zip(rest, self.model.encode([m for _, m in rest], num_threads=1), strict=True):
            self[p] = tuple(ids)


@lru_cache(maxsize=1)
def _known(ranks: str) -> tuple[list[bytes], Encoder]:
    """A worker's own tokens and encoder; they outlive a task where workers are used again."""
    tokens = read_ranks(ranks)
    return tokens, Encoder(tokens)


def _encoding(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, encoder), split = _known(ranks), regex.compile(pattern).findall
        for batch in small_batches(batches, 128):
            pieces = [split(t) for t in texts_of(batch)]
            encoder.learn(set().union(*pieces))
            ids = [np.fromiter(chain.from_iterable(map(encoder.__getitem__, p)), np.int32) for p in pieces]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _decoding(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _known(ranks)
        for batch in small_batches(batches, 128):
            ids = batch.column(1)
            each = [tokens[k] for k in ids.flatten().to_numpy().tolist()]
            ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())]).tolist()
            raw = [b"".join(each[a:b]) for a, b in pairwise(ends)]
            yield pa.record_batch([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids: array of int) for each row of ``docs`` (doc_id, text).

    ``ranks`` is the path of a rank file that every machine has, ``pattern`` splits a text into
    pre-tokens, which are encoded one by one. A null or empty text has no ids; null or repeated
    doc_ids stay as they are; extra columns of ``docs`` are left out.
    """
    return documents(docs).mapInArrow(_encoding(ranks, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that the ids stand for, as ``decoded``; null ids as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(ranks), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) as by ``encode`` and then ``decode``, in one worker for each task rather than two."""
    there, back = _encoding(ranks, pattern), _decoding(ranks)
    return documents(docs).mapInArrow(lambda batches: back(there(batches)), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *also: Column) -> DataFrame:
    """Number of ids and SHA-256 of the ids, comma-joined, and of the decoded bytes; before them what else is asked for."""
    return decoded.select(
        "doc_id",
        *also,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
