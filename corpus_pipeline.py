"""A pipeline from documents to token ids: toxic documents go, one of each group of near copies stays,
documents with benchmark passages go, secrets are blotted out, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import byte_bpe, decontaminate, near_dedup, secrets, toxicity
from scorewright.llm.common import materialize, read
from scorewright.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under a half; learned from the rows of ``docs`` and labels that aren't held out."""
    labels = read(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of similarity 0.8 on five-word shingles."""
    return near_dedup.without_copies(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): the byte-level ids, and digests of them and of what they decode to."""
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN), F.col("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", blot_secrets),
    ("byte_bpe", encode),
]

#: SQL can't express the learned, similarity and encoding stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``, each on the written output of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
