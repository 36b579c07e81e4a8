"""The queries that apply the operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, divergence, html_text, lexical, pii, quality, secrets, token_files, topk, toxicity, wordpiece
from .common import read
from .near_dedup import near_duplicates
from .oracle import oracle_sql

__all__ = ["oracle_sql", "queries", "vocabulary"]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(read(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.digests(token_files.read_ids(folder, files))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_html_main_text": op2_html_main_text,
        "op3_benchmark_leaks": op3_benchmark_leaks,
        "op4_token_counts": op4_token_counts,
        "op5_personal_data": op5_personal_data,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_token_files": op7_token_files,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_secret_scan": op10_secret_scan,
        "op11_quality": op11_quality,
        "op12_source_divergence": op12_source_divergence,
        "op13_ranked_search": op13_ranked_search,
    }
