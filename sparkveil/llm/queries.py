"""The thin ``opN_<name>`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import ORACLE as CHAT_SQL
from .chat_format import formatted_digest
from .decontaminate import find_leaks
from .language_id import predict_languages
from .packing import pack_documents
from .pii import BASE, PATTERNS, find_pii, listed, of_kinds
from .quality import ORACLE as QUALITY_SQL
from .quality import quality
from .simhash import simhash_components
from .substring_dedup import ORACLE as PASSAGES_SQL
from .substring_dedup import remove_passages
from .suffix_dedup import remove_repeats
from .token_files import token_documents


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the files are never copied into the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted_digest(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_pii(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    counts = [F.size(of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in BASE]
    more = [F.size(of_kinds(F.col("spans"), (kind,))).cast("long").alias(f"n_{kind}") for kind in PATTERNS if kind not in BASE]
    return got.select("doc_id", *counts, F.sha2(listed(of_kinds(F.col("spans"), BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("cleaned", "n_failed_lines")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_passages(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_language_id": op2_language_id,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_token_files": op5_token_files,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_pii": op7_pii,
        "op8_quality": op8_quality,
        "op9_packing": op9_packing,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT_SQL, "op8_quality": QUALITY_SQL, "op10_substring_dedup": PASSAGES_SQL}
