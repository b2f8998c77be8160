"""Corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns
of ``documents``.  ``run`` writes each stage's rows as Parquet to the shared folder and rereads
them as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm.common import free_prefix, materialise
from sparkveil.llm.decontaminate import find_leaks
from sparkveil.llm.language_id import held_out, label_rows, train
from sparkveil.llm.near_copies import near_copies
from sparkveil.llm.packing import pack_documents
from sparkveil.llm.pii import find_pii_columns, redact
from sparkveil.llm.queries import table, tokenizer_path

#: Least share of letters under the predicted language; texts below it are no language's.
MIN_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of too mixed a one, go.

    Null and empty texts and texts without letters have no language and go; rows alike stay or go
    together; with no labelled row to learn from no text has a language.
    """
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    own = free_prefix(docs, "_lang_")
    return label_rows(docs, model, prefix=own).filter((F.col(own + "pred") != "und") & (F.col(own + "score") >= MIN_SHARE)).select(*docs.columns)


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a key of each row, and writes it with the rows: doc_id may be null or repeated.  Also its name, which no column has."""
    name = free_prefix(docs, "_row")
    return materialise(docs.withColumn(name, F.monotonically_increasing_id())), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id.

    Near copies are linked by an exact similarity of 0.8 or more over five-word shingles;
    fingerprints and min-hashes only propose.  Rows count one by one: of rows alike, with one id or
    none, one stays, of equal ids any; null texts and texts without words are copies of each other;
    a row with a null id stays only if no copy has an id.
    """
    keyed, key = with_key(docs)
    groups = near_copies(keyed.select(F.col(key).alias("row"), F.col("text").cast("string").alias("text")))
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    ranked = groups.join(ids, "row").select("row", "root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("rank"))
    least = ranked.groupBy("root").agg(F.min("rank").alias("least"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("least.row").alias("kept"))
    gone = ranked.join(materialise(least), "root").filter("row <> kept").select(F.col("row").alias(key))
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, row by row; null and empty texts hold none; an empty benchmark removes nothing."""
    keyed, key = with_key(docs)
    leaks = find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; every row stays, null texts stay null; n_chars, if there, follows."""
    own = free_prefix(docs, "_own_")
    text, spans = own + "text", own + "spans"
    found = find_pii_columns(docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))), text, spans)
    clean = F.when(F.col("text").isNull(), F.lit(None)).otherwise(redact(F.col(text), F.col(spans)))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into sequences of 4096 tokens; a null or empty text is one piece, the end id."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
