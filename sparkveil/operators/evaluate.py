"""Recall of detections against expected items (EVL-1 to EVL-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexlib import strip

# A category of expected items and the types of spans that count for it.
CATEGORY_TYPES = {
    "PERSON": ["PERSON"], "EMAIL": ["EMAIL"], "PHONE": ["PHONE"], "URL": ["URL"], "ADDRESS": ["ADDRESS"], "ORG": ["ORG", "URL"], "LOCATION": ["LOCATION"],
    "DOB": ["DOB"], "ID_NUMBER": ["AL_NID", "PASSPORT", "ID_NUMBER"], "PERSONAL_FACT": ["MARITAL", "GENDER", "RELIGION", "FAMILY"],
}
OVERLAP = 0.70
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """EVL-1: lower case, stripped, accents and other signs outside ASCII dropped."""
    return F.regexp_replace(F.translate(strip(F.lower(text)), ACCENTED, PLAIN), r"[^\x00-\x7f]", "")


def overlap(expected: Column, found: Column) -> Column:
    """EVL-2: share of the words of an expected item that a found text holds (both folded)."""
    words = F.filter(F.split(expected, r"\W+"), lambda w: w != "")
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: found.contains(w))) / F.size(words))


def matches(expected: Column, found: Column) -> Column:
    """EVL-3: one holds the other, or enough words are shared."""
    return found.contains(expected) | expected.contains(found) | (overlap(expected, found) >= OVERLAP)


def found_items(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Truth (stem, category, expected) with ``found``; detections are (stem, entity_type, text).

    Items meet the detections of their document only; types join the small table of categories.
    """
    spark = truth.sparkSession
    kinds = spark.createDataFrame([(c, t) for c, ts in CATEGORY_TYPES.items() for t in ts], "category string, entity_type string")  # a table of fixed size
    items = truth.withColumn("_e", fold(F.col("expected")))
    got = detections.select("stem", "entity_type", fold(F.col("text")).alias("_f")).join(F.broadcast(kinds), "entity_type").select("stem", "category", "_f").distinct()
    hits = items.join(got, ["stem", "category"]).filter(matches(F.col("_e"), F.col("_f"))).select("stem", "category", "expected").distinct()
    return truth.join(hits.withColumn("found", F.lit(True)), ["stem", "category", "expected"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recall_report(items: DataFrame) -> DataFrame:
    """EVL-5: recall by category and document, by category, and overall."""
    return items.rollup("category", "stem").agg(F.count("*").alias("expected_items"), F.count_if("found").alias("found_items")).withColumn("recall", F.round(F.col("found_items") / F.col("expected_items"), 4))
