"""The anonymisation plan: documents in, masked texts with their spans and tokens out, row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..operators import detect as D
from ..operators import normalise as N
from ..operators import resolve as R
from ..operators.sanitise import sanitise_columns


def prepared(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """NRM-7, NRM-8: adds ``was_normalised`` and ``prepared_text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flag = {"always": F.lit(True), "never": F.lit(False)}.get(options.normalise)
    df = docs.withColumn("was_normalised", N.is_damaged(text, options) if flag is None else flag).withColumn("prepared_text", text)
    if options.normalise != "never":
        for step in N.PASSES:
            df = df.withColumn("prepared_text", F.when(F.col("was_normalised"), step(F.col("prepared_text"))).otherwise(F.col("prepared_text")))
    return df.withColumn("prepared_text", N.preprocess(F.col("prepared_text")))


def detected(df: DataFrame, options: Options = Options(), extra: Column | None = None) -> DataFrame:
    """DET and SPN: adds ``detections``; extra are a model's spans in the prepared text (layer L2_gliner)."""
    text = F.col("prepared_text")
    df = df.withColumn("_l1", F.concat(*D.l1(text, options))).withColumn("_l2", F.concat(*D.heuristic(text, options))).withColumn("_l3", F.concat(*D.personal(text)))
    layers = [F.col("_l1"), F.col("_l2"), *([extra.cast(D.SPAN)] if extra is not None else []), F.col("_l3")]
    df = df.withColumn("_kept", R.dedupe_contained(R.union_layers(*layers)))
    df = df.withColumn("_all", F.concat("_kept", D.header_name(text, F.col("_kept"))))
    return df.withColumn("detections", R.dedupe_overlapping(F.col("_all"))).drop("_l1", "_l2", "_l3", "_kept", "_all")


def masked(df: DataFrame) -> DataFrame:
    """MSK: adds ``tokens`` (in order of assignment) and ``anonymised_text``."""
    return df.withColumn("tokens", R.assign_tokens(F.col("detections"))).withColumn("anonymised_text", R.splice(F.col("prepared_text"), F.col("tokens")))


def token_map(tokens: Column) -> Column:
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(t["token"], t["value"])))


def anonymise(docs: DataFrame, options: Options = Options(), extra: Column | None = None) -> DataFrame:
    """MSK-3: adds was_normalised, prepared_text, detections, tokens and anonymised_text to documents with a ``text``."""
    return masked(detected(prepared(docs, options), options, extra))


def sanitise(anonymised: DataFrame) -> DataFrame:
    """Adds ``sanitised_text``."""
    df = anonymised.withColumn("_map", token_map(F.col("tokens")))
    return sanitise_columns(df, "anonymised_text", F.col("_map"), "sanitised_text").drop("_map")
