"""Per-document records, logs and batch aggregates (REC, LOG, AGG)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VERSION
from ..functions.lexicons import TOKEN_TYPES
from ..functions.regexlib import exploded, let, strip


def pii_fields(detections: Column) -> Column:
    """REC-1: struct<full_name, emails, phones, linkedin>, distinct values in order of detection."""

    def values(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter(detections, lambda d: d["entity_type"] == kind), lambda d: strip(d["text"])))

    linked = F.filter(values("URL"), lambda v: F.lower(v).contains("linkedin"))
    name = F.try_element_at(values("PERSON"), F.lit(1))
    return F.struct(
        strip(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]+", " ")).alias("full_name"),
        values("EMAIL").alias("emails"),
        values("PHONE").alias("phones"),
        F.try_element_at(linked, F.lit(1)).alias("linkedin"),
    )


def fingerprint(fields: Column, source_file: Column) -> Column:
    """REC-2: of the sorted e-mail addresses and phone numbers, or of the file's name without any."""
    emails = F.array_join(F.array_sort(F.transform(fields["emails"], lambda e: strip(F.lower(e)))), "")
    phones = F.array_join(F.array_sort(F.transform(fields["phones"], strip)), "")
    seed = F.concat(emails, phones)
    return F.sha2(F.when(strip(seed) == "", source_file).otherwise(seed), 256)


def resolved_confidence(d: Column) -> Column:
    """LOG-1."""
    return F.coalesce(d["confidence"], F.when(d["layer"] == "L1_pattern", 0.99).otherwise(0.75))


def logged(detections: Column, tokens: Column) -> Column:
    """LOG-1, LOG-2: detections with a confidence and the first token that stands for their text."""
    values = F.transform(tokens, lambda t: t["value"])
    return let(
        values,
        lambda v: F.transform(
            detections,
            lambda d: F.struct(
                d["entity_type"], d["text"], d["start"], d["end"], d["layer"], resolved_confidence(d).alias("confidence"),
                F.try_element_at(tokens, F.nullif(F.array_position(v, d["text"]).cast("int"), F.lit(0)))["token"].alias("token_replacement"),
            ),
        ),
    )


def low_confidence(entries: Column, threshold: float) -> Column:
    """LOG-3."""
    return F.transform(
        F.filter(entries, lambda d: d["confidence"] < threshold),
        lambda d: F.struct(d["entity_type"], d["text"], d["confidence"], F.lit("Below confidence threshold").alias("reason")),
    )


def layer_counts(detections: Column, was_normalised: Column) -> Column:
    """LOG-4: personal facts are in no layer's count."""

    def n(*layers: str) -> Column:
        return F.size(F.filter(detections, lambda d: d["layer"].isin(*layers)))

    no_indicators = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.struct(
        F.struct(was_normalised.alias("applied"), no_indicators.alias("damage_indicators")).alias("L0_normaliser"),
        n("L1_pattern").alias("L1_pattern"),
        n("L2_ner", "L2_gliner", "L0_header").alias("L2_ner"),
        n("L3_llm_verify").alias("L3_llm_verify"),
    )


def entity_counts(detections: Column) -> Column:
    """LOG-5 within a row."""
    kinds = F.transform(detections, lambda d: d["entity_type"])
    return F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))


def records(anonymised: DataFrame, threshold: float = 0.85, processed_at: datetime | None = None) -> DataFrame:
    """REC and LOG columns of every document that was processed."""
    when = F.lit(processed_at) if processed_at else F.current_timestamp()
    df = anonymised.withColumn("pii_fields", pii_fields(F.col("detections")))
    df = df.withColumn("candidate_fingerprint", fingerprint(F.col("pii_fields"), F.col("source_file")))
    df = df.withColumn("detection_log", logged(F.col("detections"), F.col("tokens")))
    df = df.withColumn("low_confidence_flags", low_confidence(F.col("detection_log"), threshold))
    return df.withColumns(
        {
            "by_layer": layer_counts(F.col("detections"), F.col("was_normalised")),
            "by_entity_type": entity_counts(F.col("detections")),
            "total_detections": F.size("detections"),
            "low_confidence_count": F.size("low_confidence_flags"),
            "processed_at": when,
            "pipeline_version": F.lit(VERSION),
        }
    )


def detections_table(anonymised: DataFrame) -> DataFrame:
    """One row for each detection, with confidence and token."""
    rows = exploded(anonymised, logged(F.col("detections"), F.col("tokens")), "d", "doc_key")
    return rows.select("doc_key", "d.*")


def counts_by_type(detections: DataFrame) -> DataFrame:
    """LOG-5, AGG-4: partial sums before the shuffle."""
    return detections.groupBy("entity_type").agg(F.count("*").alias("n"))


def batch_summary(results: DataFrame, batch_id: str = "", config_hash: str = "00000000", started_at: datetime | None = None, *more: Column) -> DataFrame:
    """AGG-1 to AGG-3: one row of counts."""
    good = F.col("error").isNull()
    row = results.agg(
        F.count("*").alias("documents_total"),
        F.count_if(good).alias("documents_processed"),
        F.count_if(~good).alias("documents_failed"),
        F.round(F.coalesce(F.avg(F.when(good, F.col("quality"))), F.lit(0.0)), 4).alias("average_extraction_quality"),
        F.count_if(good & F.col("was_normalised")).alias("ocr_damaged_count"),
        F.coalesce(F.sum(F.when(good, F.col("low_confidence_count"))), F.lit(0)).alias("low_confidence_review_required"),
        F.coalesce(F.sum(F.when(good, F.col("total_detections"))), F.lit(0)).alias("total_pii_detected"),
        *more,
    )
    return row.select(F.lit(batch_id).alias("batch_id"), F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(VERSION).alias("pipeline_version"), F.lit(config_hash).alias("config_hash"), *row.columns)


def envelope(results: DataFrame, batch_id: str, config_hash: str, started_at: datetime) -> DataFrame:
    """AGG-4, AGG-6: the summary with the sums by type, the time of its end and its duration, in one pass; failures and per-document rows are tables beside it, as they grow with the batch."""
    good = F.col("error").isNull()
    sums = [F.struct(F.lit(t).alias("kind"), F.sum(F.when(good, F.try_element_at("by_entity_type", F.lit(t)))).alias("n")) for t in TOKEN_TYPES]
    by_type = F.map_from_entries(F.filter(F.array(*sums), lambda x: x["n"] > 0)).alias("by_entity_type_total")
    finished = F.current_timestamp()
    return (
        batch_summary(results, batch_id, config_hash, started_at, by_type)
        .withColumn("finished_at", finished)
        .withColumn("duration_seconds", F.round(finished.cast("double") - F.col("started_at").cast("double"), 2))
    )


def failures(results: DataFrame) -> DataFrame:
    return results.filter("error is not null").select(F.col("source_file").alias("file"), "stage", "error")


def per_document(results: DataFrame) -> DataFrame:
    """AGG-5: rows by file name."""
    columns = [F.col("source_file").alias("file"), F.col("candidate_fingerprint").alias("fingerprint"), F.col("quality").alias("extraction_quality"), "was_normalised", "total_detections", "low_confidence_count"]
    return results.filter("error is null").select(*columns).orderBy("file")
