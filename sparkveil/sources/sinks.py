"""Sinks (SNK-1 to SNK-3): datasets keyed by document; the map of tokens is kept apart from the texts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexlib import exploded
from ..operators.records import envelope, failures, per_document

RECORD = ("candidate_fingerprint", "source_file", "quality", "was_normalised", "processed_at", "pipeline_version", "pii_fields")
LOG = ("candidate_fingerprint", "source_file", "processed_at", "total_detections", "by_layer", "by_entity_type", "low_confidence_flags", "detection_log")


def write_run(results: DataFrame, directory: str, config_hash: str = "00000000", batch_id: str = "", dry_run: bool = False, started_at: datetime | None = None, per_document_texts: bool = False) -> DataFrame:
    """Write records, logs, masked and sanitised texts, token maps and the summary; returns the summary.

    Results are the output of the whole plan, written once as Parquet and reread, so that the
    plan runs once; a dry run writes nothing.  per_document_texts also writes the two texts of
    each document in a folder of its own, for batches that people read.
    """
    started_at = started_at or datetime.now(timezone.utc)
    if dry_run:
        return envelope(results, batch_id, config_hash, started_at)
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(f"{directory}/results")
    kept = spark.read.parquet(f"{directory}/results")
    good = kept.filter("error is null")
    good.select("doc_key", *RECORD).write.mode("overwrite").json(f"{directory}/pii_record")
    good.select("doc_key", *LOG).write.mode("overwrite").json(f"{directory}/detection_log")
    good.select("doc_key", "anonymised_text").write.mode("overwrite").parquet(f"{directory}/anonymised")
    good.select("doc_key", "sanitised_text").write.mode("overwrite").parquet(f"{directory}/sanitised")
    exploded(good, "tokens", "t", "doc_key").select("doc_key", "t.token", "t.value").write.mode("overwrite").parquet(f"{directory}/token_map")
    failures(kept).write.mode("overwrite").json(f"{directory}/failures")
    per_document(kept).write.mode("overwrite").json(f"{directory}/per_document")
    if per_document_texts:
        stem = F.regexp_replace("source_file", r"\.[^.]+$", "")
        for name in ("anonymised", "sanitised"):
            good.select(F.col(f"{name}_text").alias("value"), stem.alias("document")).write.mode("overwrite").partitionBy("document").text(f"{directory}/documents/{name}")
    out = envelope(kept, batch_id, config_hash, started_at)
    out.write.mode("overwrite").json(f"{directory}/batch_summary")
    return out
