"""Command line (CLI-1): a folder of documents in, a run's datasets out.  Exit 0 ok, 1 any failure, 2 bad input."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Options, config_hash
from .operators import models as M
from .operators.records import records
from .plans import engine as E
from .session import attach
from .sources.documents import SUFFIXES, read_folder
from .sources.sinks import write_run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkveil")
    p.add_argument("--input", default="./input")
    p.add_argument("--output", default="./output")
    p.add_argument("--config", default="config/settings.yaml")
    p.add_argument("--normalise", choices=["auto", "always", "never"])
    p.add_argument("--ner", choices=["heuristic", "gliner"], default="heuristic")
    p.add_argument("--gliner-model", default="urchade/gliner_multi_pii-v1")
    p.add_argument("--gliner-path")
    p.add_argument("--llm-verify", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--ollama-url", default="http://localhost:11434")
    p.add_argument("--ollama-model", default="llama3.1:8b")
    p.add_argument("--confidence-threshold", type=float)
    p.add_argument("--workers", type=int, default=min(4, os.cpu_count() or 1))
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--per-document", action="store_true", help="also write the texts in a folder for each document")
    return p


def process(docs: DataFrame, options: Options, ner: str = "heuristic", model: str = "", ask=None) -> DataFrame:
    """The whole plan over documents: masked, verified (optional), sanitised, with records; failed ones keep their error."""
    df = docs.withColumn("error", F.when(F.col("error").isNull() & (F.col("quality") < options.minimum_quality), "quality below the minimum").otherwise(F.col("error")))
    df = df.withColumn("stage", F.when(F.col("error").isNotNull(), "extraction"))
    df = E.prepared(df, options)
    extra = None
    if ner == "gliner":
        df = M.with_model_spans(df, "prepared_text", M.hub_model(model))
        extra = F.col("model_spans")
    df = E.masked(E.detected(df, options, extra))
    if ask is not None:
        df = M.merge_verified(M.with_verified_spans(df, ask))
    return records(E.sanitise(df), options.confidence_threshold)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    folder = Path(args.input)
    if not folder.is_dir() or not any(f.suffix.lower().lstrip(".") in SUFFIXES for f in folder.rglob("*")):
        print(f"no documents in {folder}", file=sys.stderr)
        return 2
    options = Options.load(args.config)
    options = replace(options, **{k: v for k, v in {"normalise": args.normalise, "confidence_threshold": args.confidence_threshold}.items() if v is not None})
    spark = attach(SparkSession.builder.master(f"local[{args.workers}]").appName("sparkveil").getOrCreate())
    ask = M.ollama_client(args.ollama_url, args.ollama_model) if args.llm_verify else None
    results = process(read_folder(spark, str(folder)), options, args.ner, M.model_path(args.gliner_path, args.gliner_model), ask)
    started = datetime.now(timezone.utc)
    row = write_run(results, f"{args.output}/run_{started:%Y%m%d_%H%M%S}", config_hash(args.config), f"batch_{started:%Y%m%d_%H%M%S}", args.dry_run, started, args.per_document).first()
    if not args.quiet:
        print(f"{row['documents_processed']} of {row['documents_total']} documents, {row['total_pii_detected']} spans, {row['documents_failed']} failures, {row['duration_seconds']} s")
        for kind, n in sorted(row["by_entity_type_total"].items()):
            print(f"  {kind}: {n}")
    return int(row["documents_failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
