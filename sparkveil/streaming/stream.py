"""The same plan on a stream of documents: it works row by row, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Options
from ..plans.engine import anonymise, sanitise


def anonymise_stream(docs: DataFrame, options: Options = Options()) -> DataFrame:
    return sanitise(anonymise(docs, options))


def write_stream(docs: DataFrame, path: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Append masked texts as Parquet, exactly once by the checkpoint."""
    out = anonymise_stream(docs, options).select("doc_key", "anonymised_text", "sanitised_text")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
