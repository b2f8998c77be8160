"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import attach

#: White space that separates words: space and the controls 9 to 13, as bytes.split() has it.
WORD_RE = r"[^\x20\x09-\x0D]+"


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads; other columns, whatever their names, never reach it."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    attach(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); set to a local one only where the session names none, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = "file:///tmp/sparkveil-checkpoints"
        spark.sparkContext.setCheckpointDir(got)
    return got


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkveil-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha256(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (int(n) - 1).bit_length())
        base = int(_M)
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("up", base), ("down", inverse)):
            out = np.ones(size, np.uint64)
            step, m = 1, b
            while step < size:  # doubling: out[step:2*step] = out[:step] * b**step
                out[step : 2 * step] = out[:step] * np.uint64(m)
                m = m * m % (1 << 64)
                step *= 2
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substring of a sequence of 64-bit symbols, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """A hash of each window of k symbols."""
        d = self.sums[k:] - self.sums[:-k]
        return mix(d * self.down[: len(d)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        d = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(d ^ (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def leftmost_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """For each window of w keys the place of its least key, the leftmost at ties; keys count by their upper 32 bits."""
    n = len(keys)
    packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = packed
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching spans that cover the same places."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """A prefix, the given one or longer, with which no column's name begins, in whatever case."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
