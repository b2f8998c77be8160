"""Connected components of an edge list, by alternating large-star and small-star rounds.

The links never leave the executors.  Each round is two grouped minima (combined before the
shuffle) and joins whose hot side Spark's skew handling may split; rounds grow with the
logarithm of the longest chain.  Every round is written to the shared folder, so a lost
executor costs no more than one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

#: Edges that one step of the local contraction holds: a bound on memory, not on the result.
CHUNK = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) with the components of the given edges."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(nxt := label[label], label):
            label = nxt
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def out():
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held >= CHUNK:
                yield out()
                us, vs, held = [], [], 0
        if held:
            yield out()

    return map_batches(edges.select("u", "v"), run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # nodes without a larger neighbour keep the link to their least one
        rest = least.filter("m < u").select("u", F.col("m").alias("v"))
        return joined.union(rest).filter("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node with a link; root is the least node of its component."""
    now = materialise(_contract(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct())
    for _ in range(max_rounds):
        # It is done when every node has one link and no root has one of its own.
        state = now.groupBy("u").agg(F.count("*").alias("n"))
        if not state.filter("n > 1").limit(1).count() and not now.join(state.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        now = materialise(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
