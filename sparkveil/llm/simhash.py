"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint has 64 bits: eight bytes.  Two fingerprints that differ in at most d bits share
at least 8 - d of their positional bytes, the guaranteed minimum of the count filter, and at
least 4 - d of the four pairs of neighbouring bytes.  Every fingerprint is posted under each
choice of so many pairs (six lists for d = 2), so that fingerprints which reach the minimum meet
in a list.  In a list the shared positional bytes are tallied for each pair, pairs below the minimum
go, and the others are verified by the number of differing bits.

A list that is longer than ``LIST`` is posted again under each choice of d of its free bytes. Those
lists have two free bytes for d = 2, 65,536 different fingerprints at most, a proven bound on what a
task holds, however large a group of copies is (equal fingerprints are one entry).  A list emits the
links of its members to the least one they are connected to, never all pairs.

Defined cases: no word (or null text) gives fingerprint 0, which links like any other; fewer
words than a shingle has give one shingle of all words; rows with the same doc_id keep a row
each; a null doc_id never is a component's name unless no other is there; a text may be as long as
a row can be, its hashes are summed by the 65,536; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, mix, text_rows
from .components import connected_components, forest

SEED = 42
#: Fingerprints of a list that is not split: bounds the work of a task, not the result.
LIST = 4096


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit i is set if it is set in more than half of the shingles' hashes."""
    import xxhash

    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    lanes = [words[k : len(words) - shingle + 1 + k] for k in range(shingle)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total, sums = len(lanes[0]), np.zeros(64, np.int64)
    grams = zip(*lanes, strict=True)
    for k in range(0, total, 65_536):
        n = min(65_536, total - k)
        h = np.fromiter((digest(join(next(grams)), SEED) for _ in range(n)), "<u8", n)
        sums += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > total, bitorder="little").tobytes(), "little")


def set_fingerprints(words: list[bytes], shingle: int, copies: int) -> np.ndarray:
    """Independent fingerprints of the set of a text's shingles: each counts once, so long repeats weigh no more than single words."""
    import xxhash

    if not words:
        return np.zeros(copies, np.uint64)
    grams = set(words) if shingle == 1 else {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    sums = np.zeros((copies, 64), np.int64)
    for c in range(copies):
        mixed = mix(h + np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        for k in range(0, len(h), 65_536):
            part = mixed[k : k + 65_536]
            sums[c] += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * sums > len(h), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            # lower() and split() of bytes know ASCII only, as wanted
            out = np.array([fingerprint((t.as_py() or "").encode("utf-8", "replace").lower().split(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], schema=schema)

    return map_batches(text_rows(docs), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def masks(d: int) -> tuple[list[int], list[list[int]]]:
    """The bytes that a list holds fixed, for each first list and for each of the lists that it is split into."""
    pair = [0xFFFF << 16 * p for p in range(4)]
    first = [sum(kept) for kept in combinations(pair, 4 - d)]
    free = [[p for p in range(8) if not m >> 8 * p & 0xFF] for m in first]
    return first, [[m + sum(0xFF << 8 * p for p in more) for more in combinations(left, d)] for m, left in zip(first, free, strict=True)]


def _postings(fps: DataFrame, numbered: dict[int, int]) -> DataFrame:
    """A row for each fingerprint and mask (number: mask): the list's number and the bytes there."""
    lists = [F.struct(F.lit(number).alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("bytes")) for number, mask in numbered.items()]
    return fps.select("copy", "fp", "node", F.inline(F.array(*lists)))


def posted(fps: DataFrame, d: int) -> DataFrame:
    """(copy, list, bytes, fp, node): all postings, long lists split."""
    first, split = masks(d)
    rows = _postings(fps, dict(enumerate(first)))
    key = ["copy", "list", "bytes"]
    long_lists = materialise(rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > LIST).select(*key))
    if long_lists.isEmpty():
        return rows
    out = rows.join(long_lists, key, "left_anti")
    for number, more in enumerate(split):
        again = rows.filter(F.col("list") == number).join(long_lists, key, "left_semi").select("copy", "fp", "node")
        out = out.unionByName(_postings(again, {len(first) + number * len(more) + k: m for k, m in enumerate(more)}))
    return out


_POPCOUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def bits(x: np.ndarray) -> np.ndarray:
    return _POPCOUNT[x.view(np.uint16).reshape(*x.shape, 4)].sum(-1)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of the exclusive-or of pairs: how many positional bytes are the same."""
    return (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)


def links(fps: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a list (different unsigned fingerprints) that pass the tally and the check."""
    us, vs = [], []
    m = len(fps)
    rows = max(1, (1 << 20) // m)
    for at in range(0, m - 1, rows):
        x = fps[at : at + rows, None] ^ fps[None, at + 1 :]
        i, j = np.nonzero(shared_bytes(x) >= 8 - d)
        ok = (j >= i) & (bits(x[i, j]) <= d)
        us.append(at + i[ok])
        vs.append(at + 1 + j[ok])
    return np.concatenate(us), np.concatenate(vs)


def near_edges(fps: DataFrame, d: int) -> DataFrame:
    """(u, v): links between nodes that connect all fingerprints (copy, fp, node; each copy's fingerprints once) at d or fewer differing bits."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = posted(fps, d).repartition(parts, "copy", "list", "bytes").sortWithinPartitions("copy", "list", "bytes")

    def linked(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        u, v = links(fp.view(np.uint64), d)
        if not len(u):
            return None
        return forest(node[u], node[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A list that goes on in the next batch is held: LIST fingerprints, or 65,536, at most.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, node, copy, lists, value = (batch.column(c).to_numpy() for c in ("fp", "node", "copy", "list", "bytes"))
            starts = np.concatenate([[0], np.flatnonzero((copy[1:] != copy[:-1]) | (lists[1:] != lists[:-1]) | (value[1:] != value[:-1])) + 1, [len(fp)]])
            groups = np.flatnonzero((np.diff(starts) > 1) | (np.arange(len(starts) - 1) == len(starts) - 2) | (np.arange(len(starts) - 1) == 0))
            found = []
            for g in groups.tolist():
                part = (fp[starts[g] : starts[g + 1]], node[starts[g] : starts[g + 1]])
                if g == 0 and key == (copy[0], lists[0], value[0]):
                    held.append(part)
                else:
                    if held and sum(len(x) for x, _ in held) > 1 and (got := linked(*(np.concatenate(x) for x in zip(*held, strict=True)))):
                        found.append(got)
                    held = [part]
            key = (copy[-1], lists[-1], value[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=schema)
        if held and sum(len(x) for x, _ in held) > 1 and (got := linked(*(np.concatenate(x) for x in zip(*held, strict=True)))):
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], schema=schema)

    return map_batches(ordered, run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    rows = materialise(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = near_edges(nodes.select(F.lit(0).alias("copy"), "fp", F.col("fp").alias("node")), max_bits)
    roots = connected_components(edges)
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = known.join(names, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame) -> DataFrame:
    got = near_duplicates(docs)
    return got.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
