"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Documents stream past the n-grams of the test items.  The items are the stated query set: they
are taken in blocks of at most about ``BLOCK_WORDS`` words, so what is broadcast has a fixed
bound and more items mean more passes.  Each hit proposes a stretch of the document around the
item's diagonal.  A stretch that shares too few words with the item for any alignment to reach the
threshold goes at once (a bound, so nothing is lost); how often a seed occurs in the corpus never
decides, as leaks themselves make the seeds of their items frequent.  Of the stretches that are
left each different one is aligned once, word by word, and its result joined to all its copies; the
best local alignment scores 2 a match, -1 a mismatch or gap, over 2 a word of the item.
``THRESHOLD`` decides.

Defined cases: null texts and null ids of items have no passages; an item with fewer words than a
seed is a seed as a whole, one without words is not searched; rows of items with the same id are
texts of one item, each searched; a document row with a null id is not reported; rows of documents
with the same id are one document, of equal scores the first passage counts; a text may be as long
as a row can be, it is streamed; an empty table on either side gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, mix, text_rows

SEED_WORDS, THRESHOLD = 4, 0.5
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Seeds:
    """Sorted n-gram hashes of a block of item texts and where they stand; a text shorter than n is one n-gram of its own length."""

    def __init__(self, items: list[tuple[int, str]], n: int = SEED_WORDS) -> None:
        self.items = {i: words_of(t) for i, t in items}
        self.vocabulary: dict[str, int] = {}
        found: dict[int, list[list[np.ndarray]]] = {}
        for i, words in self.items.items():
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.uint64)
            if len(ids):
                g = self.hashes(ids, min(n, len(ids)))
                found.setdefault(min(n, len(ids)), []).append([g, np.full(len(g), i), np.arange(len(g))])
        #: By length of the n-grams: their hashes, ascending, the texts and the places there.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            h, owners, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.grams[size] = h[order], owners[order], places[order]

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x100000001B3) + ids[k : k + len(h)] + np.uint64(1))
        return h

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the document, text, place there) of each hit."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = ids >= 0
        out = [(np.zeros(0, np.int64),) * 3]
        for n, (grams, owners, places) in self.grams.items():
            if len(ids) < n:
                continue
            ok = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                ok &= known[k : k + len(ok)]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = self.hashes(ids.astype(np.uint64), n)[at]
            low, high = np.searchsorted(grams, h, "left"), np.searchsorted(grams, h, "right")
            count = high - low
            begin = np.cumsum(count) - count
            row = np.repeat(low - begin, count) + np.arange(count.sum())
            out.append((np.repeat(at, count), owners[row], places[row]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def smith_waterman(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, end in the document, end in the item) of the best local alignment of two arrays of word numbers."""
    n = len(doc)
    index = np.arange(1, n + 1)
    row = np.zeros(n + 1, np.int64)
    best = (0, 0, 0)
    for j, w in enumerate(item, 1):
        step = np.maximum(row[:-1] + np.where(doc == w, 2, -1), row[1:] - 1)
        step = np.maximum(step, 0)
        # gaps along the document: each place takes the best before it, less one a step
        step = np.maximum.accumulate(step + index) - index
        row = np.concatenate([[0], np.maximum(step, 0)])
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), k, j)
    return best


def align(region: list[str], item: list[str]) -> tuple[float, int, int]:
    """(score, start, end): of the item's best alignment with a stretch, as a share of a verbatim copy's, and its words."""
    number: dict[str, int] = {}
    d = np.array([number.setdefault(w, len(number)) for w in region], np.int64)
    i = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    score, end, item_end = smith_waterman(d, i)
    if not score:
        return 0.0, 0, 0
    _, back, _ = smith_waterman(d[:end][::-1], i[:item_end][::-1])
    return score / (2 * len(item)), end - back, end


def shared_words(region: list[str], item: Counter[str]) -> int:
    """How many words, each as often as in both, a stretch and an item share: no alignment has more matches."""
    return (Counter(w for w in region if w in item) & item).total()


HITS = "doc_id long, part long, first long, region string"


def _hits(docs: DataFrame, shared, threshold: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("first", pa.int64()), ("region", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        bags: dict[int, Counter[str]] = {}
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            texts = batch.column("text")
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                words = words_of(texts[k].as_py())
                at, owner, place = seeds.hits(words)
                if not len(at):
                    continue
                for item in np.unique(owner).tolist():
                    mine = owner == item
                    size = len(seeds.items[item])
                    pad = max(8, size // 2)
                    diagonal = at[mine] - place[mine]
                    order = np.argsort(diagonal, kind="stable")
                    low = np.maximum(diagonal[order] - pad, 0)
                    high = np.minimum(diagonal[order] + size + pad, len(words))
                    reach = np.maximum.accumulate(high)
                    cuts = [0, *(np.flatnonzero(low[1:] > reach[:-1]) + 1).tolist(), len(low)]
                    bag = bags.get(item)
                    if bag is None:
                        bag = bags[item] = Counter(seeds.items[item])
                    for s, e in zip(cuts, cuts[1:], strict=False):
                        a, b = int(low[s]), int(reach[e - 1])
                        if shared_words(words[a:b], bag) / size < threshold:
                            continue
                        for column, value in zip(out, (doc_id, item, a, " ".join(words[a:b])), strict=True):
                            column.append(value)
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return map_batches(text_rows(docs).filter("text is not null and doc_id is not null"), run, HITS)


ALIGNED = "part long, region string, score double, start long, end long"


def _aligned(regions: DataFrame, shared, threshold: float) -> DataFrame:
    """The alignments at the threshold or above of stretches (part, region)."""
    schema = pa.schema([("part", pa.int64()), ("region", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for item, region in zip(*(batch.column(c).to_pylist() for c in ("part", "region")), strict=True):
                score, start, end = align(region.split(" "), seeds.items[item])
                if score >= threshold:
                    for column, value in zip(out, (item, region, score, start, end), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return map_batches(regions, run, ALIGNED)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start, end): leaked items of each document, the best alignment of each, in words."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    # part numbers the texts; written, so that it stays what it is
    items = materialise(texts.withColumn("part", F.monotonically_increasing_id()))
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        block = [(r["part"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("part"), F.lit(blocks)) == b).collect()]  # about BLOCK_WORDS words
        shared = spark.sparkContext.broadcast(Seeds(block))
        hits = materialise(_hits(docs, shared, threshold))
        aligned = materialise(_aligned(hits.select("part", "region").distinct(), shared, threshold))
        got = hits.join(aligned, ["part", "region"]).select("doc_id", "part", "score", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))
        found = got if found is None else found.union(got)
    best = F.max(F.struct(F.col("score"), (-F.col("start")).alias("start"), F.col("end"))).alias("x")
    named = found.join(items.select("part", "item_id"), "part")
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", (-F.col("x.start")).alias("start"), "x.end")
