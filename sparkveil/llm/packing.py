"""Best-fit packing of tokenised documents by bin completion.

Documents are encoded, ended and cut into pieces of at most ``capacity`` tokens.  Pieces
are dealt into shards by a hash (a hot source or group of copies spreads evenly), and each
shard is packed on its multiset of lengths:

1. best-fit decreasing gives the first incumbent; the waste bound is ceil(sum / capacity);
2. while the incumbent is above the bound, bin completion searches: the largest piece left
   opens a sequence, the undominated fillings of the room around it are enumerated (a filling
   is dominated if its pieces go into those of another one), fullest first; a branch whose
   waste exceeds what the incumbent allows is pruned.  The search goes on from each better
   packing until the bound is met or its nodes, a multiple of the sequences, are visited.

Sequences of different shards never mix, so at most one part-filled sequence a shard is lost.

Defined cases: null text is an empty one (one piece, the end id); documents with the same id
and text are packed each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach
from .common import map_batches, materialise, text_rows
from .word_tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces a shard holds on average, and nodes a search may visit, in all and for each sequence: work limits, every piece is packed whatever they are.
SHARD_PIECES, NODES, NODES_BIN = 25_000, 2_000, 16


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, keeps_spaces: bool = False, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds the ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))
    rows = text_rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, keeps_spaces)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for k in range(0, len(ids), 2000):
                out: list[list] = [[] for _ in schema]
                for doc_id, coded in zip(ids[k : k + 2000], enc.encode(texts.slice(k, 2000).to_pylist()), strict=True):
                    data = np.frombuffer(coded, enc.dtype).astype("<u4").tobytes() + end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row = (doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), part)
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return map_batches(rows, cut, PIECES + (", ids binary" if with_ids else ""))


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of each bin; lengths in descending order."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        at = bisect_right(rooms, (n, -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - n, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
            room -= n
        if room:
            insort(rooms, (room, b))
    return bins


def _holds(g: tuple[int, ...], f: tuple[int, ...]) -> bool:
    """Whether the pieces of f, descending, go into those of g by first fit: then g dominates f."""
    rooms = list(g)
    for n in f:
        at = next((k for k, r in enumerate(rooms) if r >= n), None)
        if at is None:
            return False
        rooms[at] -= n
    return True


def _fillings(big: int, order: list[int], counts: dict[int, int], capacity: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated sequences around the piece big, fullest first, of the sizes in order (ascending).

    A few are enumerated first; whoever asks on gets wider enumerations, until all were given.
    What a wider one costs is taken from the budget.
    """
    width, branch = 12, 4
    given: set[tuple[int, ...]] = set()
    while True:
        found: dict[tuple[int, ...], int] = {}
        steps, cut = 16 * width, False

        def go(top: int, room: int, chosen: tuple[int, ...]) -> None:
            nonlocal steps, cut
            steps -= 1
            if steps < 0 or len(found) >= width:
                cut = True
                return
            top = bisect_right(order, room, 0, top)
            if top and order[top - 1] == big and counts[big] == 1:
                top -= 1
            if not top:
                # one that leaves room for a size that is left is dominated
                if all(counts[n] - (n == big) <= chosen.count(n) for n in order[: bisect_right(order, room)]):
                    found[chosen] = sum(chosen)
                return
            low = max(0, top - branch)
            cut = cut or low > 0
            for k in range(top - 1, low - 1, -1):
                n = order[k]
                for m in range(min(counts[n] - (n == big), room // n), 0, -1):
                    if steps < 0 or len(found) >= width:
                        cut = True
                        return
                    go(k, room - m * n, chosen + (n,) * m)

        go(len(order), capacity - big, ())
        out: list[tuple[int, ...]] = []
        for f in sorted(found, key=lambda f: (-found[f], len(f))):
            if not any(_holds(g, f) for g in out):
                out.append(f)
        for f in out:
            if f not in given:
                given.add(f)
                yield (big, *f)
        if not cut:
            return
        width, branch = 4 * width, 4 * branch
        budget[0] -= (width // 12) ** 2
        if budget[0] <= 0:
            return


def bin_completion(lengths: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of indices: the incumbent of best-fit decreasing, or the best that branch and bound finds below it.

    The search may visit nodes, or NODES_BIN for each bin where that is more: a node places one bin.
    """
    bins = best_fit_decreasing(lengths, capacity)
    unit = gcd(*lengths) or 1
    capacity -= capacity % unit  # no bin holds more
    bound = -(-sum(lengths) // capacity)
    if len(bins) <= bound:
        return bins
    counts = Counter(lengths)
    order = sorted(counts)
    fewest, best = len(bins), None
    budget = [max(nodes, NODES_BIN * len(bins))]
    # Depth-first with an explicit stack: a long shard opens thousands of sequences.
    chosen: list[tuple[int, ...]] = []
    left, total = len(lengths), sum(lengths)
    waste = 0

    def take(f: tuple[int, ...]) -> None:
        for n in f:
            counts[n] -= 1
            if not counts[n]:
                del order[bisect_left(order, n)]

    def give(f: tuple[int, ...]) -> None:
        for n in f:
            if not counts[n]:
                insort(order, n)
            counts[n] += 1

    stack = [_fillings(order[-1], order, counts, capacity, budget)]
    while stack and budget[0] > 0 and fewest > bound:
        f = next(stack[-1], None)
        if f is None:
            stack.pop()
            if chosen:
                done = chosen.pop()
                give(done)
                left += len(done)
                waste -= capacity - sum(done)
            continue
        budget[0] -= 1
        # a packing that beats the incumbent has this much waste at most
        if waste + capacity - sum(f) > (fewest - 1) * capacity - total:
            continue
        if left == len(f):
            fewest, best = len(chosen) + 1, [*chosen, f]
            continue
        take(f)
        chosen.append(f)
        left -= len(f)
        waste += capacity - sum(f)
        stack.append(_fillings(order[-1], order, counts, capacity, budget))
    if best is None:
        return bins
    where: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        where.setdefault(n, []).append(i)
    return [[where[n].pop() for n in c] for c in best]


def pack(parts: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to the columns of pieces()."""
    attach(parts.sparkSession)
    shards = max(1, -(-parts.count() // shard_pieces))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    dealt = parts.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(shards)).cast("int"))

    def fill(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = key[0].as_py() << 32
        whole = sum(n == capacity for n in lengths)  # full pieces are sequences of their own
        sequence[:whole] = base + np.arange(whole)
        for b, members in enumerate(bin_completion(lengths[whole:], capacity)):
            at = 0
            for i in members:
                sequence[whole + i], offset[whole + i] = base + whole + b, at
                at += lengths[whole + i]
        columns = [table.column(f.name).cast(f.type) for f in schema if f.name not in ("sequence_id", "offset")]
        return pa.table([*columns, pa.array(sequence), pa.array(offset)], schema=schema)

    return dealt.groupBy("_shard").applyInArrow(fill, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Encode, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialise(pieces(docs, tokenizer_path, end_id, capacity)), capacity)
