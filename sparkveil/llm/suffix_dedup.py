"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

Every byte covered by a ``width``-byte string that starts anywhere else goes.  ``anchors.py``
gathers the contexts of each anchor that occurs again, each different one once with its number
of occurrences, into shards of half a megabyte or so.  A shard's contexts are read as strings of
``PACK``-byte symbols, one string for each of the phases, so each byte starts exactly one symbol
and ``width`` is a whole number of symbols.  On the transform of the shard, intervals of suffixes
that begin alike are expanded breadth first by one symbol in front (backward extension), by
increasing length of the common prefix; intervals that stand for a single occurrence are dropped,
and the expansion stops at the threshold.  The suffixes in the intervals that are left are the
repeated windows.

Defined cases: null text is empty; documents shorter than ``width`` keep everything; rows with
the same id and text are two documents (each repeats the other), whether the id is null or not;
a document may be as long as a row can be, its windows are looked at by the million; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import keyed, repeated_spans
from .common import map_batches, merged

WIDTH, GRAM, PACK = 400, 64, 8
SHARD_BYTES = 1 << 19
_RNG = np.random.default_rng(42)
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def byte_symbols(text: str) -> np.ndarray:
    return BYTE[np.frombuffer(utf8(text), np.uint8)]


def suffix_order(symbols: np.ndarray, most: int, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, classes) by prefix doubling of the suffixes that are still alike.

    No common prefix is longer than ``most``.  classes has equal numbers for suffixes that share
    their first ``keep`` symbols, a power of two.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    s = symbols[order]
    begin = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(begin)[np.cumsum(begin) - 1]  # the first row of a suffix's group
    slots = np.flatnonzero(~(begin & np.concatenate([begin[1:], [True]])))
    k, classes = 1, None
    while k <= most and len(slots):
        if k == keep:
            classes = rank.copy()
        a = order[slots]
        after = a + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[a] * (n + 1) + second
        by = np.argsort(key)
        a, key = a[by], key[by]
        order[slots] = a
        begin = np.concatenate([[True], key[1:] != key[:-1]])
        rank[a] = slots[np.flatnonzero(begin)[np.cumsum(begin) - 1]]
        slots = slots[~(begin & np.concatenate([begin[1:], [True]]))]
        k *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, rank if classes is None else classes


def expand(symbols: np.ndarray, length: int, most: int, heavy: np.ndarray) -> np.ndarray:
    """Places where a string of ``length`` symbols starts that occurs again.

    symbols: strings, each ended by a symbol of its own, so no common prefix crosses one.
    heavy: whether a place stands for more than one occurrence.
    """
    order, inverse, _ = suffix_order(symbols, most)
    n = len(symbols)
    bwt = symbols[order - 1]
    step = inverse[order - 1].astype(np.int32)  # the row of the suffix that starts one symbol before
    # The end of the run of equal symbols of the transform: an interval within one is extended as a whole.
    edge = np.append(np.flatnonzero(bwt[1:] != bwt[:-1]) + 1, n)
    run_end = np.repeat(edge, np.diff(edge, prepend=0)).astype(np.int32)
    first = symbols[order]
    heavy = heavy[order]
    lone = np.where(heavy[step], step, -1).astype(np.int32)  # where a single suffix goes on, if that stands for several occurrences
    edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]])).astype(np.int32)
    low, size = edges[:-1], np.diff(edges)  # level 1
    single = low[(size == 1) & heavy[low]]
    low, size = low[size > 1], size[size > 1]
    for _ in range(length - 1):
        if not len(low) and not len(single):
            break
        single = lone[single]
        single = single[single >= 0]
        even = run_end[low] >= low + size
        a, ul, us, size = step[low[even]], low[~even], size[~even], size[even]
        # Rows of an uneven interval are extended one by one and regrouped by the symbol in front.
        if len(ul):
            rows = np.repeat(ul - np.cumsum(us) + us, us) + np.arange(us.sum())
            owner = np.repeat(np.arange(len(ul)), us)
            to = step[rows]
            by = np.argsort(owner * n + to)
            to, owner = to[by], owner[by]
            sym = first[to]
            cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (sym[1:] != sym[:-1])]))
            count = np.diff(cut, append=len(to)).astype(np.int32)
            alone = to[cut[count == 1]]
            single = np.concatenate([single, alone[heavy[alone]]])
            a, size = np.concatenate([a, to[cut[count > 1]]]), np.concatenate([size, count[count > 1]])
        low = a
    rows = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    return order[np.concatenate([single, rows])]


def repeated_windows(contexts: list[bytes], n: np.ndarray, width: int = WIDTH, pack: int = PACK) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of the windows that occur again in the contexts, of which each stands for n occurrences; by context, then place."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    flat = np.frombuffer(b"".join([*contexts, bytes(pack)]), np.uint8)
    symbol = np.zeros(len(flat) - pack + 1, np.uint64)
    for k in range(pack):
        symbol |= flat[k : k + len(symbol)].astype(np.uint64) << np.uint64(8 * k)
    # A string for each context and phase in which a window starts.
    context, phase = np.divmod(np.arange(len(contexts) * pack), pack)
    some = phase <= sizes[context] - width
    context, phase = context[some], phase[some]
    if not len(context):
        return context, phase
    count = (sizes[context] - phase) // pack + 1  # with its end
    ends = np.cumsum(count) - 1
    string = np.repeat(np.arange(len(context)), count)
    owner = context[string]
    place = (np.arange(ends[-1] + 1) - np.repeat(ends + 1 - count, count)) * pack + phase[string]
    symbols = symbol[np.minimum((np.cumsum(sizes) - sizes)[owner] + place, len(symbol) - 1)]
    # Text never has the bytes FF at a symbol's end (it is UTF-8), so the strings' ends differ from all of it.
    symbols[ends] = ~np.arange(len(context), dtype=np.uint64)
    heavy = (n > 1)[owner]
    heavy[ends] = False
    at = expand(symbols, width // pack, int(sizes.max()) // pack + 1, heavy)
    owner, place = owner[at], place[at]
    by = np.argsort(owner * (int(sizes.max()) + 1) + place)
    return owner[by], place[by]


def decide(contexts: list[bytes], n: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (context, first window, last window, 0) of the windows that occur again."""
    owner, place = repeated_windows(contexts, n, WIDTH, PACK)
    cut = np.flatnonzero((np.diff(owner) > 0) | (np.diff(place) > 1))
    first, last = (np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(owner) - 1]])) if len(owner) else (owner, owner)
    return owner[first], place[first], place[last], np.zeros(len(first), np.int64)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): kept is what remains, as bytes."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    rows = keyed(docs)
    found = repeated_spans(rows, byte_symbols, utf8, 1, WIDTH, GRAM, True, decide, SHARD_BYTES).groupBy("rid", "did").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = rows.join(found, ["rid", "did"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("found")
            for at in range(0, len(texts), 500):
                out: list[list] = [[], [], [], []]
                for k in range(at, min(len(texts), at + 500)):
                    data = utf8(texts[k].as_py())
                    spans = merged([(x["start"], x["end"]) for x in lists[k].as_py() or ()])
                    kept, last = [], 0
                    for s, e in spans:
                        kept.append(data[last:s])
                        last = e
                    kept.append(data[last:])
                    kept = b"".join(kept)
                    for column, value in zip(out, (len(data), len(data) - len(kept), [{"start": s, "end": e} for s, e in spans], kept), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 500), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(out))], schema=schema)

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
