"""Removal of repeated word passages through compressed FM-indexes.

Every word covered by a window of ``width`` words that also starts in a document with a smaller
id goes.  ``anchors.py`` gathers the contexts of each anchor that occurs again, each different one
once with the least and the greatest id that hold it, into shards.  A shard has an FM-index: the
Burrows-Wheeler transform of its contexts in a wavelet matrix of packed bits with rank directories,
a bit for each row that begins a class of suffixes alike over ``width - 1`` words, and the numbers of
the rows' documents.  Contexts are streamed against it from right to left: backward search extends the
match by the word in front, and a match of ``width`` words is first shortened by its last one, to the
class of its row, so the matching statistics up to the threshold take one step a word.  Every place
with ``width`` words before the end has an interval of suffixes, and the least document of the
interval says whether the window starts in an earlier document.

Defined cases: null text has no words; rows with a null id neither lose words nor make others
lose any; rows with the same id never make each other lose words; documents shorter than the
window keep everything; a document may be as long as a row can be; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .anchors import keyed, repeated_spans
from .common import map_batches, merged
from .suffix_dedup import suffix_order

WIDTH, GRAM = 50, 8
SHARD_BYTES = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def word_symbols(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def word_bytes(text: str) -> bytes:
    return word_symbols(text).tobytes()


class Bits:
    """Packed bits with the number of ones before each 64-bit word."""

    def __init__(self, bit: np.ndarray) -> None:
        padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        w = at >> 6
        return self.counts[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Rank of any symbol before any place."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.begin = self._path(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32)

    def _path(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where(symbols >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._path(symbols, at) - self.begin[symbols]


class FMIndex:
    """Over strings of symbols, for matches of up to ``width``; owners say of each string which document it is from."""

    def __init__(self, strings: list[np.ndarray], owners: np.ndarray, heavy: np.ndarray, width: int) -> None:
        m, self.width = len(strings), width
        self.names, flat = np.unique(np.concatenate(strings), return_inverse=True)
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(sizes.sum()) + m, np.int64)
        is_end = np.zeros(len(text), bool)
        is_end[ends] = True
        text[ends] = np.arange(m)
        text[~is_end] = flat + m
        keep = 1 << (width - 1).bit_length() - 1
        order, _, classes = suffix_order(text, int(sizes.max()) + 1, keep)
        text = np.where(is_end, 0, text - m + 1)
        sigma = len(self.names) + 1
        self.rows = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(text[order - 1], sigma)
        # Suffixes share width - 1 symbols if they share the first and the last ``keep`` of them.
        other = classes[np.minimum(order + (width - 1 - keep), len(order) - 1)]
        mine = classes[order]
        begins = np.concatenate([[True], (mine[1:] != mine[:-1]) | (other[1:] != other[:-1])])
        self.begins, self.starts = Bits(begins), np.append(np.flatnonzero(begins), len(order)).astype(np.int32)
        self.documents, numbers = np.unique(owners, return_inverse=True)
        self.owner = np.repeat(numbers.astype(np.int32), sizes + 1)[order]
        self.heavy = Bits((np.repeat(heavy, sizes + 1) & ~is_end)[order])

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the symbols of a stream; a symbol that no string has counts as an end."""
        at = np.minimum(np.searchsorted(self.names, symbols), len(self.names) - 1)
        return np.where(self.names[at] == symbols, at + 1, 0)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a symbol in front."""
        both = self.tree.rank(np.concatenate([code, code]), np.concatenate([low, high])) + np.tile(self.before[code], 2)
        return both[: len(code)], both[len(code) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first width - 1 symbols of what the rows begin with."""
        k = self.begins.ones(low + 1)
        return self.starts[k - 1].astype(np.int64), self.starts[k].astype(np.int64)

    def matches(self, strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(string, place, low, high): the interval of each window of strings that the index holds, from right to left."""
        width = self.width
        sizes = np.array([len(s) for s in strings])
        begin = np.cumsum(sizes) - sizes
        code = self.codes(np.concatenate(strings))
        live = np.flatnonzero(sizes >= width)
        live = live[np.argsort(-sizes[live], kind="stable")]
        place = sizes[live] - width
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.rows)
        for k in range(width - 1, -1, -1):
            low, high = self.extend(code[begin[live] + place + k], low, high)
        found = []
        while len(live):
            found.append((live, place, low, high))
            more = int(np.searchsorted(-place, 0))  # places descend: those above zero have a word in front
            live, place = live[:more], place[:more] - 1
            low, high = self.extend(code[begin[live] + place], *self.shorten(low[:more]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate([f[k] for f in found]) for k in range(4))

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least document of each interval; intervals of whole windows, so the first row tells them apart."""
        firsts, at, back = np.unique(low, return_index=True, return_inverse=True)
        size = high[at] - firsts
        begin = np.cumsum(size) - size
        rows = np.repeat(firsts - begin, size) + np.arange(size.sum())
        return self.documents[np.minimum.reduceat(self.owner[rows], begin)[back]]


def decide(contexts: list[bytes], n: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (context, first window, last window, least document) of windows that some document after the least one has too."""
    strings = [np.frombuffer(x, np.uint64) for x in contexts]
    index = FMIndex(strings, least, least < most, WIDTH)
    which, place, low, high = index.matches(strings)
    again = np.flatnonzero((high - low > 1) | (index.heavy.ones(low + 1) > index.heavy.ones(low)))
    which, place, low, high = which[again], place[again], low[again], high[again]
    if not len(which):
        return which, place, place, place
    owner = index.least_owner(low, high)
    hit = np.flatnonzero(owner < most[which])
    hit = hit[np.lexsort((place[hit], which[hit]))]
    which, place, owner = which[hit], place[hit], owner[hit]
    if not len(which):
        return which, place, place, owner
    cut = np.flatnonzero((np.diff(which) > 0) | (np.diff(place) > 1) | (np.diff(owner) != 0))
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(which) - 1]])
    return which[first], place[first], place[last], owner[first]


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): spans count words; kept is the kept words joined by one space."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    rows = keyed(docs)
    spans = repeated_spans(rows.filter("doc_id is not null"), word_symbols, word_bytes, 8, WIDTH, GRAM, False, decide, SHARD_BYTES).filter("least < did")
    found = spans.groupBy("rid", "did").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = rows.join(found, ["rid", "did"], "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("found")
            for at in range(0, len(texts), 500):
                out: list[list] = [[], [], [], []]
                for k in range(at, min(len(texts), at + 500)):
                    words = words_of(texts[k].as_py())
                    spans = merged([(x["start"], x["end"]) for x in lists[k].as_py() or ()])
                    kept, last = [], 0
                    for s, e in spans:
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                    for column, value in zip(out, (len(words), len(words) - len(kept), [{"start": s, "end": e} for s, e in spans], b" ".join(kept)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 500), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(out))], schema=schema)

    return map_batches(joined, run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


#: The same rows, as the query returns them, in DuckDB.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, word, CASE WHEN doc_id IS NOT NULL AND lead(word, {WIDTH - 1}) OVER (PARTITION BY r ORDER BY i) IS NOT NULL THEN array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING), ' ') END AS key FROM u),
h AS (SELECT r, i, word, CASE WHEN key IS NOT NULL AND min(doc_id) OVER (PARTITION BY key) < doc_id THEN 1 ELSE 0 END AS hit FROM k),
v AS (SELECT r, i, word, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS covered FROM h),
g AS (SELECT r, count(*) AS n_words, sum(covered) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (covered = 0) AS kept FROM v GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""
