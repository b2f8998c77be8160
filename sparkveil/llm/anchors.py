"""Brings equal windows of a corpus together without pairing documents.

A window is ``width`` consecutive symbols (bytes or words) of one document.  Each window
chooses an anchor: its ``gram``-symbol substring of least hash, the leftmost at ties.  Equal
windows choose the same anchor at the same place, so windows need comparing only among
occurrences of one anchor.  Consecutive windows mostly choose the same anchor; the stretch
they cover is the anchor's *context*.  Per occurrence a row holds two hashes, of the anchor
(``akey``) and of its context (``chash``).  An anchor that occurs once has no equal windows;
of the others each different context stands once, with how often and where it occurs, in the
index of a shard of anchors, and the index alone says which of its windows repeat.

An anchor with more than ``SHARD_CONTEXTS`` different contexts (a line that stands in very many
documents) is split, whatever its size, by what its windows have in common: windows are told
apart by the place of the anchor in them, ranges of places are cut into ``FAN`` parts, and the
windows of a part share a longer core around the anchor.  Contexts meet again only where these
cores are equal, those without a partner go, equal stretches count as one, and groups that are
still too large are cut again; a part of a single place holds one window, so this ends.

Rows are joined by their id and a 64-bit hash of id and text; contexts count as equal by two
64-bit hashes, of the anchor and of the context; an index compares the symbols themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Rolling, leftmost_minima, map_batches, materialise, text_rows

#: Different contexts of one anchor, or of one core, that a shard compares at once.
SHARD_CONTEXTS = 256
#: Parts into which the places of a large anchor are cut at a time.
FAN = 8
#: Windows of a document that are looked at together: bounds memory for very long documents.
CHUNK = 1 << 20

ROWS = "rid long, did long, akey long, chash long, start array<int>, windows int, lead int"
RUNS = "akey long, chash long, runs array<struct<start:int,end:int,least:long>>"
RUN_SCHEMA = pa.schema([("akey", pa.int64()), ("chash", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("least", pa.int64())])))])


def keyed(docs: DataFrame) -> DataFrame:
    """Adds did, the id without nulls, and rid, a hash of the row: both together join results back; rows alike in id and text share them."""
    rows = text_rows(docs).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("rid", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))


def anchors_of(symbols: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(akey, chash, first window, number of windows, place of the anchor in the first) of each anchor, for each chunk of a document's windows."""
    total = len(symbols) - width + 1
    for at in range(0, total, CHUNK):
        part = symbols[at : min(len(symbols), at + CHUNK + width - 1)]
        rolling = Rolling(part)
        grams = rolling.windows(gram)
        places = leftmost_minima(grams, width - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
        count = np.diff(np.concatenate([first, [len(places)]]))
        anchor = places[first]
        chash = rolling.spans(first, first + count + width - 1) ^ (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        yield grams[anchor], chash, first + at, count, anchor - first


def anchor_rows(keyed_docs: DataFrame, symbols: Callable[[str], np.ndarray], width: int, gram: int) -> DataFrame:
    schema = pa.schema([("rid", pa.int64()), ("did", pa.int64()), ("akey", pa.int64()), ("chash", pa.int64()), ("start", pa.list_(pa.int32())), ("windows", pa.int32()), ("lead", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids, texts = batch.column("rid").to_numpy(), batch.column("did").to_numpy(), batch.column("text")
            for at in range(0, len(rids), 1000):
                out: list[list] = [[] for _ in range(8)]
                for k in range(at, min(len(rids), at + 1000)):
                    s = symbols(texts[k].as_py())
                    for akey, chash, first, count, lead in anchors_of(s, width, gram):
                        # An anchor with the same context again in its document (periodic text) is one row with several starts.
                        order = np.lexsort((first, chash, akey))
                        akey, chash, first, count, lead = akey[order], chash[order], first[order], count[order], lead[order]
                        new = np.flatnonzero(np.concatenate([[True], (akey[1:] != akey[:-1]) | (chash[1:] != chash[:-1])]))
                        out[0].append(np.full(len(new), rids[k]))
                        out[1].append(np.full(len(new), ids[k]))
                        out[2].append(akey[new].view(np.int64))
                        out[3].append(chash[new].view(np.int64))
                        out[4].append(first.astype(np.int32))
                        out[5].append(count[new].astype(np.int32))
                        out[6].append(lead[new].astype(np.int32))
                        out[7].append(np.diff(np.concatenate([new, [len(akey)]])))
                if not out[0]:
                    continue
                flat = [np.concatenate(x) for x in out]
                starts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat[7])]).astype(np.int32)), pa.array(flat[4]))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in flat[:4]), starts, pa.array(flat[5]), pa.array(flat[6])], schema=schema)

    return map_batches(keyed_docs.select("rid", "did", "text"), run, ROWS)


#: What is known of how often and where a context occurs.
def _counts(n: Column | str) -> list[Column]:
    return [F.sum(n).alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]


def _again(within: bool) -> str:
    """Whether something occurs again: anywhere, or (not within) in another document."""
    return "n > 1" if within else "least < most"


def repeated_anchors(rows: DataFrame, within: bool) -> DataFrame:
    """The rows of anchors that occur again.

    The counts are combined before the shuffle and written before the join, so that Spark's
    skew handling may split the rows of a frequent anchor.
    """
    counts = rows.select("akey", F.size("start").alias("n"), F.col("did").alias("least"), F.col("did").alias("most")).groupBy("akey").agg(*_counts("n"))
    return materialise(rows.join(materialise(counts.filter(_again(within)).select("akey")), "akey"))


def _with_sizes(contexts: DataFrame) -> DataFrame:
    """Adds large: whether the group of an akey has more contexts than a shard compares."""
    sizes = contexts.groupBy("akey").agg(F.count("*").alias("m")).filter(F.col("m") > SHARD_CONTEXTS)
    return contexts.join(materialise(sizes.select("akey", F.lit(True).alias("large"))), "akey", "left").withColumn("large", F.coalesce("large", F.lit(False)))


def distinct_contexts(rows: DataFrame) -> DataFrame:
    """(akey, chash, n, least, most, rid, did, first, windows, lead, large): each different context once, with an example of its place."""
    example = F.min(F.struct("did", "rid", F.element_at("start", 1).alias("first"), "windows", "lead")).alias("x")
    got = rows.withColumns({"least": F.col("did"), "most": F.col("did")}).groupBy("akey", "chash").agg(*_counts(F.size("start")), example)
    return _with_sizes(materialise(got.select("akey", "chash", "n", "least", "most", "x.*")))


FETCHED = "akey long, chash long, n long, least long, most long, windows int, lead int, large boolean, data binary"


def fetch_contexts(keyed_docs: DataFrame, contexts: DataFrame, encode: Callable[[str], bytes], unit: int, width: int) -> DataFrame:
    """The contexts with their symbols, of ``unit`` bytes each, as data."""
    names = ["akey", "chash", "n", "least", "most", "windows", "lead", "large"]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]
    schema = pa.schema([*zip([*names, "data"], kinds, strict=True)])
    # the contexts taken from a document are as long as the document at most, but for their overlaps
    wanted = contexts.groupBy("rid", "did").agg(F.collect_list(F.struct("first", *names)).alias("wanted"))
    joined = keyed_docs.select("rid", "did", "text").join(wanted, ["rid", "did"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("wanted")
            for k in range(batch.num_rows):
                data = encode(texts[k].as_py())
                found = lists[k].values
                first, windows = (found.field(c).to_numpy() for c in ("first", "windows"))
                for at in range(0, len(first), 5000):
                    cut = [data[unit * f : unit * (f + w + width - 1)] for f, w in zip(first[at : at + 5000].tolist(), windows[at : at + 5000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(found.field(c).slice(at, 5000) for c in names), pa.array(cut, pa.binary())], schema=schema)

    return map_batches(joined, run, FETCHED)


#: Decides a shard: from contexts (as bytes), n, least and most of each, the runs of windows (context, first, last, least) that occur again.
Decide = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def decided(contexts: DataFrame, decide: Decide, shard_bytes: int, width: int) -> DataFrame:
    """RUNS of the contexts (akey, chash, n, least, most, data): spans of their windows that occur again, by an index for each shard of akeys."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = contexts.select("akey", "chash", "n", "least", "most", "data").repartition(parts, "akey").sortWithinPartitions("akey", "chash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            akey, chash, n, least, most = (shard.column(c).to_numpy() for c in ("akey", "chash", "n", "least", "most"))
            # rows alike in id and text bring their contexts more than once
            own = np.flatnonzero(np.concatenate([[True], (akey[1:] != akey[:-1]) | (chash[1:] != chash[:-1])]))
            data = shard.column("data").take(pa.array(own)).to_pylist()
            which, first, last, low = decide(data, n[own], least[own], most[own])
            has, count = np.unique(which, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array((last + width).astype(np.int32)), pa.array(low)], names=["start", "end", "least"])
            yield pa.RecordBatch.from_arrays([pa.array(akey[own][has]), pa.array(chash[own][has]), pa.ListArray.from_arrays(offsets, runs)], schema=RUN_SCHEMA)

    return map_batches(ordered, run, RUNS)


PART = "akey long, chash long, own_akey long, own_chash long, shift int, n long, least long, most long, windows int, lead int, low int, high int, data binary"


def _cut(groups: DataFrame, unit: int, width: int) -> DataFrame:
    """Cuts the places low..high of the anchor in the windows of each row into parts; akey becomes a hash of the part's core, chash one of the row's stretch there.

    lead is the place of the anchor in the row's first window, shift where the row's symbols stand in the context they come from.
    """
    names, kinds = [f.split()[0] for f in PART.split(", ")], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, PART.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out: list[list] = [[] for _ in names]
                for r in batch.slice(at, 2000).to_pylist():
                    places = r["high"] - r["low"] + 1
                    step, last = -(-places // FAN), r["lead"] - r["windows"] + 1  # the anchor's place in the row's last window
                    for low in range(r["low"], r["high"] + 1, step):
                        high = min(low + step - 1, r["high"])
                        lead, end = min(high, r["lead"]), max(low, last)
                        if lead < end:
                            continue
                        a = r["lead"] - lead
                        data = r["data"][unit * a : unit * (r["lead"] - end + width)]
                        core = r["data"][unit * (r["lead"] - low) : unit * (r["lead"] - high + width)]
                        seed = r["akey"] & 0xFFFFFFFF ^ low << 32
                        keys = (xxh3_64_intdigest(core, seed), xxh3_64_intdigest(data, lead << 32 | end))
                        row = (*(k - (1 << 64) if k >> 63 else k for k in keys), r["own_akey"], r["own_chash"], r["shift"] + a, r["n"], r["least"], r["most"], lead - end + 1, lead, low, high, data)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return map_batches(groups.select(*names), run, PART)


def repeated_runs(keyed_docs: DataFrame, rows: DataFrame, encode: Callable[[str], bytes], unit: int, width: int, gram: int, within: bool, decide: Decide, shard_bytes: int) -> DataFrame:
    """RUNS of every context of the rows."""
    contexts = materialise(fetch_contexts(keyed_docs, distinct_contexts(rows), encode, unit, width))
    found = decided(contexts.filter("not large"), decide, shard_bytes, width)
    large = contexts.filter("large").select("*", F.col("akey").alias("own_akey"), F.col("chash").alias("own_chash"), F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(width - gram).alias("high"))
    while not large.isEmpty():
        parts = materialise(_cut(large, unit, width))
        each = parts.groupBy("akey", "chash").agg(*_counts("n"), F.first("data").alias("data"))
        groups = each.groupBy("akey").agg(F.count("*").alias("m"), *_counts("n")).filter(_again(within)).select("akey", (F.col("m") > SHARD_CONTEXTS).alias("large"))
        parts = materialise(parts.join(materialise(groups), "akey"))
        few = parts.filter("not large").groupBy("akey", "chash").agg(*_counts("n"), F.first("data").alias("data"))
        runs = materialise(decided(few, decide, shard_bytes, width))
        moved = F.transform("runs", lambda x: F.struct((x["start"] + F.col("shift")).alias("start"), (x["end"] + F.col("shift")).alias("end"), x["least"].alias("least")))
        found = found.union(parts.join(runs, ["akey", "chash"]).select(F.col("own_akey").alias("akey"), F.col("own_chash").alias("chash"), moved.alias("runs")))
        large = parts.filter("large").drop("large")
    return materialise(found)


def repeated_spans(keyed_docs: DataFrame, symbols: Callable[[str], np.ndarray], encode: Callable[[str], bytes], unit: int, width: int, gram: int, within: bool, decide: Decide, shard_bytes: int) -> DataFrame:
    """(rid, did, start, end, least): spans of symbols in which every window occurs again, least the least id that has them."""
    rows = repeated_anchors(materialise(anchor_rows(keyed_docs, symbols, width, gram)), within)
    runs = repeated_runs(keyed_docs, rows, encode, unit, width, gram, within, decide, shard_bytes)
    hit = rows.select("akey", "chash", "rid", "did", "start").join(runs, ["akey", "chash"])
    each = hit.select("rid", "did", "runs", F.explode("start").alias("at")).select("rid", "did", "at", F.inline("runs"))
    return each.select("rid", "did", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "least")


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Groups a stream that is sorted by akey into tables that hold whole keys and about ``most`` bytes of data."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("akey").to_numpy()
        weights = pa.compute.binary_length(batch.column("data")).to_numpy()
        begin = 0
        cuts = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column("akey")[held[-1].num_rows - 1].as_py() != keys[0] and size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        for cut in cuts[:-1]:
            if size + sums[cut] - sums[begin] >= most:
                held.append(batch.slice(begin, cut - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, begin = [], 0, cut
        held.append(batch.slice(begin))
        size += sums[-1] - sums[begin]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
