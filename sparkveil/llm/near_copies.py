"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches, and neither decides:

1. fingerprints of the set of words, several independent ones, at two differing bits or fewer
   (the inverted index of ``simhash``);
2. min-hashes of the set of shingles in ``BANDS`` bands of ``BAND_ROWS``: a pair at 0.8 shares no
   band with a probability of (1 - 0.8**4)**24 = 3 in a million, a more similar one with less.

The exact similarity decides every link.  First each text is compared with the least text of a
bucket it is in, which settles most groups of copies with one comparison a text.  Then buckets that
still hold texts of different components are searched: texts of a bucket that agree with one of another
component in ``AGREE`` min-hashes or more (a pair at 0.8 agrees in fewer with a probability below
one in a million) are brought together, and from one text after the other all texts not reached yet
are compared with it.  A bucket of more than ``BUCKET`` texts or ``SHINGLES`` shingles is split by a further band, as
often as helps, and in the end into pairs of blocks, so no task holds a group that grows with the
corpus and no pair is lost; links to one text of a component leave a task, never pairs.  Texts with
equal sets of shingles are one node, so copies are never paired.

Verification streams the texts past one text of each task's group; frequent texts are salted.

Defined cases: words are those of ``simhash`` (ASCII white space, ASCII lower case); fewer words
than a shingle has give one shingle of all words; texts without words are copies of each other;
rows are told apart by a key of their own, not by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, mix
from .components import connected_components
from .simhash import SEED, near_edges, set_fingerprints

SHINGLE, SIMILARITY = 5, (4, 5)
COPIES, MAX_BITS = 8, 2
#: Texts, and their shingles, of a bucket that a task compares at once, levels of further bands, and texts that one salted copy of a text is compared with.
BUCKET, SHINGLES, LEVELS, SALT = 4096, 1 << 20, 3, 256
BANDS, BAND_ROWS = 24, 4
#: Min-hashes of the 96 in which a candidate pair agrees at least: at a similarity of 0.8 six deviations below the mean.
AGREE = 53
_SEEDS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = min(SHINGLE, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x100000001B3) + w[k : k + len(h)])
    return np.unique(h)


def bands(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of min-hashes of a set of shingles, and 16 bits of each min-hash."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(h), 4096):
        least = np.minimum(least, mix(h[k : k + 4096] ^ _SEEDS).min(1))
    grid = least.reshape(BANDS, BAND_ROWS)
    key = np.zeros(BANDS, np.uint64)
    for r in range(BAND_ROWS):
        key = mix(key * np.uint64(0x100000001B3) + grid[:, r])
    return key, least.astype("<u2").tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have SIMILARITY or more."""
    up, down = SIMILARITY
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def _sketches(rows: DataFrame) -> DataFrame:
    """(row, node, size, keys, signature): node stands for the set of shingles, of so many; keys are the fingerprints, then the bands."""
    schema = pa.schema([("row", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column("text")
            nodes, sizes, keys, signatures = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros((len(texts), COPIES + BANDS), np.uint64), []
            for k in range(len(texts)):
                words = words_of(texts[k].as_py())
                h = shingles(words)
                nodes[k], sizes[k] = xxhash.xxh64_intdigest(h.tobytes(), SEED), len(h)
                keys[k, :COPIES] = set_fingerprints(words, 1, COPIES)
                keys[k, COPIES:], signature = bands(h)
                signatures.append(signature)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * (COPIES + BANDS)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(nodes.view(np.int64)), pa.array(sizes), lists, pa.array(signatures, pa.binary())], schema=schema)

    return map_batches(rows, run, "row long, node long, size long, keys array<long>, signature binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose texts (node, text) are near copies, by the exact similarity.

    The texts of u stream past the text of v, which is copied for every SALT of them.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    spark = pairs.sparkSession
    hubs = materialise(pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts")))
    asked = pairs.join(hubs, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), "u")
    others = asked.join(texts.select(F.col("node").alias("u"), "text"), "u").select("v", "salt", "u", F.lit(1).alias("role"), "text")
    firsts = hubs.join(texts.select(F.col("node").alias("v"), "text"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("v").alias("u"), F.lit(0).alias("role"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = firsts.unionByName(others).repartition(parts, "v", "salt").sortWithinPartitions("v", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            us, vs = [], []
            for v, u, role, text in zip(*(batch.column(c).to_pylist() for c in ("v", "u", "role")), batch.column("text"), strict=True):
                own = shingles(words_of(text.as_py()))
                if not role:
                    mine = own
                elif similar(own, mine):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return materialise(map_batches(ordered, run, "u long, v long"))


def similar_components(sets: list[np.ndarray], roots: np.ndarray) -> np.ndarray:
    """For each set the place of the first of its component, over all pairs at SIMILARITY or more and those that share a root."""
    up, down = SIMILARITY
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    begin = np.cumsum(sizes) - sizes
    label = np.full(len(sets), -1, np.int64)
    open_, ids, starts = np.arange(len(sets)), flat, begin  # the sets not reached yet, one after the other in ids
    todo: list[int] = []

    def reach(first: int, hit: np.ndarray) -> None:
        """Of the open sets, those hit and all of their roots join the component of first."""
        nonlocal open_, ids, starts
        hit = np.isin(roots[open_], roots[open_[hit]])
        label[open_[hit]] = first
        todo.extend(open_[hit].tolist())
        ids = ids[np.repeat(~hit, sizes[open_])]
        open_ = open_[~hit]
        starts = np.cumsum(sizes[open_]) - sizes[open_]

    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        reach(first, open_ == first)
        while todo and len(open_):
            x = todo.pop()
            mine = flat[begin[x] : begin[x] + sizes[x]]
            flag[mine] = True
            both = np.add.reduceat(flag[ids].astype(np.int64), starts)
            flag[mine] = False
            hit = down * both >= up * (sizes[x] + sizes[open_] - both)
            if hit.any():
                reach(first, hit)
        todo.clear()
    return label


def _open_buckets(members: DataFrame) -> DataFrame:
    """(bucket, n, shingles): buckets of the members (bucket, node, root, size) that hold several components; of buckets with the same members one."""
    sums = members.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.sum("size").alias("shingles"),
        F.min("root").alias("least"),
        F.max("root").alias("most"),
        F.sum(F.shiftright(F.xxhash64("node"), 32)).alias("sum"),
        F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 32)).alias("sum2"),
    )
    return materialise(sums.filter("least < most").groupBy("n", "shingles", "sum", "sum2").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "shingles"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of the buckets of a stream that is sorted by bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("bucket")[0].as_py() != keys[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _in_buckets(members: DataFrame, fn, schema: pa.Schema, kinds: str) -> DataFrame:
    """Runs a function of a bucket's table to columns, over all buckets."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.repartition(parts, "bucket").sortWithinPartitions("bucket", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_bucket(batches):
            if (got := fn(table)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, schema, strict=True)], schema=schema)

    return map_batches(ordered, run, kinds)


def _near(table: pa.Table) -> list[np.ndarray] | None:
    """The rows (bucket, node, root) of a bucket that agree in AGREE min-hashes or more with one of another root."""
    bucket, node, root = (table.column(c).to_numpy() for c in ("bucket", "node", "root"))
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(node), -1)
    hit = np.zeros(len(node), bool)
    for k in range(len(node) - 1):
        near = ((marks[k + 1 :] == marks[k]).sum(1) >= AGREE) & (root[k + 1 :] != root[k])
        hit[k] |= near.any()
        hit[k + 1 :] |= near
    return [bucket[hit], node[hit], root[hit]] if hit.any() else None


def _joined(table: pa.Table) -> list[np.ndarray] | None:
    """Links (u, v) between the roots of a bucket's rows (bucket, node, root, text) that exact similarity joins."""
    root = table.column("root").to_numpy()
    label = similar_components([shingles(words_of(t.as_py())) for t in table.column("text")], root)
    apart = root != root[label]
    return [root[apart], root[label[apart]]] if apart.any() else None


def _links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that exact similarity finds between nodes (node, root, size, keys, signature) of different components in the buckets of the members (bucket, node)."""
    labels = nodes.select("node", "root", "size")
    members = members.join(labels, "node")
    keys = F.slice("keys", COPIES + 1, BANDS)
    found = None
    for level in range(LEVELS + 1):
        members = materialise(members.join(_open_buckets(members), "bucket"))
        fits = (F.col("n") <= BUCKET) & (F.col("shingles") <= SHINGLES)
        small, large = members.filter(fits).select("bucket", "node", "root"), members.filter(~fits)
        if level == LEVELS:  # no band helps on: all pairs of blocks
            blocks = F.greatest(F.ceil(F.col("n") * 2 / BUCKET), F.ceil(F.col("shingles") * 2 / SHINGLES)).cast("int")
            own = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))
            cut = large.withColumn("blocks", blocks).withColumn("own", own).select("bucket", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            small = small.union(cut.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "root"))
        near = _in_buckets(small.join(nodes.select("node", "signature"), "node").select("bucket", "node", "root", "signature"), _near, _NEAR, "bucket long, node long, root long")
        links = _in_buckets(materialise(near).join(texts, "node").select("bucket", "node", "root", "text"), _joined, _EDGES, "u long, v long")
        found = links if found is None else found.union(links)
        if level == LEVELS or large.isEmpty():
            break
        further = large.select("bucket", "node", "root", "size").join(nodes.select("node", keys.alias("keys")), "node").select("bucket", "node", "root", "size", F.posexplode("keys").alias("band", "key"))
        members = further.select(F.xxhash64("bucket", "band", "key").alias("bucket"), "node", "root", "size")
    return found.distinct()


_NEAR = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("root", pa.int64())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def near_copies(rows: DataFrame) -> DataFrame:
    """(row, root): rows (row, text) of one root are near copies, over links at SIMILARITY or more; row is a key."""
    sketches = materialise(_sketches(rows.select("row", "text")))
    nodes = materialise(sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    each = nodes.select("node", F.posexplode("keys").alias("copy", "fp"))
    shared = materialise(each.groupBy("copy", "fp").agg(F.min("node").alias("v"), F.max("node").alias("most")).filter("v < most").select("copy", "fp", "v"))
    held = materialise(each.join(shared, ["copy", "fp"]))
    same = held.filter("node <> v").groupBy(F.col("node").alias("u")).agg(F.min("v").alias("v"))
    prints = each.filter(F.col("copy") < COPIES).groupBy("copy", "fp").agg(F.min("node").alias("node"))
    # the index's links are those of its lists' members to the least one
    pairs = materialise(near_edges(prints, MAX_BITS).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(same).filter("u <> v").distinct())
    bucketed = held.select("node").union(pairs.select(F.col("u").alias("node"))).union(pairs.select(F.col("v").alias("node"))).distinct()
    asked = materialise(nodes.join(bucketed, "node"))
    texts = materialise(rows.join(asked.select("row", "node"), "row").select("node", "text"))
    edges = verified(pairs, texts)
    labelled = materialise(asked.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")))
    members = held.filter(F.col("copy") >= COPIES).select(F.xxhash64("copy", "fp").alias("bucket"), "node")
    links = materialise(edges.union(_links(members, labelled, texts)))
    roots = connected_components(links)
    return sketches.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
