"""N-gram Jaccard join (operator 8): universe-partition pigeonhole.

A document is the set of its 5-word shingles (64-bit hashes); equal sets are
one node (named by a 64-bit digest of size and hashes).  Sizes fall into bands that grow by ``GROWTH``.
Band b cuts the hash universe into m_b segments, m_b above the largest
difference two linked sets of the band can have, so linked sets agree on at
least one whole segment (pigeonhole).  A set is indexed in its own band and,
if it can link with smaller sets there, in the band below.

1.  Index: one key per (band, non-empty segment, subset).  Keys leave a task
    packed per (part, node); copies of a key inside a task batch are reduced
    to one representative before the shuffle, so a key that a third of all
    documents share costs one row per task batch, not one per document.  The
    number of parts follows the number of keys (``PART_KEYS`` per part).
2.  Stars: every member of a key is paired with one member (the smallest
    node; next, for keys that stay open, the member of most open keys).
    Pairs that the sizes, parities and bucket counts of the sets do not rule
    out are verified exactly on whole sets; links are joined to components.  A key whose
    members are all in one component is closed: no pair inside can add
    anything.
    A set of an open key, or of too few segments for the pigeonhole, stays only if
    at least ``percent`` % of its hashes are in another such set as well:
    a set with more hashes of its own is linked with none of them.
3.  Prefixes: of the sets that stay, each orders its hashes from rare to
    frequent; those that no other component has come first and join nothing.
    Two linked sets share a hash among the first quarter of each, early
    enough that what follows can still reach the threshold.  The smaller set
    of a pair needs a seventh only.  Hashes of more than ``HOT`` sets are dealt
    over several tasks.
Every candidate is verified on whole sets: 100 * |A and B| >= t * |A or B|.

Nothing about all documents reaches the driver but counters and a Bloom
filter of at most 16 MB, which only saves the shuffle of sets that no pair
needs.

Cases: null or empty texts (and texts without words) are the empty set, are
linked with nothing and are their own component.  Fewer than five words make
one shingle.  Repeated rows and ids are kept, one result row per input row;
a null id never names a component unless it has no other id.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.llm.components import connect
from countframe.session import cut_lineage, ship_library

SHINGLE = 5
PERCENT = 75
GROWTH = 1.8
HOT = 4096               # sets that meet one copy of the smaller sets of a prefix hash
BATCH_BYTES = 2 << 20    # text per pre-aggregation batch
PART_KEYS = 3_000_000    # shingles per part of the index
MIN_PARTS = 48
STAR_ROWS = 512          # members verified against one copy of the star's centre
_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class Bands:
    """Upper sizes, number of segments and allowed differences."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        upper = [2]
        while upper[-1] < largest:
            # a set links with sets of its own band and of the next only
            upper.append(max(upper[-1] * 100 // percent + 1, int(upper[-1] * GROWTH)))
        self.upper = np.array(upper, np.int64)
        self.segments = self.upper * (100 - percent) * 5 // (percent * 4) + 8      # a quarter to spare

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, n)

    def places(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which sets, band, largest difference) for the own band and the one below."""
        p = self.percent
        band = self.band(n)
        own = np.flatnonzero(n * (100 - p) >= p)                 # smaller sets equal their partners
        low = own[band[own] > 0]
        low = low[n[low] * p <= self.upper[band[low] - 1] * 100]
        return [(own, band[own], n[own] * (100 - p) // p),
                (low, band[low] - 1, (n[low] + self.upper[band[low] - 1]) * (100 - p) // (100 + p))]


def segment_subsets(h: np.ndarray, row: np.ndarray, segments: np.ndarray):
    """Tokens sorted by (row, segment): (order, start of each subset, its row,
    its segment, its sum); ``segments`` is given per token."""
    seg = (ta.mix64(h ^ _A) % segments.astype(np.uint64)).astype(np.int64)
    order = np.argsort(row << 40 | seg)
    r, s = row[order], seg[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    start = np.flatnonzero(new)
    value = ta.mix64(h[order] ^ _B)
    total = np.add.reduceat(value, start) if len(start) else value
    return order, start, r[start], s[start], total


def key_of(band: np.ndarray, seg: np.ndarray, total: np.ndarray) -> np.ndarray:
    return ta.mix64(total + ta.mix64(seg.astype(np.uint64) * _C + band.astype(np.uint64)))


def node_of(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8, salt=len(h).to_bytes(8, "little")).digest(), "little", signed=True)


def bucket_counts(h: np.ndarray) -> bytes:
    """Hashes per bucket, for a power of two of buckets about as many as
    hashes; counts stop at 255 (then the counts rule nothing out)."""
    buckets = 1 << min(16, max(5, (len(h) - 1).bit_length() if len(h) else 0))
    at = (h >> np.uint64(40)) & np.uint64(buckets - 1)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """Upper bound of the intersection of sets of n and m hashes, from their
    bucket counts."""
    u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if u.max(initial=0) == 255 or v.max(initial=0) == 255:
        return min(n, m)
    u, v = u.astype(np.int64), v.astype(np.int64)
    k = min(len(u), len(v))
    return int(np.minimum(u.reshape(-1, k).sum(axis=0), v.reshape(-1, k).sum(axis=0)).sum())


def text_sets(column, size: int = SHINGLE):
    """(sizes, first, hashes, nodes) of the sets of a string column, in
    batches of about BATCH_BYTES of text."""
    parts, taken = [], 0
    for block, first, h in ta.shingle_sets(column, size):
        parts.append((first, h))
        taken += len(block.data)
        if taken >= BATCH_BYTES:
            yield _joined(parts)
            parts, taken = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    sizes = np.concatenate([np.diff(f) for f, _ in parts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    h = np.concatenate([x for _, x in parts])
    nodes = [node_of(h[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:])]
    return sizes, first, h, nodes


# 0. nodes ------------------------------------------------------------------------
SIGNATURE = tuple(f"s{i}" for i in range(8))
_NODE = "struct<n:bigint,node:bigint>"
_DESCRIBED = "struct<n:bigint,node:bigint,counts:binary,wide:binary," + ",".join(f"{c}:bigint" for c in SIGNATURE) + ">"


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is odd if an odd number of hashes fall on i.  The parities of two
    sets differ in at most as many bits as the sets differ in hashes; a wide
    parity folds to a narrow one by xor of its halves."""
    odd = np.bincount(((h >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def wide_parity(h: np.ndarray) -> bytes:
    """Parity of about two bits a hash, 512 to 65 536 bits."""
    return parity(h, 1 << min(16, max(9, (2 * len(h) - 1).bit_length() if len(h) else 0))).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of two sets, from their wide parities."""
    u, v = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(len(u), len(v))
    both = np.bitwise_xor.reduce(u.reshape(-1, k), axis=0) ^ np.bitwise_xor.reduce(v.reshape(-1, k), axis=0)
    return int(np.bitwise_count(both).sum())


def document_nodes(text, size: int = SHINGLE, described: bool = False):
    """Column struct<n, node>: set size and name (null for the empty set);
    ``described``: with bucket counts and parity signature as well."""

    @F.arrow_udf(_DESCRIBED if described else _NODE)
    def describe(column: pa.Array) -> pa.Array:
        n, nodes, counts, wide, signs = [], [], [], [], []
        for sizes, first, h, own in text_sets(column, size):
            n += sizes.tolist()
            nodes += own
            if described:
                sets = [h[a:b] for a, b in zip(first[:-1], first[1:])]
                counts += [bucket_counts(s) for s in sets]
                wide += [wide_parity(s) for s in sets]
                signs += [parity(s, 64 * len(SIGNATURE)).view(np.int64) for s in sets]
        out = {"n": pa.array(n, pa.int64()), "node": pa.array(nodes, pa.int64())}
        if described:
            signs = np.array(signs, np.int64).reshape(-1, len(SIGNATURE))
            out |= {"counts": pa.array(counts, pa.binary()), "wide": pa.array(wide, pa.binary())} | {c: pa.array(signs[:, i]) for i, c in enumerate(SIGNATURE)}
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return describe(text)


# 1. index ------------------------------------------------------------------------
_INDEX = "part int, node bigint, centre bigint, keys binary"


def _index_rows(parts: int, size: int, bands: Bands):
    def index(batches):
        for batch in batches:
            for sizes, first, h, nodes in text_sets(batch.column(0), size):
                fresh = {x: i for i, x in reversed(list(enumerate(nodes))) if x is not None}
                fresh = np.array(sorted(fresh.values()), np.int64)
                names = np.array([x or 0 for x in nodes], np.int64)
                for which, band, differ in bands.places(sizes[fresh]):
                    if not len(which):
                        continue
                    docs = fresh[which]
                    length = sizes[docs]
                    at = np.repeat(first[docs] - np.cumsum(length) + length, length) + np.arange(length.sum())
                    row = np.repeat(np.arange(len(docs)), length)
                    _, _, r, seg, total = segment_subsets(h[at], row, bands.segments[band][row])
                    few = np.flatnonzero(np.bincount(r, minlength=len(docs)) <= differ)
                    yield from _packed(short_key(key_of(band[r], seg, total), parts), r, names[docs], few)

    return index


def short_key(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a key, and 32 bits of it; keys that only seem equal are
    told apart by verification."""
    return (keys % np.uint64(parts)).astype(np.int64) << 32 | (keys >> np.uint64(32)).astype(np.int64)


def _packed(keys, row, names, few):
    """Rows of one batch: keys of one document only, and representatives of
    shared keys, by part of the key; members of shared keys beside their
    representative; sets with too few segments once more, without keys."""
    order = np.argsort(keys)
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    centre = r[np.flatnonzero(new)][group]
    part = k >> 32
    for chosen, middle in ((new, None), (shared, centre)):
        at = np.flatnonzero(chosen)
        first, second = (part, r) if middle is None else (r, middle)
        at = at[np.argsort(first[at] << 24 | second[at], kind="stable")]     # a batch has less than 2^24 texts
        p, o = first[at], second[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
        start = np.flatnonzero(cut)
        if len(start):
            raw = k[at] if middle is not None else k[at].astype(np.uint32)
            ends = np.append(start, len(at)).astype(np.int32) * raw.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            own = at[start]
            yield pa.RecordBatch.from_arrays([
                pa.array(part[own], pa.int32()), pa.array(names[r[own]]),
                pa.nulls(len(start), pa.int64()) if middle is None else pa.array(names[middle[own]]), packed],
                ["part", "node", "centre", "keys"])
    if len(few):
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(few)), pa.int32()), pa.array(names[few]),
                                          pa.nulls(len(few), pa.int64()), pa.nulls(len(few), pa.binary())],
                                         ["part", "node", "centre", "keys"])


def _meet(batches):
    """One part of the index: members (key, node, centre) of keys of several
    nodes; rows with a centre, and those without keys, pass through."""
    keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def members(k, n, c, null_key=False):
        return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()) if null_key else pa.array(k), pa.array(n), pa.array(c)],
                                          ["key", "node", "centre"])

    for batch in batches:
        packed = batch.column("keys")
        known = packed.is_valid().to_numpy(zero_copy_only=False)
        beside = batch.column("centre").is_valid().to_numpy(zero_copy_only=False)
        centre = batch.column("centre").fill_null(0).to_numpy()
        node, part = batch.column("node").to_numpy(), batch.column("part").to_numpy().astype(np.int64)
        _, off, raw = packed.buffers()
        off = np.frombuffer(off, np.int32)[packed.offset:packed.offset + len(packed) + 1].astype(np.int64) // 4
        raw = np.frombuffer(raw, np.uint32, len(raw) // 4) if raw is not None else np.zeros(0, np.uint32)
        size = np.diff(off)

        def words(rows, width):
            """Where the keys of these rows begin, and whose they are."""
            n = size[rows] // width  # noqa: B023
            owner = np.repeat(rows, n)
            return off[owner] + width * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)), owner  # noqa: B023

        if not known.all():
            yield members(None, node[~known], node[~known], True)
        at, owner = words(np.flatnonzero(known & beside), 2)
        if len(at):
            yield members(raw[at].astype(np.int64) | raw[at + 1].astype(np.int64) << 32, node[owner], centre[owner])
        at, owner = words(np.flatnonzero(known & ~beside), 1)
        keys.append(raw[at].astype(np.int64) | part[owner] << 32)
        nodes.append(node[owner])
    k, n = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.argsort(k)
    k, n = k[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(start):
        return
    size = np.diff(np.append(start, len(k)))
    low, high = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
    some = np.repeat(low != high, size)
    k, n, low = k[some], n[some], np.repeat(low, size)[some]
    for at in range(0, len(k), 1 << 18):
        yield members(k[at:at + (1 << 18)], n[at:at + (1 << 18)], low[at:at + (1 << 18)])


def shared_keys(texts: DataFrame, total: int, size: int, bands: Bands) -> DataFrame:
    """(key, node, centre): members of keys of several nodes, each beside a
    member of the same key; key null: sets with too few segments.  ``total``
    is the number of shingles, which bounds the keys of a part."""
    parts = max(MIN_PARTS, -(-total // PART_KEYS))
    rows = texts.mapInArrow(_index_rows(parts, size, bands), _INDEX).repartitionById(parts, F.col("part"))
    return rows.mapInArrow(_meet, "key bigint, node bigint, centre bigint")


# 2. verification -----------------------------------------------------------------
def bloom(values: DataFrame, count: int) -> np.ndarray:
    """Bits set for the longs in column v; between 2^16 and 2^27 bits."""
    bits = 1 << min(27, max(16, (16 * count).bit_length()))
    at = F.pmod(F.xxhash64("v"), F.lit(bits))
    words = (values.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(v), {bits}) & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def over_sets(docs: DataFrame, wanted: DataFrame, size: int, emit, schema: str) -> DataFrame:
    """What ``emit`` (of nodes, first, hashes; each node once) yields for the
    sets of ``wanted`` (place), made again from (place, text) rows in batches;
    other texts are passed over by a Bloom filter of places (a few are not)."""
    spark = docs.sparkSession
    values = wanted.select(F.col("place").alias("v"))
    shared = spark.sparkContext.broadcast(bloom(values, values.count()))
    bits = len(shared.value) * 64

    def run(batches):
        filled = shared.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            some = np.flatnonzero((filled[at >> 6] >> (at & 63)) & 1)
            if not len(some):
                continue
            for _, first, h, own in text_sets(batch.column("text").take(pa.array(some)), size):
                keep = {x: i for i, x in enumerate(own) if x is not None}
                if keep:
                    yield from emit(keep, first, h)

    rows = docs.select(F.pmod(F.xxhash64("place"), F.lit(bits)).alias("at"), "text")
    return rows.mapInArrow(run, schema)


def needed_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes): the sets of ``wanted`` (node, place), made again from (place, text) rows."""

    def emit(keep, first, h):
        yield pa.RecordBatch.from_arrays([
            pa.array(list(keep), pa.int64()),
            pa.array([h[first[i]:first[i + 1]].tobytes() for i in keep.values()], pa.binary())], ["node", "hashes"])

    rows = over_sets(docs, wanted, size, emit, "node bigint, hashes binary")
    return cut_lineage(rows.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def alone(docs: DataFrame, wanted: DataFrame, total: int, size: int) -> DataFrame:
    """(node, own): how many hashes of a node no other node of ``wanted``
    (place) has, at least: hashes are compared by 32 bits and their part.
    ``total`` is the number of shingles, which bounds the hashes of a part."""
    parts = max(MIN_PARTS, -(-total // PART_KEYS))

    def emit(keep, first, h):
        names = np.array(list(keep), np.int64)
        docs = np.array(list(keep.values()), np.int64)
        length = first[docs + 1] - first[docs]
        row = np.repeat(np.arange(len(docs)), length)
        at = np.repeat(first[docs] - np.cumsum(length) + length, length) + np.arange(len(row))
        key = short_key(ta.mix64(h[at] ^ _A), parts)
        part = key >> 32
        order = np.argsort(part << 24 | row, kind="stable")                 # a batch has less than 2^24 texts
        part, row, raw = part[order], row[order], key[order].astype(np.uint32)
        start = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])]))
        ends = np.append(start, len(raw)).astype(np.int32) * np.int32(4)
        packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(part[start], pa.int32()), pa.array(names[row[start]]), packed], ["part", "node", "keys"])

    def count(batches):
        keys, nodes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for batch in batches:
            packed = batch.column("keys")
            _, off, raw = packed.buffers()
            off = np.frombuffer(off, np.int32)[packed.offset:packed.offset + len(packed) + 1] // 4
            if len(off) > 1 and off[-1] > off[0]:
                keys.append(np.frombuffer(raw, np.uint32, len(raw) // 4)[off[0]:off[-1]].copy())
                nodes.append(np.repeat(batch.column("node").to_numpy(), np.diff(off)))
        k, n = np.concatenate(keys), np.concatenate(nodes)
        del keys, nodes
        if not len(k):
            return
        order = np.argsort(k)
        k, n = k[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        low, high = np.minimum.reduceat(n, start), np.maximum.reduceat(n, start)
        names, own = np.unique(low[low == high], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own.astype(np.int64))], ["node", "own"])

    rows = over_sets(docs, wanted, size, emit, "part int, node bigint, keys binary").repartitionById(parts, F.col("part"))
    return rows.mapInArrow(count, "node bigint, own bigint").groupBy("node").agg(F.sum("own").alias("own"))


def close(percent: int) -> str:
    """SQL: can sets x and y (columns nx, x0, .., ny, y0, ..) link, by size and parity?"""
    bits = " + ".join(f"bit_count(x{i} ^ y{i})" for i in range(len(SIGNATURE)))
    return (f"least(nx, ny) * 100 >= {percent} * greatest(nx, ny) AND "
            f"{bits} <= (nx + ny) * {100 - percent} div {100 + percent}")


def signed(rows: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """``rows`` (with a column node) beside size and signature, named for ``side``."""
    return rows.join(nodes.select("node", F.col("n").alias(f"n{side}"), *[F.col(c).alias(f"{side}{c[1]}") for c in SIGNATURE]),
                     "node").withColumnRenamed("node", side)


def some_rows(*columns, size: int = 256):
    """Rows of Arrow columns as tuples; only ``size`` of them are Python
    objects at a time."""
    for at in range(0, len(columns[0]), size):
        yield from zip(*(c.slice(at, size).to_pylist() for c in columns))


def narrowed(pairs: DataFrame, nodes: DataFrame, column: str, keep) -> DataFrame:
    """The pairs (a, b, nx, ny) that ``keep`` (of both sizes and both values
    of a column of the nodes) does not rule out."""

    @F.arrow_udf("boolean")
    def check(n: pa.Array, m: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
        return pa.array([keep(*z) for z in some_rows(n, m, u, v)], pa.bool_())

    side = nodes.select("node", column)
    met = pairs.join(side.toDF("a", "u"), "a").join(side.toDF("b", "v"), "b")
    return cut_lineage(met.where(check(*(F.col(c) for c in ("nx", "ny", "u", "v")))).select("a", "b", "nx", "ny"))


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b): the members b of a centre a
    come beside a copy of a's set, at most STAR_ROWS of them per copy."""
    near = F.expr(close(percent))
    pairs = signed(signed(pairs.select(F.col("a").alias("node"), "b"), nodes, "x").withColumnRenamed("b", "node"), nodes, "y")
    pairs = pairs.where(near).select(F.col("x").alias("a"), F.col("y").alias("b"), "nx", "ny")
    pairs = narrowed(pairs, nodes, "wide", lambda n, m, u, v: least_difference(u, v) <= (n + m) * (100 - percent) // (100 + percent))

    def counts_allow(n, m, u, v):
        k = most_common(u, v, n, m)
        return k * 100 >= percent * (n + m - k)

    pairs = narrowed(pairs, nodes, "counts", counts_allow).select("a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = needed_sets(docs, cut_lineage(ends.join(nodes.select("node", "place"), "node")), size)
    copies = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / STAR_ROWS).cast("int").alias("copies"))
    members = (pairs.join(copies, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("copies")))
               .join(sets.select(F.col("node").alias("b"), F.col("hashes")), "b")
               .select("a", "salt", "b", "hashes"))
    centres = (copies.join(sets.select(F.col("node").alias("a"), F.col("hashes")), "a")
               .select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"),
                       F.lit(None).cast("bigint").alias("b"), "hashes"))

    def match(batches):
        now, centre = None, None
        for batch in batches:
            out = []
            for x, y, s in some_rows(*(batch.column(c) for c in ("a", "b", "hashes"))):
                s = np.frombuffer(s, np.uint64)
                if y is None:
                    now, centre = x, s
                    continue
                if x != now:
                    raise ValueError("a pair came without its centre")
                both = len(np.intersect1d(centre, s, assume_unique=True))
                if both * 100 >= percent * (len(centre) + len(s) - both):
                    out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()),
                                                  pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = (centres.unionByName(members).repartition(parts, "a", "salt")
                .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()))
    return cut_lineage(together.mapInArrow(match, "a bigint, b bigint"))


# 3. prefixes ----------------------------------------------------------------------
def exploded(batches):
    """(node, comp, hashes) -> (h, node, comp)."""
    for batch in batches:
        got, rows = [], 0
        for node, comp, raw in some_rows(*(batch.column(c) for c in ("node", "comp", "hashes"))):
            got.append((np.frombuffer(raw, np.int64), node, comp))
            rows += len(raw) // 8
            if rows > 1 << 16:
                yield _hash_batch(got)
                got, rows = [], 0
        if got:
            yield _hash_batch(got)


def _hash_batch(got):
    size = [len(h) for h, _, _ in got]
    spread = lambda i: pa.array(np.repeat(np.array([g[i] for g in got], np.int64), size))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[0] for g in got])), spread(1), spread(2)], ["h", "node", "comp"])


def prefix_pairs(sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """Distinct pairs (a, b) of sets (node, n, comp, hashes) of different
    components that the order of their hashes does not rule out.  A hash that
    comes first among the common ones leaves both sets what follows it."""
    tokens = sets.select("node", "comp", "hashes").mapInArrow(exploded, "h bigint, node bigint, comp bigint")
    often = (tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low <> high").select("h", "df"))
    ordered = (tokens.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
               .join(sets.select("node", "n", "comp"), "node").withColumn("own", F.col("n") - F.size("common"))
               .where(f"(n - own) * 100 >= {percent} * n"))
    # after the hash at rank i of n, n - i hashes are left, itself included
    length = F.expr(f"cast(n - own - ceil({percent} * n / 100) + 1 as int)")
    prefix = cut_lineage(ordered.select("node", "n", "comp", "own", F.posexplode(F.slice("common", F.lit(1), length)).alias("i", "e"))
                         .select(F.col("e.h").alias("h"), "node", "n", "comp", (F.col("n") - F.col("own") - F.col("i")).alias("left")))
    met = prefix.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("copies"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    dealt = prefix.join(met.where("low <> high").select("h", "copies"), "h")
    larger = dealt.select("h", F.pmod(F.hash("node"), "copies").alias("salt"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("left").alias("lx"))
    smaller = (dealt.where(f"left * {100 + percent} >= {2 * percent} * n")
               .select("h", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("left").alias("ly")))
    can = (f"cx <> cy AND (ny < nx OR ny = nx AND y < x) AND ny * 100 >= {percent} * nx "
           f"AND least(lx, ly) * {100 + percent} >= {percent} * (nx + ny)")
    found = larger.join(smaller, (larger["h"] == smaller["h"]) & (larger["salt"] == smaller["salt"]) & F.expr(can))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


# the join -------------------------------------------------------------------------
def cluster(docs: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = PERCENT,
            size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row per input row: (id, n_shingles, node, component, component_id,
    links).  component names the node's component, component_id is the
    smallest id reachable by links of at least ``percent`` % similarity, links
    counts the verified links of the node."""
    ship_library(docs.sparkSession)
    bands = Bands(percent)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(row_id).alias("id"), document_nodes(body, size, described=True).alias("d"))
    rows = cut_lineage(rows.select("id", F.col("d.n").alias("n_shingles"), "d.node", "d.counts", "d.wide", *[f"d.{c}" for c in SIGNATURE]))
    # where a text is found again: a hash of its row's id
    place = lambda c: F.xxhash64(F.col(c))
    nodes = cut_lineage(rows.where("n_shingles > 0").select("node", F.col("n_shingles").alias("n"), place("id").alias("place"), "counts", "wide", *SIGNATURE)
                        .dropDuplicates(["node"]))
    texts = docs.select(place(row_id).alias("place"), body.alias("text"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    members = cut_lineage(shared_keys(texts.select("text"), total, size, bands))
    check = lambda pairs: verify(pairs, nodes, texts, percent, size)

    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = members.where("key IS NOT NULL AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    tested = [cut_lineage(stars.distinct())]
    links = [check(tested[0])]
    comp = connect(links[0])

    def named(frame: DataFrame, column: str, out: str) -> DataFrame:
        """With the component of ``column`` (its own name without links) as ``out``."""
        got = frame.join(comp.select(F.col("node").alias(column), F.col("comp").alias("__cf_c")), column, "left")
        return got.withColumn(out, F.coalesce("__cf_c", column)).drop("__cf_c")

    # members of keys that span components, and sets with too few segments:
    # those that have enough hashes in common with the others of them
    open_pairs = named(named(tested[0], "a", "ca"), "b", "cb").where("ca <> cb").select(F.col("a").alias("centre"), F.col("b").alias("node"))
    keys = members.where("key IS NOT NULL").join(open_pairs, ["centre", "node"], "left_semi").select("key").distinct()
    opened = cut_lineage(members.select("key", "node").join(keys, "key", "left_semi"))
    few = members.where("key IS NULL").select("node")
    apart = cut_lineage(opened.select("node").unionByName(few).distinct().join(nodes.select("node", "n", "place"), "node"))
    apart = cut_lineage(apart.join(alone(texts, apart, total, size), "node", "left")
                        .where(f"(n - coalesce(own, 0)) * 100 >= {percent} * n").select("node", "n", "place"))

    # the second star joins them to the member of most such keys
    opened = cut_lineage(opened.join(apart, "node", "left_semi").distinct())
    weight = opened.groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    centre = opened.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", "node")).alias("a"))
    second = named(named(opened.join(centre, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(),
                         "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    tested.append(cut_lineage(second.join(tested[0], ["a", "b"], "left_anti")))
    links.append(check(tested[1]))
    comp = connect(reduce(DataFrame.unionByName, links))

    # what is still linked across components shares a hash early
    sets = named(apart, "node", "comp").join(needed_sets(texts, apart, size), "node")
    rest = prefix_pairs(cut_lineage(sets.select("node", "n", "comp", "hashes")), percent, hot)
    for done in tested:
        rest = rest.join(done.select(pair(F.col("a"), F.col("b")).alias("p")).select("p.a", "p.b"), ["a", "b"], "left_anti")
    links.append(check(cut_lineage(rest)))
    every = reduce(DataFrame.unionByName, links)
    comp = connect(every)

    # ids: the smallest of each node, then of each component
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("own"))
    classes = ids.join(comp, "node", "left").select("node", "own", F.coalesce("comp", "node").alias("comp"))
    least = classes.groupBy("comp").agg(F.min("own").alias("component_id"))
    ends = every.select(pair(F.col("a"), F.col("b")).alias("p")).distinct().select(F.explode(F.array("p.a", "p.b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    classes = classes.join(least, "comp").join(degree, "node", "left").select("node", "comp", "component_id", "links")
    return (rows.join(classes, "node", "left")
            .select("id", "n_shingles", "node", F.col("comp").alias("component"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("links", F.lit(0)).alias("links")))
