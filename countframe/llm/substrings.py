"""Substring dedup (operator 11): count-min prefilter, then exact grouping.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it occurs, word by word, at another place as well, in the
same document or another; windows are judged on the input.

1.  Sketch.  A window's key is the least of the hashes of its ``GRAM``-word
    runs (the leftmost of ties): equal windows have equal keys, at places of
    their own, so a key counts at least as often as each of its windows.
    Every partition counts its keys (each place once, about two in 25 words)
    in a count-min sketch of ``DEPTH`` rows with cells that stop at 2; sketches
    are merged cell by cell.  Estimates are never too low.
2.  Exact grouping.  A second pass sends on only windows whose key is
    estimated to occur twice, and groups them by key and 64-bit hash.  A batch
    of about ``BATCH_BYTES`` of text settles by itself the windows that it
    holds twice and sends every distinct window once (with a mark if it is
    settled), so a passage that a third of all documents share costs one
    entry a batch.  Consecutive windows share their key and travel as one row.
3.  Repeated windows go back to their documents as word spans, texts meet
    them once, and the words outside are kept.

Scale: the sketch grows with the text up to ``MAX_CELLS`` (16 MB in the
driver and the broadcast).  A corpus too large for that fills the cells, more
windows go to the grouping, in the end all (about 10 bytes a word); the result
stays the same.  Parts of the grouping follow the text's size.  Nothing is
capped or sampled.

Windows are compared by 128 bits (hash of the key's words, hash of all
words), and documents named by 128 bits of id and text.  Rows equal in both
are one document for that, and get one result, as all their windows repeat.

Cases: null and empty texts, and texts without words, have no words and an
empty kept text; texts shorter than a window keep their words.  Ids can be
null, repeated and of any type that casts to string.  An empty table gives an
empty one.  Other columns pass through; input columns named like an output
are replaced.  Input rows must come in the same order when a task is repeated,
as from files or a written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import ship_library

WINDOW = 35
GRAM = 12
DEPTH = 2
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
WORD_BYTES = 6                 # of an average word with its space: sizes only
CHUNK = 1 << 12                # bytes of a sketch that travel as one row
BATCH_BYTES = 16 << 20
PART_WINDOWS = 3_000_000
MIN_PARTS = 48
_ROW_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# windows and keys -----------------------------------------------------------------
def least_of_each(value: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    n = len(value) - size + 1
    have, width = value, 1
    while 2 * width <= size:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    return np.minimum(have[:n], have[size - width:][:n])


def keyed_windows(words: ta.Words, window: int):
    """(first word, hash, place of the key, key) of every window of a block."""
    at, h = ta.windows(words, window)
    if not len(at):
        return at, h, at, h
    gram = min(GRAM, window)
    begin, grams = ta.windows(words, gram)
    place_bits = ta.U64(len(words.hash).bit_length())
    ranked = np.full(len(words.hash) - gram + 1, np.iinfo(np.uint64).max, np.uint64)
    ranked[begin] = grams >> place_bits << place_bits | begin.astype(np.uint64)
    place = (least_of_each(ranked, window - gram + 1)[at] & ((ta.U64(1) << place_bits) - ta.U64(1))).astype(np.int64)
    full = np.zeros(len(ranked), np.uint64)
    full[begin] = grams
    return at, h, place, full[place]


# 1. sketch ------------------------------------------------------------------------
def cells_for(octets: int) -> int:
    """Cells of a sketch: eight for each key to be expected, within the bounds."""
    keys = octets // (WORD_BYTES * ((WINDOW - GRAM) // 2 + 1))
    return min(MAX_CELLS, max(MIN_CELLS, 1 << (8 * keys).bit_length()))


def cells_of(key: np.ndarray, cells: int) -> np.ndarray:
    """DEPTH x keys: the cell of every key in every row of the sketch."""
    width = cells // DEPTH
    shift = ta.U64(64 - (width.bit_length() - 1))
    return np.stack([(ta.mix64(key * ta.U64(f)) >> shift).astype(np.int64) + r * width for r, f in enumerate(_ROW_FACTORS)])


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    for b in range(8):
        bits[at[at & 7 == b] >> 3] |= 1 << b


def _get(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Sketch:
    """Cells that count to 2, as two bit maps: at least once, at least twice."""

    def __init__(self, cells: int):
        self.cells = cells
        self.once, self.twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        at, n = np.unique(cells_of(keys, self.cells), return_counts=True)
        _set(self.twice, at[(n > 1) | _get(self.once, at)])
        _set(self.once, at)


def _count(cells: int, window: int):
    def count(batches):
        sketch = Sketch(cells)
        for batch in batches:
            for block in ta.blocks(batch.column(0)):
                _, _, place, key = keyed_windows(ta.Words(block, ta.NON_SPACE, lower=False), window)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]         # places ascend: every place once
                sketch.add(key[new])
        once, twice = sketch.once.reshape(-1, CHUNK), sketch.twice.reshape(-1, CHUNK)
        used = np.flatnonzero(once.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([once[i].tobytes() for i in some], pa.binary()),
                                              pa.array([twice[i].tobytes() for i in some], pa.binary())], ["chunk", "once", "twice"])

    return count


def _merge(batches):
    """Chunks of all partitions, added cell by cell."""
    once, twice = {}, {}
    for batch in batches:
        for c, o, t in zip(*(batch.column(i) for i in range(3))):
            c, o, t = c.as_py(), np.frombuffer(o.as_buffer(), np.uint8), np.frombuffer(t.as_buffer(), np.uint8)
            if c not in once:
                once[c], twice[c] = o.copy(), t.copy()
            else:
                twice[c] |= t | (once[c] & o)
                once[c] |= o
    some = [c for c in twice if twice[c].any()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([twice[c].tobytes() for c in some], pa.binary())], ["chunk", "twice"])


def sketched(texts: DataFrame, cells: int, window: int = WINDOW) -> np.ndarray:
    """The merged sketch of a frame of one text column: the bit map of cells counted twice."""
    out = np.zeros(cells // 8, np.uint8)
    rows = texts.mapInArrow(_count(cells, window), "chunk int, once binary, twice binary")
    merged = rows.repartition(max(1, min(cells // 8 // CHUNK, MIN_PARTS)), "chunk").mapInArrow(_merge, "chunk int, twice binary").toArrow()
    for c, t in zip(merged["chunk"].to_pylist(), merged["twice"].to_pylist()):
        out[c * CHUNK:(c + 1) * CHUNK] = np.frombuffer(t, np.uint8)
    return out


def perhaps_repeated(key: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Is a key estimated to occur twice?"""
    return np.logical_and.reduce([_get(twice, at) for at in cells_of(key, 8 * len(twice))]) if len(key) else np.zeros(0, bool)


# 2. exact grouping -----------------------------------------------------------------
_SENT = "part int, key bigint, k1 bigint, k2 bigint, first int, steps binary, hashes binary, spans binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_SPANS = "k1 bigint, k2 bigint, spans binary"


def _binary(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """Runs of a flat array as binary values; run i begins at start[i]."""
    ends = np.append(start, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def spans_of(owner: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, pa.Array]:
    """Windows (owner, first word), in that order -> (owners, their united
    word spans as binary int32 pairs)."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    pairs = np.stack([start[first], start[last] + window], axis=1).astype(np.int32)
    whose = owner[first]
    head = np.ones(len(whose), bool)
    head[1:] = whose[1:] != whose[:-1]
    at = np.flatnonzero(head)
    return whose[at], _binary(pairs.ravel(), 2 * at)


def _send(shared, parts: int, window: int):
    """(text, k1, k2) batches -> rows of _SENT: distinct windows that may be
    repeated, by key, and spans of those that the batch itself repeats."""

    def flush(got):
        doc, start, place, key, h, k1, k2 = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((key, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        here = np.zeros(len(h), bool)
        here[order] = often                                     # this batch holds it twice
        sent = np.zeros(len(h), bool)
        sent[order[new]] = True
        at = np.flatnonzero(here)
        if len(at):
            whose, spans = spans_of(doc[at], start[at], window)
            n = len(whose)
            yield pa.RecordBatch.from_arrays(
                [pa.array((k1[whose].view(np.uint64) % ta.U64(parts)).astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(k1[whose]), pa.array(k2[whose]),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), spans], _SENT_NAMES)
        at = np.flatnonzero(sent)
        new = np.ones(len(at), bool)
        new[1:] = (doc[at][1:] != doc[at][:-1]) | (place[at][1:] != place[at][:-1])
        first = np.flatnonzero(new)
        steps = (start[at] - np.repeat(start[at][first], np.diff(np.append(first, len(at))))).astype(np.uint16)
        marked = h[at] >> ta.U64(1) << ta.U64(1) | here[at].astype(np.uint64)
        own = at[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array((ta.mix64(key[own]) % ta.U64(parts)).astype(np.int32)), pa.array(key[own].view(np.int64)), pa.array(k1[doc[own]]), pa.array(k2[doc[own]]),
             pa.array(start[own].astype(np.int32)), _binary(steps, first), _binary(marked, first), pa.nulls(len(own), pa.binary())],
            _SENT_NAMES)

    def send(batches):
        got, taken, docs, places = [], 0, 0, 0
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for block in ta.blocks(batch.column("text")):
                words = ta.Words(block, ta.NON_SPACE, lower=False)
                at, h, place, key = keyed_windows(words, window)
                some = perhaps_repeated(key, shared.value)
                at, h, place, key = at[some], h[some], place[some], key[some]
                row = words.row[at]
                rows = slice(block.first, block.first + block.n)
                got.append((row + docs, at - words.first[row], place + places, key, h, k1[rows], k2[rows]))
                docs, places, taken = docs + block.n, places + len(words.hash), taken + len(block.data)
                if taken >= BATCH_BYTES:
                    if any(len(g[0]) for g in got):
                        yield from flush(got)
                    got, taken, docs, places = [], 0, 0, 0
        if any(len(g[0]) for g in got):
            yield from flush(got)

    return send


def _group(window: int):
    """One part of the windows: spans of those that occur twice."""

    def group(batches):
        keys, docs, starts, marks = [], [], [], []
        k1s, k2s, n_rows = [], [], 0
        for batch in batches:
            settled = batch.column("spans").is_valid()
            if settled.to_numpy(zero_copy_only=False).any():
                own = batch.filter(settled)
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("k1", "k2", "spans")], ["k1", "k2", "spans"])
                batch = batch.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            h, size = _flat(batch.column("hashes"), np.uint64)
            steps, _ = _flat(batch.column("steps"), np.uint16)
            keys.append(np.repeat(batch.column("key").to_numpy(), size))
            docs.append(np.repeat(np.arange(n_rows, n_rows + len(size)), size))
            starts.append(np.repeat(batch.column("first").to_numpy(), size) + steps)
            marks.append(h)
            k1s.append(batch.column("k1").to_numpy())
            k2s.append(batch.column("k2").to_numpy())
            n_rows += len(size)
        if not n_rows:
            return
        key, doc, start, h = (np.concatenate(x) for x in (keys, docs, starts, marks))
        del keys, docs, starts, marks
        settled, h = (h & ta.U64(1)).astype(bool), h >> ta.U64(1)
        order = np.lexsort((key, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        first = np.flatnonzero(new)
        times = np.add.reduceat(1 + settled[order].astype(np.int64), first)
        repeated = np.zeros(len(h), bool)
        repeated[order] = np.repeat(times > 1, np.diff(np.append(first, len(h))))
        at = np.flatnonzero(repeated & ~settled)
        if len(at):
            whose, spans = spans_of(doc[at], start[at], window)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k1s)[whose]), pa.array(np.concatenate(k2s)[whose]), spans], ["k1", "k2", "spans"])

    return group


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all values, values per row) of a binary column without nulls."""
    _, off, raw = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset:column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    values = np.frombuffer(raw, np.uint8)[off[0]:off[-1]].copy().view(kind) if raw is not None else np.zeros(0, kind)
    return values, np.diff(off) // width


# 3. texts --------------------------------------------------------------------------
def keys_of(row_id, text) -> list:
    """Two longs that name a document by id and text."""
    name = F.coalesce(row_id.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), row_id.isNull(), name, text).alias("k1"), F.xxhash64(F.lit(2), text, name, row_id.isNull()).alias("k2")]


def repeated_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id", window: int = WINDOW,
                   cells: int | None = None) -> DataFrame:
    """(k1, k2, spans): per document with repeated windows, lists of word
    spans (binary pairs of int32, first word and end) that may overlap."""
    spark = docs.sparkSession
    ship_library(spark)
    body = F.col(f"`{text}`").cast("string")
    texts = docs.select(body.alias("text"))
    octets = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(sketched(texts, cells or cells_for(octets), window))
    parts = max(MIN_PARTS, -(-octets // (WORD_BYTES * PART_WINDOWS)))
    sent = docs.select(body.alias("text"), *keys_of(F.col(f"`{row_id}`"), body)).mapInArrow(_send(shared, parts, window), _SENT)
    found = sent.repartitionById(parts, F.col("part")).mapInArrow(_group(window), _SPANS)
    return found.groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans"))


def without(text, spans):
    """Column struct<n_words, n_removed, kept> of a text and its lists of word spans."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        counts, removed, texts = [], [], []
        for text, own in zip(column, spans):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if own.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, e in np.concatenate([np.frombuffer(x, np.int32) for x in own.as_py()]).reshape(-1, 2):
                    gone[s] += 1
                    gone[e] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
            removed.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["n_words", "n_removed", "kept"])

    return cut(text, spans)


def remove(docs: DataFrame, text: str = "text", row_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` plus n_words, n_removed and kept: the words outside repeated
    windows, joined by one space."""
    added = ("n_words", "n_removed", "kept")
    names = [c for c in docs.columns if c not in added]
    body = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), body.alias("text"), *keys_of(F.col(f"`{row_id}`"), body))
    met = rows.join(repeated_spans(docs, text, row_id, window), ["k1", "k2"], "left")
    done = met.select("row", without("text", "spans").alias("found"))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(f"found.{c}").alias(c) for c in added])
