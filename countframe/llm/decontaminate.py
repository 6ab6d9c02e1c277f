"""Benchmark decontamination (operator 1).

The normalised n-word windows of the benchmark items are hashed on the
driver's side of a size check, broadcast as sorted numpy arrays, and every
document is scanned row-locally: all its word windows are hashed, looked up,
and each hit is verified against the item's own words.  Nothing shuffles.

Bound: one broadcast holds items of at most ``max_broadcast_bytes`` of text
(a single longer item is a block of its own).  A larger benchmark is dealt
into blocks by a hash of the item; the documents then pass through one scan
per block, each materialised before the next, and the spans are united.

Cases: a null or empty text has no words and no hits.  An item of 1 to n-1
words is one window of its own length; an item without words never occurs.
Repeated items or documents give the same result for each row.  An item
without id still marks its words, but is not listed.  An empty benchmark
leaves everything clean.  Extra columns pass through untouched; an input
column with the name of an output column is replaced by the output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.llm import textarrays as ta
from countframe.session import cut_lineage, ship_library

WINDOW = 10
MAX_BROADCAST_BYTES = 32 << 20
SPAN = "array<struct<start:int,end:int,item:string>>"


class WindowIndex:
    """Hashed windows of benchmark items with what is needed to verify a hit:
    each item's normalised words (joined by one space) and word positions."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.size = size
        self.ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.large_string())
        parts: list[tuple[np.ndarray, ...]] = []
        self.words: list[bytes] = []
        self.starts: list[np.ndarray] = []
        for block in ta.blocks(texts):
            w = ta.Words(block, ta.ALNUM)
            low = ta.LOWER[block.data].tobytes()
            for r in range(block.n):
                got = [low[s:e] for s, e in zip(w.start[w.first[r]:w.first[r + 1]], w.end[w.first[r]:w.first[r + 1]])]
                self.words.append(b" ".join(got))
                self.starts.append(np.cumsum([0] + [len(g) + 1 for g in got]).astype(np.int32))
            for length in range(1, size + 1):
                at, h = ta.windows(w, length)
                if length < size:
                    whole = w.counts[w.row[at]] == length
                    at, h = at[whole], h[whole]
                row = w.row[at]
                parts.append((h, row + block.first, at - w.first[row], np.full(len(h), length)))
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*parts)] or [np.zeros(0, np.int64)] * 4
        order = np.argsort(cols[0].astype(np.uint64), kind="stable")
        self.hash = cols[0].astype(np.uint64)[order]
        self.item, self.at, self.length = (c[order].astype(np.int32) for c in cols[1:])
        self.lengths = sorted(set(self.length.tolist()))
        self.seen = np.zeros(1 << 20, bool)         # first 20 bits of the hashes: a cheap first test
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def window(self, k: int) -> bytes:
        s, a, n = self.starts[self.item[k]], self.at[k], self.length[k]
        return self.words[self.item[k]][s[a]:s[a + n] - 1]

    def spans(self, column) -> tuple[list[int], list[list[dict]]]:
        """Per text: number of words, and the verified occurrences as word
        spans [start, end) united per item."""
        counts: list[int] = []
        found: list[list[dict]] = [[] for _ in range(len(column))]
        for block in ta.blocks(column):
            w = ta.Words(block, ta.ALNUM)
            counts += w.counts.tolist()
            hits: dict[tuple[int, int], list[list[int]]] = {}
            for length in self.lengths:
                at, h = ta.windows(w, length)
                maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                left = np.searchsorted(self.hash, h[maybe], "left")
                right = np.searchsorted(self.hash, h[maybe], "right")
                for m, lo, hi in zip(maybe[left < right], left[left < right], right[left < right]):
                    a = int(at[m])
                    row = int(w.row[a])
                    words = [block.data[s:e] for s, e in zip(w.start[a:a + length], w.end[a:a + length])]
                    text = b" ".join(ta.LOWER[x].tobytes() for x in words)
                    for k in range(lo, hi):
                        if self.length[k] == length and self.window(k) == text:
                            hits.setdefault((row, int(self.item[k])), []).append([a - int(w.first[row]), length])
            for (row, item), where in hits.items():
                united: list[list[int]] = []
                for s, n in sorted(where):
                    if united and s <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], s + n)
                    else:
                        united.append([s, s + n])
                found[block.first + row] += [{"start": s, "end": e, "item": self.ids[item]} for s, e in united]
        return counts, found


def _finder(shared):
    """Arrow function: texts -> number of words and verified spans."""
    entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())])

    @F.arrow_udf(f"struct<n:bigint,spans:{SPAN}>")
    def find(column: pa.Array) -> pa.Array:
        counts, found = shared.value.spans(column)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(found, pa.list_(entry))], ["n", "spans"])

    return find


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW,
         max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` plus n_words, n_hit, spans (word spans with the item found),
    items (distinct item ids as sorted strings) and contaminated."""
    spark = docs.sparkSession
    ship_library(spark)
    size = benchmark.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    n_blocks = max(1, -(-size // max_broadcast_bytes))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    spans, passes = "__cf_spans", docs
    for b in range(n_blocks):
        # bounded: about max_broadcast_bytes of item text (sizes checked above)
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(WindowIndex([(r[0], r[1]) for r in block], window))

        got = _finder(shared)(F.col(text).cast("string"))
        if b == 0:
            passes = passes.withColumn(spans, got)
        else:
            passes = cut_lineage(passes).withColumn("__cf_more", got).withColumn(
                spans, F.struct(F.col(f"{spans}.n").alias("n"),
                                F.concat(f"{spans}.spans", "__cf_more.spans").alias("spans"))).drop("__cf_more")
    hit = F.size(F.array_distinct(F.flatten(F.transform(f"{spans}.spans", lambda x: F.sequence(x["start"], x["end"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.filter(F.col(f"{spans}.spans.item"), lambda x: x.isNotNull())))
    return (passes.withColumn("n_words", F.col(f"{spans}.n"))
            .withColumn("n_hit", hit.cast("bigint"))
            .withColumn("items", ids)
            .withColumn("spans", F.col(f"{spans}.spans"))
            .withColumn("contaminated", F.col("n_hit") > 0)
            .drop(spans))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "document",
                  **options) -> DataFrame:
    """The columns of ``docs`` without benchmark passages.

    mode "document": contaminated documents go.  mode "span": the hit words
    (with what stands between them) are cut out of the text, and a document
    that loses its last word goes."""
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    keep = [F.col(f"__cf_in.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__cf_in"),
                         F.col(f"`{text}`").cast("string").alias("__cf_text"))
    found = scan(packed, benchmark, text="__cf_text", **options)
    if mode == "document":
        return found.where(~F.col("contaminated")).select(*keep)

    @F.arrow_udf("string")
    def cut(column: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array(cut_spans(column, spans.to_pylist()), pa.string())

    cleaned = F.when(F.col("contaminated"), cut(F.col("__cf_text"), F.col("spans"))).otherwise(F.col("__cf_text"))
    out = found.where((F.col("n_hit") < F.col("n_words")) | ~F.col("contaminated")).withColumn("__cf_text", cleaned)
    return out.select(*[F.col("__cf_text").alias(c) if c == text else k for c, k in zip(docs.columns, keep)])


def cut_spans(column, spans: list[list[dict] | None]) -> list[str | None]:
    """Texts without the given word spans; other texts stay as they are."""
    out = column.to_pylist()
    for block in ta.blocks(column):
        w = ta.Words(block, ta.ALNUM)
        for r in range(block.n):
            gone = sorted((s["start"], s["end"]) for s in spans[block.first + r] or [])
            if not gone:
                continue
            raw, at, kept = block.text(r), 0, b""
            base, f = int(block.offsets[r]), int(w.first[r])
            for s, e in gone:
                a, z = int(w.start[f + s]) - base, int(w.end[f + e - 1]) - base
                kept += raw[at:a] if a > at else b""
                at = max(at, z)
            out[block.first + r] = (kept + raw[at:]).decode()
    return out
