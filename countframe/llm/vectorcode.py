"""Vector code compression (operator 12): product quantisation with Orchard search.

Vectors become integers floor(scale * x) and are cut into ``parts`` equal
consecutive parts; each part position has a codebook of at most ``entries``
entries.  Codebooks start as the parts of the vectors of the smallest ids;
each of ``rounds`` rounds assigns all parts to their nearest entries and
replaces every used entry by floor(sum / count) of its parts, component by
component.  Everything is in integers, so sums do not depend on the order of
rows and a repeated task gives the same rows.

The nearest entry is found by Orchard search: every entry holds the list of
the others by distance.  A query walks the list of its best entry so far;
an entry that is nearer (ties: lower index) takes over and its list is walked
from the start; entries met before are marked and not measured again; the
walk ends beyond twice the current distance, where by the triangle
inequality nothing can be as near.  Queries of a batch walk in step.

Scale: a round is one pass over the vectors; a task returns sums per (part,
entry, position), at most parts x entries x (positions + 1) rows, and as many
rows in all reach the driver.  Codebooks and lists (parts x entries^2) are
broadcast; their size depends on the parameters only.  Errors by label: the
at most 1024 labels that hold more than 1/1024 of the rows are broadcast,
others are joined by a shuffle in which no label is large.

Cases: vectors that are null or hold null or non-finite components are
dropped.  All others must have one length, a multiple of ``parts`` (else a
ValueError), and stay below 2^24 after scaling (else an ArithmeticError in
the task).  Rows of null ids come last, ties are ordered by vector; repeated
rows count each.  Fewer vectors than entries make smaller codebooks; an empty
table has empty ones.  Other columns pass through, input columns named like
an output are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countframe.session import ship_library

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 1 << 24        # of a scaled component: squared distances stay exact
LABEL_SHARE = 1024       # labels above this share of all rows are joined by broadcast


# Orchard search -------------------------------------------------------------------
@dataclass
class Codebook:
    """Entries (k x positions), their pairwise squared distances and, per
    entry, the others by (distance, index)."""

    entries: np.ndarray
    apart: np.ndarray
    lists: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> "Codebook":
        k = len(entries)
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries]) if k else np.zeros((0, 0), np.int64)
        own = apart.copy()
        np.fill_diagonal(own, -1)                        # first, then left out
        return cls(entries, apart, np.argsort(own, axis=1, kind="stable")[:, 1:])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) per row of x."""
        m, k = len(x), len(self.entries)
        best = np.zeros(m, np.int64)
        dist = ((x - self.entries[0]) ** 2).sum(axis=1)
        seen = np.zeros((m, k), bool)
        seen[:, 0] = True
        step = np.zeros(m, np.int64)
        walking = np.arange(m) if k > 1 else np.zeros(0, np.int64)
        while len(walking):
            at = best[walking]
            entry = self.lists[at, step[walking]]
            near = self.apart[at, entry] <= 4 * dist[walking]
            walking, entry = walking[near], entry[near]
            fresh = ~seen[walking, entry]
            rows, new = walking[fresh], entry[fresh]
            seen[rows, new] = True
            d = ((x[rows] - self.entries[new]) ** 2).sum(axis=1)
            step[walking] += 1
            better = (d < dist[rows]) | ((d == dist[rows]) & (new < best[rows]))
            rows = rows[better]
            best[rows], dist[rows], step[rows] = new[better], d[better], 0
            walking = walking[step[walking] < k - 1]
        return best, dist


# vectors ---------------------------------------------------------------------------
def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: F.coalesce(finite(x), F.lit(False)))


def _whole(column, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) of an Arrow list column of equal lengths."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ArithmeticError(f"a component times {scale} is not below {LARGEST}")
    return x.astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def learn(vectors: DataFrame, vec: str = "embedding", row_id: str = "vec_id", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, one array (entries x positions) per part."""
    spark = vectors.sparkSession
    ship_library(spark)
    v = F.col(f"`{vec}`")
    kept = vectors.where(usable(v)).select(F.col(f"`{row_id}`").alias("id"), v.cast("array<double>").alias("v"))
    size = kept.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if size["least"] is None:
        return [np.zeros((0, 0), np.int64) for _ in range(parts)]
    if size["least"] != size["most"] or size["least"] % parts:
        raise ValueError(f"vectors of {size['least']} to {size['most']} components do not make {parts} equal parts")
    width = size["least"] // parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow()
    start = _whole(first["v"].combine_chunks(), scale)
    books = [np.ascontiguousarray(start[:, p * width:(p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        books = [_moved(b, s, n) for b, (s, n) in zip(books, _sums(kept, books, scale))]
    return books


def _moved(book: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], book)


def _sums(kept: DataFrame, books: list[np.ndarray], scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part: sums (entries x positions) and numbers of the parts assigned to each entry."""
    k, width = books[0].shape
    shared = kept.sparkSession.sparkContext.broadcast([Codebook.of(b) for b in books])

    def add(batches):
        total = np.zeros((len(shared.value), k, width + 1), np.int64)      # the last position counts
        for batch in batches:
            x = _whole(batch.column(0), scale)
            for p, book in enumerate(shared.value):
                own = x[:, p * width:(p + 1) * width]
                code, _ = book.nearest(own)
                np.add.at(total[p], code, np.hstack([own, np.ones((len(own), 1), np.int64)]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "s"])

    rows = kept.select("v").mapInArrow(add, "at bigint, s bigint").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros(len(books) * k * (width + 1), np.int64)
    total[rows["at"].to_numpy()] = rows["s"].to_numpy()
    shared.unpersist()
    return [(t[:, :width], t[:, width]) for t in total.reshape(len(books), k, width + 1)]


def encode(vectors: DataFrame, books: list[np.ndarray], vec: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The usable rows plus code (two hex digits of the entry's index per part;
    more where a codebook has over 256) and error (squared distances summed)."""
    spark = vectors.sparkSession
    ship_library(spark)
    digits = max(2, (max(max((len(b) for b in books), default=1) - 1, 0).bit_length() + 3) // 4)
    width = books[0].shape[1] if books else 0
    shared = spark.sparkContext.broadcast([Codebook.of(b) for b in books])

    @F.arrow_udf("struct<code:string,error:bigint>")
    def assign(column: pa.Array) -> pa.Array:
        x = _whole(column, scale)
        found = [book.nearest(x[:, p * width:(p + 1) * width]) for p, book in enumerate(shared.value)] if len(x) else []
        error = sum((d for _, d in found), np.zeros(len(x), np.int64))
        names = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c, _ in found))]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(error, pa.int64())], ["code", "error"])

    names = [c for c in vectors.columns if c not in ("code", "error")]
    v = F.col(f"`{vec}`")
    rows = vectors.where(usable(v)).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), assign(v.cast("array<double>")).alias("found"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "found.code", "found.error")


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The quantised vector (integers) that a code stands for."""
    digits = len(code) // len(books)
    return np.concatenate([b[int(code[i * digits:(i + 1) * digits], 16)] for i, b in enumerate(books)])


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all components by part, entry, position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` plus the error summed over rows of an equal label (nulls together)."""
    key = F.col(f"`{label}`")
    # a null as a value of its own, so that both joins are plain equi-joins
    rows = coded.withColumn("__cf_k", F.struct(key.isNull().alias("none"), F.coalesce(key.cast("string"), F.lit("")).alias("name")))
    sums = rows.groupBy("__cf_k").agg(F.sum(error).alias(out), F.count(F.lit(1)).alias("__cf_n"))
    total = sums.agg(F.sum("__cf_n")).first()[0] or 0
    often = F.col("__cf_n") * LABEL_SHARE > total
    hot = F.broadcast(sums.where(often).select("__cf_k", F.col(out).alias("__cf_hot")))     # fewer than LABEL_SHARE rows
    met = rows.join(hot, "__cf_k", "left")
    rest = met.where("__cf_hot IS NULL").drop("__cf_hot").join(sums.where(~often).select("__cf_k", out), "__cf_k")
    return met.where("__cf_hot IS NOT NULL").withColumnRenamed("__cf_hot", out).unionByName(rest).drop("__cf_k")
