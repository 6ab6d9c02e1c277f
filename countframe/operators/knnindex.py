"""Indexed nearest neighbours (K1, K2, J6): pivot partitions for exact
joins, inverted lists for approximate ones.

Training rows are cut into blocks once and written; queries are sent only to
the blocks they have to meet.  Consecutive
blocks form groups of about GROUP_ROWS rows, a query is copied once per group in
which it meets a block (with the blocks' numbers), a group once per SLICE_ROWS
queries; one Arrow task measures such a pair, block by block, with matrix
products of bounded pieces and returns at most k candidates a query, and a
window keeps the best k.  Copies by pairs of groups and slices would grow with
the square of the rows: only a bounded number of blocks a query is met so.

``PivotIndex`` (exact).  Rows belong to the cell of their nearest pivot and,
inside it, to a ring of distances to the pivot.  A query first meets the
block that may hold the nearest row; its k-th distance there is a bound.  For
the others no row is copied: blocks are sent to all tasks, SENT_BYTES at a time
and ROUND of these in a job, and the queries pass by them in place.
By the triangle inequality a block whose rows are lo to hi away from their
pivot p can hold a nearer one only if the bound reaches max(d(q, p) - hi,
lo - d(q, p)); the bisecting plane of two pivots gives a second bound.  Every
other block is left out, and no training row is copied for it.

``InvertedIndex`` (approximate).  Every row is in the list of its nearest
centroid.  Centroids come from k-means over a bounded sample; a list that
holds too many rows gets centroids of its own, again and again, so a list
does not grow with a dense region.  Queries meet the ``probes`` nearest
lists; distances inside are exact.

Rows with equal vectors beyond the k + 1 smallest ids can be nobody's
neighbour and are left out first, which also keeps a vector shared by a third
of all rows from filling a block.

Sizes: pivots, rings and centroids are bounded by parameters; the tables of
blocks (one small row each, at most MAX_PIVOTS * MAX_RINGS or MAX_CENTROIDS)
and the numbers of meetings are what reaches the driver and is broadcast, and
the blocks of a round, one SENT_BYTES after the other.
Cases: rows without vector are left out on both sides; no training rows, no
result; fewer than k give fewer neighbours.  Order is by distance rounded to
1e-6, ties by id, as in ``neighbors.knn_join``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.operators.neighbors import BLOCK_ROWS, K, _first_k, matrix, nearest
from countframe.session import cut_by, cut_lineage, discard, ship_library

MAX_PIVOTS = 1024
MAX_RINGS = 16
MAX_CENTROIDS = 16_384
SAMPLE_ROWS = 20_000       # rows a k-means step sees, per list 64 for each new centroid at most
GROUP_ROWS = 32_768        # rows of neighbouring blocks that a task measures together
SLICE_ROWS = 16_384        # queries sent to a copy of a group
SENT_BYTES = 32 << 20      # training rows that a task holds at a time
ROUND = 16                 # times that: sent to the tasks of one job
MEET_BITS = 1 << 25        # (query, block) marks that a task holds
CHUNK = 256                # queries compared with all blocks at a time
SLACK = 2e-6               # rounding of distances, and float error below
_FOUND = "query_id long, ref_id long, rank int, dist double"
_CAND = "query_id long, ref_id long, dist double"


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _float_error(x: np.ndarray, y: np.ndarray) -> float:
    """More than ``_apart`` can be wrong by."""
    top = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) * math.sqrt(max(1, x.shape[-1]))
    return 1e-7 * top + SLACK


def _rows(df: DataFrame, key: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")


def without_spare_copies(rows: DataFrame, k: int) -> DataFrame:
    """(id, vec) without the rows whose vector k + 1 smaller ids have as well."""
    named = rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    key = ["h1", "h2"]
    many = cut_lineage(named.groupBy(*key).count().where(F.col("count") > k + 1).select(*key))
    if many.isEmpty():
        return rows
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("id"))       # limited before the shuffle
    cut = (named.join(many, key, "left_semi").select(*key, "id").withColumn("nth", nth).where(F.col("nth") <= k + 1)
           .groupBy(*key).agg(F.max("id").alias("cut")))
    return named.join(cut, key, "left").where("cut IS NULL OR id <= cut").select("id", "vec")


# queries meet blocks ------------------------------------------------------------
@dataclass
class Meetings:
    """(query, block) meetings and row pairs compared, beside all of them."""

    queries: int = 0
    blocks: int = 0
    met: int = 0
    row_pairs: int = 0
    all_row_pairs: int = 0

    @property
    def full(self) -> int:
        return self.queries * self.blocks


def _groups(size: np.ndarray) -> np.ndarray:
    """Group of each block: consecutive ones of about GROUP_ROWS rows together."""
    return ((np.cumsum(size) - size) // GROUP_ROWS).astype(np.int32)


def _to_groups(some, meet: np.ndarray, size: np.ndarray, group: np.ndarray, bound):
    """Arrow rows that send each query once to every group of which it meets
    a block, with those blocks (NULL: all of the group's)."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.add.reduceat(meet.astype(np.int32), start, axis=1)
    rows, at = np.nonzero(n)
    per = n[rows, at]
    whole = per == np.diff(np.r_[start, len(group)])[at]
    blocks = np.nonzero(meet)[1].astype(np.int32)                    # by query, then by block: in the order of (rows, at)
    flat = blocks[np.repeat(~whole, per)]
    ends = np.cumsum(np.where(whole, 0, per))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat), mask=pa.array(whole))
    some = some.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([some.column("id"), some.column("vec"), pa.array(group[start][at]), lists, pa.array(bound[rows]), pa.array(per.astype(np.int32)),
                                       pa.array(np.add.reduceat(meet * size, start, axis=1)[rows, at].astype(np.int64))], ["id", "vec", "grp", "blocks", "bound", "met", "pairs"])


def _measured(k: int, exclude_self: bool):
    """Candidates of a slice of queries among a group's rows."""
    def fn(q: pa.Table, t: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and t.num_rows:
            t = t.sort_by("block")
            Q, qid, T, tid, own = matrix(q["vec"]), q["id"].to_numpy(), matrix(t["vec"]), t["id"].to_numpy(), t["block"].to_numpy()
            bound, lists = q["bound"].to_numpy(), q["blocks"].combine_chunks()

            def add(rows, lo, hi):
                r, c, d = nearest(Q[rows], qid[rows], T[lo:hi], tid[lo:hi], k, exclude_self, bound[rows])
                found.append((rows[r], c + lo, d))

            whole = lists.is_null().to_numpy(zero_copy_only=False)
            if whole.any():
                add(np.flatnonzero(whole), 0, len(T))
            size = np.diff(lists.offsets.to_numpy())
            size[whole] = 0
            row, block = np.repeat(np.arange(len(Q)), size), lists.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            row, block = row[order], block[order]
            for b in np.unique(block):
                lo, hi = np.searchsorted(own, [b, b + 1])
                first, last = np.searchsorted(block, [b, b + 1])
                if hi > lo:
                    add(row[first:last], lo, hi)
            row, col, dist = (np.concatenate(x) for x in zip(*found))
            order, _ = _first_k(row, dist, tid[col], k)
            found = [(qid[row[order]], tid[col[order]], dist[order])]
        return pa.Table.from_arrays([pa.array(x) for x in found[0]], names=["query_id", "ref_id", "dist"])

    return fn


def _meet(index: DataFrame, queries: DataFrame, size: np.ndarray, k: int, exclude_self: bool, met: Meetings) -> DataFrame:
    """Candidates of (id, vec, grp, blocks, bound, met, pairs) queries in (id, vec,
    block) rows.  A query is copied once per group it meets, a group once per
    SLICE_ROWS queries; a group with a crowded block is dealt out by id."""
    spark = index.sparkSession
    group = _groups(size)
    asked = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("met").alias("met"), F.sum("pairs").alias("pairs")).collect()       # a row a group
    met.met += sum(r["met"] for r in asked)
    met.row_pairs += sum(r["pairs"] for r in asked)
    if not asked:
        return spark.createDataFrame([], _CAND)
    rows = np.bincount(group, weights=size)
    pieces = [(r["grp"], max(1, -(-int(rows[r["grp"]]) // (2 * GROUP_ROWS))), -(-r["n"] // SLICE_ROWS)) for r in asked]
    plan = F.broadcast(spark.createDataFrame(pieces, "grp int, subs int, slices int"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(group.tolist())), "block int, grp int"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = index.join(names, "block").join(plan, "grp").select("grp", "block", "id", "vec", part("subs").alias("sub"), every("slices").alias("slice"))
    q = queries.join(plan, "grp").select("grp", "id", "vec", "blocks", "bound", part("slices").alias("slice"), every("subs").alias("sub"))
    key = ["grp", "sub", "slice"]
    return q.groupBy(*key).cogroup(t.groupBy(*key)).applyInArrow(_measured(k, exclude_self), _CAND)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return (candidates.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "ref_id", "rank", "dist"))


_QUERY = "id long, vec array<double>, grp int, blocks array<int>, bound double, met int, pairs long"


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["vec"].to_numpy()).astype(np.float64)


# exact: pivots ----------------------------------------------------------------------
@dataclass
class PivotIndex:
    """Training rows by block (cell and ring), with the bounds of each block."""

    rows: DataFrame            # id, vec, block, part
    pivots: np.ndarray         # cells x dim
    cell: np.ndarray           # of each block
    lo: np.ndarray
    hi: np.ndarray
    size: np.ndarray
    k: int
    meetings: Meetings = field(default_factory=Meetings)
    between: np.ndarray | None = None
    part: np.ndarray | None = None             # folder of each block

    @classmethod
    def build(cls, train: DataFrame, k: int = K, vec: str = "vec", key: str = "cell_id", block_rows: int = BLOCK_ROWS,
              max_pivots: int = MAX_PIVOTS, max_rings: int = MAX_RINGS) -> "PivotIndex":
        """``k``: the most neighbours that will be asked for.  Blocks hold
        about ``block_rows`` rows, or the root of all if that is more: a query
        is compared with every block's bounds."""
        spark = train.sparkSession
        ship_library(spark)
        every = cut_lineage(_rows(train, key, vec))
        t = without_spare_copies(every, k)
        t = t if t is every else cut_lineage(t)
        n = t.count()
        block_rows = max(block_rows, math.isqrt(n))
        if not n:
            return cls(spark.createDataFrame([], "id long, vec array<double>, block int"), np.zeros((0, 0)), *[np.zeros(0)] * 4, k)
        count = min(max_pivots, max(1, -(-n // block_rows)) * 2)
        first = t.orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
        pivots = np.stack(first["vec"].to_numpy()).astype(np.float64)
        rings = min(max_rings, max(1, -(-n // (count * block_rows))) * 2)
        parts = max(1, -(-n * pivots.shape[1] * 8 // SENT_BYTES))     # folders: cells in order

        def placing(edges: np.ndarray):
            shared = spark.sparkContext.broadcast((pivots, edges))

            def assign(batches):
                pivots, edges = shared.value
                for batch in batches:
                    for at in range(0, batch.num_rows, CHUNK):
                        some = batch.slice(at, CHUNK)
                        x = matrix(some.column("vec"))
                        cell = _apart(x, pivots).argmin(axis=1)
                        d = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                        block = cell * rings + (edges[cell] < d[:, None]).sum(axis=1)
                        yield pa.RecordBatch.from_arrays([some.column("id"), some.column("vec"), *[pa.array(c.astype(np.int32)) for c in (cell, block, cell * parts // len(pivots))],
                                                          pa.array(d)], ["id", "vec", "cell", "block", "part", "d"])

            return t.mapInArrow(assign, "id long, vec array<double>, cell int, block int, part int, d double")

        edges = np.full((len(pivots), rings - 1), np.inf)
        if rings > 1:
            shares = F.array(*[F.lit(i / rings) for i in range(1, rings)]).cast("array<double>")
            for r in placing(edges).groupBy("cell").agg(F.percentile_approx("d", shares, 1000).alias("edges")).collect():      # at most max_pivots rows
                edges[r["cell"]] = r["edges"]
        # placed once: the bounds of the blocks are those of the rows written
        placed = cut_by(placing(edges).repartition("cell"), "part")
        discard(every)
        discard(t)
        found = sorted(placed.groupBy("block", "cell", "part").agg(F.min("d"), F.max("d"), F.count(F.lit(1))).collect())
        number = F.create_map(*[F.lit(x) for i, r in enumerate(found) for x in (r[0], i)]) if len(found) < 2048 else None
        if number is not None:
            rows = placed.select("id", "vec", number[F.col("block")].cast("int").alias("block"), "part")
        else:
            names = spark.createDataFrame([(r[0], i) for i, r in enumerate(found)], "block int, nth int")
            rows = placed.join(F.broadcast(names), "block").select("id", "vec", F.col("nth").alias("block"), "part")
        at = lambda i, kind: np.array([r[i] for r in found], kind)
        return cls(rows, pivots, at(1, np.int64), at(3, float), at(4, float), at(5, np.int64), k, part=at(2, np.int64))

    def _least(self, x: np.ndarray) -> np.ndarray:
        """Lower bound of the distance of each x to each block's rows."""
        d = _apart(x, self.pivots)
        own = d[:, self.cell]
        low = np.maximum(np.maximum(own - self.hi, self.lo - own), 0)
        home = d.argmin(axis=1)
        if self.between is None:
            self.between = _apart(self.pivots, self.pivots)
        between = self.between[home]                        # home pivot to every pivot
        plane = np.divide(d ** 2 - d[np.arange(len(x)), home][:, None] ** 2, 2 * between, out=np.zeros_like(d), where=between > 1e-5 * (1 + d.max()))
        return np.maximum(low, plane[:, self.cell])

    def _enough(self, x: np.ndarray) -> np.ndarray:
        """A distance within which k + 1 rows lie, for each x."""
        if self.size.sum() <= self.k:
            return np.full(len(x), np.inf)
        reach = _apart(x, self.pivots)[:, self.cell] + self.hi
        order = np.argsort(reach, axis=1)
        enough = (np.cumsum(self.size[order], axis=1) > self.k).argmax(axis=1)
        return np.take_along_axis(reach, order, axis=1)[np.arange(len(x)), enough]

    def search(self, query: DataFrame, k: int | None = None, vec: str = "vec", key: str = "cell_id", exclude_self: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(query_id, ref_id, rank, dist): the k nearest rows.  ``meetings``
        then tells how many blocks were met."""
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"the index was built for {self.k} neighbours")
        spark = query.sparkSession
        if not len(self.size):
            return spark.createDataFrame([], _FOUND)
        shared = spark.sparkContext.broadcast((self.pivots, self.cell, self.lo, self.hi, self.size, self.k))
        group = _groups(self.size)

        def at_home(batches):
            index = PivotIndex(None, *shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    some = batch.slice(at, CHUNK)
                    low = index._least(matrix(some.column("vec")))
                    home = low.argmin(axis=1)
                    meet = np.zeros(low.shape, bool)
                    meet[np.arange(len(low)), home] = True
                    sent = _to_groups(some, meet, index.size, group, np.full(len(low), np.nan))
                    yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(home.astype(np.int32))], [*sent.schema.names, "home"])

        # a row a query, with its home: what follows starts from this copy
        home = cut_lineage(_rows(query, key, vec).mapInArrow(at_home, f"{_QUERY}, home int"))
        met = self.meetings = Meetings(home.count(), len(self.size))
        met.all_row_pairs = met.queries * int(self.size.sum())
        near = cut_lineage(_meet(self.rows.select("id", "vec", "block"), home.drop("home"), self.size, k, exclude_self, met))
        # the k-th distance so far; fewer than k found: no bound from them
        bound = _best(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("dist").alias("bound"))
        asked = home.select("id", "vec", "home").join(bound, "id", "left")
        first = np.r_[0, np.cumsum(self.size)]                     # row of each block's first
        rows = max(1, SENT_BYTES // (8 * max(1, self.pivots.shape[1])))
        start = np.flatnonzero(np.r_[True, np.diff(first[:-1] // rows) > 0])
        spans = list(zip(start.tolist(), [*start[1:].tolist(), len(self.size)]))
        if len(self.size) == 1:
            return _best(near, k)
        found = [near]
        for i in range(0, len(spans), ROUND):
            got = _passed_by(self, asked, spans[i:i + ROUND], shared, k, exclude_self)
            counts = got.where("query_id IS NULL").agg(F.sum("met"), F.sum("pairs")).first()
            met.met += counts[0] or 0
            met.row_pairs += counts[1] or 0
            found.append(got.where("query_id IS NOT NULL").select("query_id", "ref_id", "dist"))
        return _best(reduce(DataFrame.unionByName, found), k)

    def blocks(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, ids, block of each) of the rows in blocks lo to hi - 1, by block."""
        here = (F.col("part").between(int(self.part[lo]), int(self.part[hi - 1]))) & F.col("block").between(lo, hi - 1)
        got = self.rows.where(here).select("id", "vec", "block").toArrow()
        own = got["block"].to_numpy()
        order = np.argsort(own, kind="stable")
        return matrix(got["vec"])[order], got["id"].to_numpy()[order], own[order]


def _passed_by(index: PivotIndex, asked: DataFrame, spans: list[tuple[int, int]], shared, k: int, exclude_self: bool) -> DataFrame:
    """Candidates of ``asked`` (id, vec, home, bound) in the blocks of ``spans``
    other than a query's home, written; and rows without query_id that
    count what was met.  Blocks go to the tasks, no query moves: a task takes its
    queries past one span after the other, and holds one."""
    context = asked.sparkSession.sparkContext
    sent = [(lo, hi, context.broadcast(index.blocks(lo, hi))) for lo, hi in spans]

    def taken(some):
        bounds = PivotIndex(None, *shared.value)
        Q, qid, home = matrix(some.column("vec")), some.column("id").to_numpy(), some.column("home").to_numpy()
        bound = some.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
        first, last = sent[0][0], sent[-1][1]
        meet = np.zeros((len(Q), last - first), bool)
        for at in range(0, len(Q), CHUNK):
            x, b = Q[at:at + CHUNK], bound[at:at + CHUNK]
            none = np.flatnonzero(np.isnan(b))
            if len(none):
                b[none] = bounds._enough(x[none])
            b += _float_error(x, bounds.pivots)
            meet[at:at + CHUNK] = bounds._least(x)[:, first:last] <= b[:, None]
        mine = np.flatnonzero((home >= first) & (home < last))
        meet[mine, home[mine] - first] = False
        row, ref, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for lo, hi, rows in sent:
            here = meet[:, lo - first:hi - first]
            if not here.any():
                continue
            T, tid, own = rows.value
            rows.__dict__.pop("_value", None)                # a worker keeps one at a time
            new = []

            def add(some, lo, hi):
                r, c, d = nearest(Q[some], qid[some], T[lo:hi], tid[lo:hi], k, exclude_self, bound[some])
                new.append((some[r], tid[c + lo], d))

            whole = here.all(axis=1)
            if whole.any():
                add(np.flatnonzero(whole), 0, len(T))
            here[whole] = False
            for b in np.flatnonzero(here.any(axis=0)):
                add(np.flatnonzero(here[:, b]), *np.searchsorted(own, [lo + b, lo + b + 1]))
            here[whole] = True
            row, ref, dist = (np.concatenate([x, *y]) for x, y in zip((row, ref, dist), zip(*new)))
            order, rank = _first_k(row, dist, ref, k)
            row, ref, dist = row[order], ref[order], dist[order]
            full = rank == k
            bound[row[full]] = np.minimum(bound[row[full]], dist[full])
        counts = [int(meet.sum()), int(meet.sum(axis=0) @ bounds.size[first:last])]
        none = np.zeros(len(row) + 1, bool)
        none[-1] = True
        return pa.RecordBatch.from_arrays([*[pa.array(np.r_[x, 0], mask=none) for x in (qid[row], ref, dist)], *[pa.array(np.r_[np.zeros(len(row), np.int64), x], mask=~none) for x in counts]],
                                          ["query_id", "ref_id", "dist", "met", "pairs"])

    def fn(batches):
        most = max(CHUNK, min(SLICE_ROWS, MEET_BITS // max(1, sent[-1][1] - sent[0][0])))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                yield taken(batch.slice(at, most))

    got = cut_lineage(asked.mapInArrow(fn, f"{_CAND}, met long, pairs long"))
    for _, _, rows in sent:
        rows.destroy()
    return got


# approximate: inverted lists -----------------------------------------------------------
def kmeans(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample; the first ones are spread out row by row."""
    count = min(count, len(np.unique(x, axis=0)))
    near = np.full(len(x), np.inf)
    chosen = [0]
    for _ in range(count - 1):                       # the farthest row from those chosen
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    c = x[chosen].copy()
    for _ in range(rounds):
        own = _apart(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


@dataclass
class InvertedIndex:
    """Training rows by list, with the lists' centroids."""

    rows: DataFrame            # id, vec, block
    centroids: np.ndarray
    size: np.ndarray
    meetings: Meetings = field(default_factory=Meetings)

    @classmethod
    def build(cls, train: DataFrame, k: int = K, vec: str = "vec", key: str = "cell_id", list_rows: int | None = None,
              max_centroids: int = MAX_CENTROIDS, sample_rows: int = SAMPLE_ROWS, splits: int = 4) -> "InvertedIndex":
        """Lists of about ``list_rows`` rows (about the root of all, unless
        given); one with over twice as many is split, up to ``splits`` times.
        ``k``: the most neighbours that will be asked for."""
        spark = train.sparkSession
        ship_library(spark)
        t = cut_lineage(without_spare_copies(_rows(train, key, vec), k))
        n = t.count()
        if not n:
            return cls(spark.createDataFrame([], "id long, vec array<double>, block int"), np.zeros((0, 0)), np.zeros(0, np.int64))
        list_rows = list_rows or max(16, math.isqrt(n))
        centroids, crowded = np.zeros((0, 0)), {0: n}
        lists = t.withColumn("block", F.lit(0))
        for step in range(splits + 1):
            room = max_centroids - len(centroids)
            wanted = {b: min(-(-s // list_rows), 1024) for b, s in sorted(crowded.items(), key=lambda x: -x[1])}
            wanted = {b: w for b, w in wanted.items() if w > 1 or not step}
            if not wanted or room < 2:
                break
            sample = _sampled(lists, wanted, crowded, sample_rows)
            old = [c for b, c in enumerate(centroids) if b not in wanted]
            new = []
            for b, x in sample.items():
                new += list(kmeans(x, max(1, min(wanted[b], room - len(new)))))
            centroids = np.array(old + new)
            lists = cut_lineage(t.mapInPandas(_listed(spark, centroids, 1), "id long, vec array<double>, block int"))
            size = {r["block"]: r["count"] for r in lists.groupBy("block").count().collect()}      # a row a list
            crowded = {b: s for b, s in size.items() if s > 2 * list_rows}
        return cls(lists, centroids, np.array([size.get(b, 0) for b in range(len(centroids))], np.int64))

    def search(self, query: DataFrame, k: int = K, probes: int = 16, vec: str = "vec", key: str = "cell_id", exclude_self: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(query_id, ref_id, rank, dist): the k nearest rows in the
        ``probes`` nearest lists."""
        spark = query.sparkSession
        if not len(self.size):
            return spark.createDataFrame([], _FOUND)
        q = cut_lineage(_rows(query, key, vec).mapInArrow(_probed(spark, self.centroids, self.size, _groups(self.size), probes), _QUERY))
        met = self.meetings = Meetings(q.select("id").distinct().count(), len(self.size))
        met.all_row_pairs = met.queries * int(self.size.sum())
        return _best(_meet(self.rows, q, self.size, k, exclude_self, met), k)


def _sampled(lists: DataFrame, wanted: dict[int, int], size: dict[int, int], most: int) -> dict[int, np.ndarray]:
    """Rows of the wanted lists, chosen by hash: about 64 for each new
    centroid, and about ``most`` in all."""
    share = min(1.0, most / (64 * sum(wanted.values())))
    rate = {b: min(1.0, 64 * share * w / size[b]) for b, w in wanted.items()}
    plan = F.broadcast(lists.sparkSession.createDataFrame(list(rate.items()), "block int, rate double"))
    draw = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = lists.join(plan, "block").where(draw <= F.col("rate")).orderBy(F.xxhash64("id")).limit(2 * most).select("block", "vec").toArrow()
    own, x = got["block"].to_numpy(), np.stack(got["vec"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, 0))
    return {b: x[own == b] for b in wanted if (own == b).any()}


def _listed(spark, centroids: np.ndarray, probes: int):
    """(id, vec) -> (id, vec, block): the nearest lists of every row."""
    shared = spark.sparkContext.broadcast(centroids)

    def emit(batches):
        n = min(probes, len(shared.value))
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                some = pdf.iloc[at:at + CHUNK]
                d = _apart(_stacked(some), shared.value)
                own = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
                yield some.iloc[np.repeat(np.arange(len(d)), n)][["id", "vec"]].assign(block=own.ravel().astype(np.int32))

    return emit


def _probed(spark, centroids: np.ndarray, size: np.ndarray, group: np.ndarray, probes: int):
    """(id, vec) -> queries by group, with the nearest lists to meet."""
    shared = spark.sparkContext.broadcast((centroids, size))

    def emit(batches):
        c, rows = shared.value
        n = min(probes, len(c))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                d = _apart(matrix(some.column("vec")), c)
                meet = np.zeros(d.shape, bool)
                np.put_along_axis(meet, np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1)), True, axis=1)
                yield _to_groups(some, meet, rows, group, np.full(len(d), np.nan))

    return emit


def knn_pivot(query: DataFrame, train: DataFrame, k: int = K, vec: str = "vec", key: str = "cell_id", exclude_self: bool = False,
              block_rows: int = BLOCK_ROWS, **build) -> DataFrame:
    """K1/J6, exact, by pivot partitions; same rows as ``neighbors.knn_join``."""
    return PivotIndex.build(train, k, vec, key, block_rows, **build).search(query, k, vec, key, exclude_self, block_rows)


def knn_approximate(query: DataFrame, train: DataFrame, k: int = K, probes: int = 16, vec: str = "vec", key: str = "cell_id",
                    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, **build) -> DataFrame:
    """K2: neighbours from the nearest inverted lists."""
    return InvertedIndex.build(train, k, vec, key, **build).search(query, k, probes, vec, key, exclude_self, block_rows)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (wanted, hit): exact neighbours, and those of them that were found."""
    pair = ["query_id", "ref_id"]
    hit = exact.select(*pair).join(found.select(*pair, F.lit(1).alias("hit")), pair, "left")
    return hit.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hit"))
