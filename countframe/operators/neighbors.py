"""k-nearest-neighbour joins, graphs and distance-weighted votes.

Exact kNN is all-pairs work by nature, so it is done in blocks of at most
``block_rows`` rows per side: one matrix product each, of which only the k
best candidates per query row leave.  No pair list is ever materialised.

When the training side is small enough (rows x dim x 8 bytes counted
against ``broadcast_bytes``), it is broadcast: each task streams its
query rows past the whole training matrix in blocks and emits final top-k
rows, with no replication and no shuffle at all.  Beyond that, training rows
are partitioned by pivots and a query row is sent only to the partitions
that can hold one of its neighbours (``knnindex.PivotIndex``).

Ordering is by distance rounded to 1e-6, ties by training id, which makes
the result identical to plain SQL.  Inside a block the product form of the
distance only *pre-selects*: every candidate within 1e-6 of the k-th
distance is re-measured exactly, so ties and rounding never drop a true
neighbour.

The approximate variant (K2) is ``knnindex.InvertedIndex``; a bucketed
similarity join would emit every pair inside a hash bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.functions.hashing import round_half_up
from countframe.session import ship_library
from countframe.sources.tables import spread

K = 15
BLOCK_ROWS = 2048
BROADCAST_BYTES = 32 * 1024 * 1024  # training matrices up to this size are broadcast: every Python worker holds one
BROADCAST_PAIRS = 20_000_000_000     # pairs measured without an index
SPREAD_PAIRS = 10_000_000            # more are dealt out over all slots
Q_STEP, T_STEP = 256, 4096           # rows per side measured at a time
DIST_DIGITS = 6
EXACT_CHUNK = 65_536  # candidate pairs re-measured at a time


def _exact_sq(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, summed in dimension order."""
    acc = np.zeros(q.shape[0])
    for d in range(q.shape[1]):
        diff = q[:, d] - t[:, d]
        acc += diff * diff
    return acc


def _first_k(row, dist, ref, k: int):
    """Order of the k nearest of every row, ties by id, and their ranks."""
    order = np.lexsort((ref, dist, row))
    own = row[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
    return order[rank < k], rank[rank < k] + 1


def nearest(Q, qid, T, tid, k: int, exclude_self: bool, bound=None):
    """(row of Q, row of T, dist rounded) of the k best per row of Q, in memory
    bounded by Q_STEP x T_STEP pairs.  ``bound``: a distance per row that its
    k-th neighbour does not exceed, if known.

    The product form of the distance only selects: what is inside the rounding
    slack of the k-th distance so far is measured exactly, ties included."""
    scale = float(10 ** DIST_DIGITS)
    tn = np.einsum("ij,ij->i", T, T)
    found = []
    space = np.empty(Q_STEP * T_STEP)
    by_id = np.argsort(tid, kind="stable") if exclude_self else None
    named = tid[by_id] if exclude_self else None
    for qs in range(0, len(Q), Q_STEP):
        q, ids = Q[qs:qs + Q_STEP], qid[qs:qs + Q_STEP]
        qn = np.einsum("ij,ij->i", q, q)
        kth = np.full(len(q), np.inf) if bound is None else np.where(np.isnan(bound[qs:qs + Q_STEP]), np.inf, bound[qs:qs + Q_STEP])
        row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if exclude_self:                                    # where a row meets itself, by column
            lo, hi = np.searchsorted(named, ids), np.searchsorted(named, ids, "right")
            self_row = np.repeat(np.arange(len(q)), hi - lo)
            self_col = by_id[np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange(len(self_row))]
            order = np.argsort(self_col)
            self_row, self_col = self_row[order], self_col[order]
        left = np.hstack([-2.0 * q, np.ones((len(q), 1))])
        for ts in range(0, len(T), T_STEP):
            t, tids = T[ts:ts + T_STEP], tid[ts:ts + T_STEP]
            # squared distances less qn, in one product
            d2 = space[:len(q) * len(t)].reshape(len(q), len(t))
            np.matmul(left, np.hstack([t, tn[ts:ts + T_STEP, None]]).T, out=d2)
            if exclude_self:
                a, b = np.searchsorted(self_col, [ts, ts + len(t)])
                d2[self_row[a:b], self_col[a:b] - ts] = np.inf
            top, kk = kth.copy(), min(k, d2.shape[1])
            far = np.flatnonzero(np.isinf(top))
            if len(far):
                top[far] = np.sqrt(np.maximum(np.partition(d2[far], kk - 1, axis=1)[:, kk - 1] + qn[far], 0.0))
            # generous slack: product-form error plus the rounding granularity
            slack = top + 2.0 / scale + 1e-7 * np.sqrt(qn.max() + tn[ts:ts + T_STEP].max() + 1.0)
            r, c = np.divmod(np.flatnonzero(d2 <= (slack * slack - qn)[:, None]), len(t))
            if exclude_self:
                other = ids[r] != tids[c]
                r, c = r[other], c[other]
            exact = np.empty(len(r))
            for s in range(0, len(r), EXACT_CHUNK):
                e = s + EXACT_CHUNK
                exact[s:e] = np.sqrt(_exact_sq(q[r[s:e]], t[c[s:e]]))
            row, col = np.r_[row, r], np.r_[col, c + ts]
            dist = np.r_[dist, np.floor(exact * scale + 0.5) / scale]
            order, rank = _first_k(row, dist, tid[col], k)
            row, col, dist = row[order], col[order], dist[order]
            full = rank == k
            kth[row[full]] = np.minimum(kth[row[full]], dist[full])
        found.append((row + qs, col, dist))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def matrix(column) -> np.ndarray:
    """Dense rows of an Arrow column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError("a row has no vector")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _broadcast_topk(bc, k: int, exclude_self: bool, block_rows: int):
    """mapInArrow over query batches against the broadcast training matrix:
    each query row sees every training row inside one task, so its k best
    leave the task final (no shuffle, no second top-k)."""
    def fn(batches):
        T, tid = bc.value
        for batch in batches:
            for qs in range(0, batch.num_rows, block_rows):
                some = batch.slice(qs, block_rows)
                qid = some.column("id").to_numpy()
                row, col, dist = nearest(matrix(some.column("vec")), qid, T, tid, k, exclude_self)
                order, rank = _first_k(qid[row], dist, tid[col], k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[row[order]]), pa.array(tid[col[order]]), pa.array(rank.astype(np.int32)),
                                                  pa.array(dist[order])], ["query_id", "ref_id", "rank", "dist"])

    return fn


def knn_join(query: DataFrame, train: DataFrame, k: int = K, vec: str = "vec", key: str = "cell_id",
             block_rows: int = BLOCK_ROWS, exclude_self: bool = False,
             broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """K1/J6. (query_id, ref_id, rank, dist): the k nearest training rows
    of every query row by Euclidean distance.

    A training side of at most ``broadcast_bytes`` (rows x dim x 8, counted
    first) is broadcast, unless that makes more than BROADCAST_PAIRS pairs;
    beyond it pivot partitions are used."""
    ship_library(query.sparkSession)
    q = query.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    t = train.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    nt = train.count()
    if nt == 0:
        return q.sparkSession.createDataFrame([], "query_id long, ref_id long, rank int, dist double")
    first = t.first()
    dim = len(first["vec"]) if first is not None else 0
    pairs = nt * q.count()
    if nt * max(dim, 1) * 8 <= broadcast_bytes and pairs <= BROADCAST_PAIRS:
        # the training side has a checked size: ship it to every task
        # once and stream the query rows past it
        got = t.toArrow()
        T = np.array(got["vec"].combine_chunks().flatten(), dtype=np.float64).reshape(nt, dim)
        tid = got["id"].to_numpy()
        bc = query.sparkSession.sparkContext.broadcast((T, tid))
        if pairs > SPREAD_PAIRS:
            q = spread(q, "id")                     # a small file is one split
        return q.mapInArrow(_broadcast_topk(bc, k, exclude_self, block_rows),
                             "query_id long, ref_id long, rank int, dist double")
    from countframe.operators.knnindex import knn_pivot

    return knn_pivot(query, train, k, vec, key, exclude_self, block_rows)


def neighbors(latent: DataFrame, k: int = K, n_pcs: int | None = None, vec: str = "vec",
              key: str = "cell_id", **kw) -> DataFrame:
    """K3. kNN graph of one embedding (self excluded): (src, dst, rank, dist).
    ``n_pcs`` uses the first components only (D3)."""
    lat = latent.select(key, (F.slice(vec, 1, n_pcs) if n_pcs else F.col(vec)).alias("vec"))
    g = knn_join(lat, lat, k, "vec", key, exclude_self=True, **kw)
    return g.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), "rank", "dist")


def vote_weights(nbrs: DataFrame, src: str = "query_id") -> DataFrame:
    """Weight 1/dist; when a row has neighbours at distance 0, only those
    count (weight 1 each).  The window spans the k edges of one row."""
    has_zero = F.min("dist").over(Window.partitionBy(src)) == 0.0
    w = F.when(has_zero, F.when(F.col("dist") == 0.0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist"))
    return nbrs.withColumn("w", w)


def knn_predict_proba(nbrs: DataFrame, labels: DataFrame, src: str = "query_id", dst: str = "ref_id",
                      label: str = "label") -> DataFrame:
    """K4. (query_id, label, p): distance-weighted class shares among the
    neighbours; classes without weight are implicit zeros."""
    lab = labels.select(F.col("cell_id").alias(dst), F.col(label).alias("label"))
    wt = vote_weights(nbrs.join(lab, dst), src)
    s = wt.groupBy(src, "label").agg(F.sum("w").alias("_w"))
    p = s.withColumn("p", F.col("_w") / F.sum("_w").over(Window.partitionBy(src)))
    return p.select(F.col(src).alias("query_id"), "label", "p")


def knn_predict(probs: DataFrame, digits: int = 9) -> DataFrame:
    """K5. Highest weight wins; ties go to the first label alphabetically."""
    pr = round_half_up("p", digits)
    return probs.groupBy("query_id").agg(F.min_by("label", F.struct(-pr, F.col("label"))).alias("pred"),
                                         F.max("p").alias("p"))


BISECTIONS = 40
WIDEST = 32.0            # times a row's largest distance: there the weights sum to more than log2(k) + 1
NARROWEST = 1e-3         # times a row's mean distance


def connectivities(graph: DataFrame, k: int = K, src: str = "src", dst: str = "dst", dist: str = "dist") -> DataFrame:
    """K3. Weights of a kNN graph, both directions of every pair: (src, dst, w).

    Per row a weight falls off with the distance beyond the nearest neighbour
    that is not at distance 0, w = exp(-max(0, dist - nearest) / width); the
    width makes the row's weights sum to log2(k), found by ``BISECTIONS``
    halvings.  The two directions are united like chances, w + w' - w w'.
    Everything is per row (its k edges as one array) but for one aggregation
    by pair."""
    row = graph.groupBy(src).agg(F.array_sort(F.collect_list(F.struct(F.col(dist).alias("d"), F.col(dst).alias("t")))).alias("e"))
    row = row.withColumn("d", F.transform("e", lambda e: e["d"]))
    row = row.withColumn("near", F.coalesce(F.array_min(F.filter("d", lambda d: d > 0)), F.lit(0.0)))
    mean = F.aggregate("d", F.lit(0.0), lambda a, d: a + d) / F.size("d")
    target = F.lit(math.log2(k))
    weight = lambda d, width: F.when(d <= F.col("near"), F.lit(1.0)).otherwise(F.exp(-(d - F.col("near")) / width))
    total = lambda width: F.aggregate("d", F.lit(0.0), lambda a, d: a + weight(d, width))
    half = lambda a: (a["lo"] + a["hi"]) / 2
    start = F.struct(F.lit(0.0).alias("lo"), (F.array_max("d") * WIDEST).alias("hi"))
    step = lambda a, i: F.when(total(half(a)) > target, F.struct(a["lo"].alias("lo"), half(a).alias("hi"))).otherwise(
        F.struct(half(a).alias("lo"), a["hi"].alias("hi")))
    width = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step, half)
    row = row.withColumn("width", F.greatest(width, mean * NARROWEST))
    # all at distance 0: no width is needed
    one = row.select(src, "near", "width", F.explode("e").alias("e")).select(
        F.col(src).alias("src"), F.col("e.t").alias("dst"), weight(F.col("e.d"), F.col("width")).alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    united = F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.max("w") * F.min("w")).otherwise(0.0)
    return both.groupBy("src", "dst").agg(united.alias("w"))
