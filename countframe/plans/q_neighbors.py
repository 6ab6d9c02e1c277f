"""Neighbour queries on the ready-made vectors.

The vectors are split by a seeded hash into ~20 % query rows and the
training rest; both sides are the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from countframe.functions.hashing import hash16, round_half_up
from countframe.operators import knnindex, neighbors
from countframe.plans.catalog import query
from countframe.plans.q_embedding import SCORES_SQL, pca_project_q
from countframe.plans.sqlbits import F3, h, rnd, with_
from countframe.session import cut_lineage
from countframe.sources import fixtures

SPLIT_SALT, SPLIT_CUT = 3, 13107


def f3_split(spark, sf):
    lat = fixtures.embedding_latent(spark, sf)
    is_q = hash16(F.col("cell_id"), SPLIT_SALT) < SPLIT_CUT
    return lat.where(is_q), lat.where(~is_q)


def f3_knn(spark, sf):
    q, t = f3_split(spark, sf)
    return neighbors.knn_join(q, t, 15), t


def f3_proba(spark, sf):
    nn, t = f3_knn(spark, sf)
    return neighbors.knn_predict_proba(nn, t)


KNN_SQL = with_(F3) + f""",
q AS (SELECT * FROM f3 WHERE {h('cell_id', 3)} < 13107),
t AS (SELECT * FROM f3 WHERE {h('cell_id', 3)} >= 13107),
d AS (SELECT q.cell_id AS query_id, t.cell_id AS ref_id, {rnd('list_distance(q.vec, t.vec)')} AS dist FROM q, t),
nn AS (
  SELECT query_id, ref_id, CAST(rank AS INTEGER) AS rank, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS rank FROM d)
  WHERE rank <= 15),
lab AS (SELECT nn.*, t.label FROM nn JOIN t ON nn.ref_id = t.cell_id),
wt AS (
  SELECT *, CASE WHEN min(dist) OVER (PARTITION BY query_id) = 0
                 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / dist END AS w
  FROM lab),
pr AS (SELECT query_id, label, sum(w) / sum(sum(w)) OVER (PARTITION BY query_id) AS p FROM wt GROUP BY 1, 2),
pred AS (
  SELECT query_id, label AS pred FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rnd('p', 9)} DESC, label) AS r FROM pr)
  WHERE r = 1)"""


@query("knn_join", KNN_SQL + " SELECT * FROM nn")
def knn_join_q(spark, sf):
    nn, _ = f3_knn(spark, sf)
    return nn


@query("knn_predict_proba", KNN_SQL + f" SELECT query_id, label, {rnd('p')} AS p FROM pr")
def knn_predict_proba_q(spark, sf):
    return f3_proba(spark, sf).withColumn("p", round_half_up("p"))


@query("knn_predict", KNN_SQL + " SELECT query_id, pred FROM pred")
def knn_predict_q(spark, sf):
    return neighbors.knn_predict(f3_proba(spark, sf)).select("query_id", "pred")


@query("knn_graph", with_(F3) + f""",
d AS (SELECT a.cell_id AS src, b.cell_id AS dst, {rnd('list_distance(a.vec, b.vec)')} AS dist
      FROM f3 a, f3 b WHERE a.cell_id <> b.cell_id)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d) WHERE rank <= 15""")
def knn_graph_q(spark, sf):
    return neighbors.neighbors(fixtures.embedding_latent(spark, sf), 15)


@query("latent_head", with_(F3) + """
SELECT cell_id, CAST(i - 1 AS INTEGER) AS idx, vec[i] AS value
FROM f3, range(1, 31) r(i)""")
def latent_head_q(spark, sf):
    lat = fixtures.embedding_latent(spark, sf)
    head = lat.select("cell_id", F.slice("vec", 1, 30).alias("vec"))
    return head.select("cell_id", F.posexplode("vec").alias("idx", "value"))


# D3 + K3 ------------------------------------------------------------------------
@query("knn_graph_head", with_(F3) + f""",
d AS (SELECT a.cell_id AS src, b.cell_id AS dst, {rnd('list_distance(a.vec[1:30], b.vec[1:30])')} AS dist
      FROM f3 a, f3 b WHERE a.cell_id <> b.cell_id)
SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d) WHERE rank <= 15""")
def knn_graph_head_q(spark, sf):
    """kNN graph on the first 30 components only (n_pcs = 30)."""
    return neighbors.neighbors(fixtures.embedding_latent(spark, sf), 15, n_pcs=30)


# K1/J6 by pivots, K2 ------------------------------------------------------------
PIVOT_BLOCK = 64         # small, so that the small tables make many partitions


@query("knn_pivot", KNN_SQL + " SELECT * FROM nn")
def knn_pivot_q(spark, sf):
    """``knn_join`` by pivot partitions."""
    q, t = f3_split(spark, sf)
    return knnindex.knn_pivot(q, t, 15, block_rows=PIVOT_BLOCK)


def score_vectors(spark, sf):
    """The five projected scores of every F1 cell as a vector."""
    scores = pca_project_q(spark, sf)
    pairs = F.array_sort(F.collect_list(F.struct("pc", "score")))
    return cut_lineage(scores.groupBy("cell_id").agg(F.transform(pairs, lambda p: p["score"]).alias("vec")))


SCORE_GRAPH_SQL = SCORES_SQL + f""",
sv AS (SELECT cell_id, list(score ORDER BY pc) AS vec FROM scores GROUP BY cell_id),
sd AS (SELECT a.cell_id AS src, b.cell_id AS dst, {rnd('list_distance(a.vec, b.vec)')} AS dist FROM sv a, sv b WHERE a.cell_id <> b.cell_id),
sg AS (
  SELECT src, dst, CAST(rank AS INTEGER) AS rank, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM sd) WHERE rank <= 15)"""


@query("knn_pivot_graph", SCORE_GRAPH_SQL + " SELECT * FROM sg")
def knn_pivot_graph_q(spark, sf):
    """Exact kNN graph of all cells in the space of the scores, where bounds leave out most partitions."""
    found = knnindex.knn_pivot(score_vectors(spark, sf), score_vectors(spark, sf), 15, exclude_self=True, block_rows=PIVOT_BLOCK)
    return found.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), "rank", "dist")


@query("knn_ivf_recall", SCORES_SQL + """
SELECT CAST(15 AS INTEGER) AS k, count(DISTINCT cell_id) AS queries, count(DISTINCT cell_id) * 15 AS wanted, TRUE AS recall_at_least_90_percent
FROM scores""")
def knn_ivf_recall_q(spark, sf):
    """Inverted lists against the exact neighbours, for every cell."""
    v = score_vectors(spark, sf)
    near = cut_lineage(knnindex.knn_approximate(v, v, 15, probes=8, exclude_self=True))
    got = knnindex.recall(near, neighbors.knn_join(v, v, 15, exclude_self=True))
    return got.select(F.lit(15).alias("k"), (F.col("wanted") / 15).cast("bigint").alias("queries"), "wanted",
                      (F.col("hit") >= 0.9 * F.col("wanted")).alias("recall_at_least_90_percent"))


# K3 connectivities -----------------------------------------------------------------
@query("knn_connectivities", SCORE_GRAPH_SQL + f""",
cr AS (
  SELECT src, list(dist ORDER BY dist, dst) AS d, coalesce(min(dist) FILTER (WHERE dist > 0), 0.0) AS near, max(dist) AS top, avg(dist) AS mean
  FROM sg GROUP BY src),
cw AS (
  SELECT src, near, mean, list_reduce(
           list_transform(range(0, {neighbors.BISECTIONS + 1}), lambda i: {{'lo': 0.0::DOUBLE, 'hi': top * {neighbors.WIDEST}::DOUBLE}}),
           lambda a, b: CASE WHEN list_sum(list_transform(d, lambda x: CASE WHEN x <= near THEN 1.0 ELSE exp(-(x - near) / ((a.lo + a.hi) / 2)) END)) > log2(15.0)
                        THEN {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} ELSE {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} END) AS r
  FROM cr),
cx AS (SELECT src, near, greatest((r.lo + r.hi) / 2, mean * {neighbors.NARROWEST}::DOUBLE) AS width FROM cw),
ce AS (SELECT sg.src, sg.dst, CASE WHEN dist <= near THEN 1.0 ELSE exp(-(dist - near) / width) END AS w FROM sg JOIN cx ON sg.src = cx.src)
SELECT src, dst, {rnd('sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0.0 END')} AS w
FROM (SELECT src, dst, w FROM ce UNION ALL SELECT dst, src, w FROM ce) GROUP BY src, dst""")
def knn_connectivities_q(spark, sf):
    """Weights of the kNN graph of all cells in the space of the scores."""
    v = score_vectors(spark, sf)
    graph = neighbors.neighbors(v, 15)
    return neighbors.connectivities(graph, 15).withColumn("w", round_half_up("w"))
