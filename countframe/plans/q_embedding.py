"""Embedding queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from countframe.functions.hashing import hash16, round_half_up
from countframe.operators import dispersion, embed, features, hvg, moments, normalize, sampling, sparsepca
from countframe.plans.catalog import query
from countframe.frame import CountFrame
from countframe.plans.q_preprocess import (
    F1_HVG, F1_LOG, F2_SQL, f1_base, f1_hvg, f1_log, f2_pair, f2_train_axis, hvg_axis,
)
from countframe.plans.sqlbits import h, rnd, scale_cte, stats_cte
from countframe.session import cut_lineage
from countframe.sources import fixtures

N_TOP_DOCS = 1000


def f4_entries(spark, sf, n_top: int = N_TOP_DOCS, f4: CountFrame | None = None):
    """Documents x tokens: normalise, log, top variable tokens.  Returns (the
    entries of every document, written once; axis; scaling; masked obs).
    ``f4``: the counts, if they are written already."""
    f4 = fixtures.materialize(fixtures.document_tokens(spark, sf)) if f4 is None else f4     # tokenised once
    norm = normalize.normalize_total(f4)
    hv = hvg.highly_variable(norm.x, norm.obs, n_top)
    axis = hvg_axis(hv)
    logcf = normalize.log1p(norm)
    # model fits make several passes: the entries are written, and made dense
    # and scaled (row-local) inside each pass
    sel = features.select_genes(logcf.x, axis)
    rows = cut_lineage(features.cell_entries(sel, axis, logcf.obs))
    return rows, axis, normalize.entry_scaling(rows, features.axis_size(axis)), sampling.mask_labels(f4.obs)


def f4_dense(rows, axis, scaling):
    """Scaled vectors of (rows of) the entries; other columns are kept."""
    return features.dense_vectors(rows, features.axis_size(axis), scaling)


def f4_features(spark, sf, n_top: int = N_TOP_DOCS):
    """(scaled vectors, axis, masked obs) of documents x tokens."""
    rows, axis, scaling, mobs = f4_entries(spark, sf, n_top)
    return f4_dense(rows, axis, scaling), axis, mobs


def _long(latent, name="score"):
    return latent.select("cell_id", F.posexplode("vec").alias("pc", name))


# D1 ---------------------------------------------------------------------------
@query("pca_scores")
def pca_scores_q(spark, sf):
    vecs, _, _ = f4_features(spark, sf)
    res = embed.pca(vecs, 50)
    return _long(res.latent).withColumn("score", round_half_up("score"))


# D2 ---------------------------------------------------------------------------
SCORES_SQL = (F1_LOG + ",\nf1_genes AS (SELECT DISTINCT gene_id FROM f1_x)," +
              stats_cte("f1_log", "(SELECT count(*) FROM f1_obs)", "f1_st") + "," +
              scale_cte("f1_log", "f1_genes", "f1_obs", "f1_st", "f1_z") + f""",
f6 AS (
  SELECT g.gene_id, CAST(r.pc AS INTEGER) AS pc,
         CAST({h("g.gene_id || ':' || CAST(r.pc AS VARCHAR)", 11)} AS DOUBLE) / 65536.0 - 0.5 AS w
  FROM f1_genes g, range(0, 5) r(pc)),
scores AS (
  SELECT z.cell_id, f6.pc, {rnd('sum(z.value * f6.w)')} AS score
  FROM f1_z z JOIN f6 ON z.gene_id = f6.gene_id GROUP BY 1, 2)""")


@query("pca_project", SCORES_SQL + " SELECT * FROM scores")
def pca_project_q(spark, sf):
    cf = f1_log(spark, sf)
    stats = normalize.gene_stats(cf.x, normalize.n_cells_of(cf.obs))
    loadings = fixtures.rule_loadings(cf.genes(), 5)
    sc = embed.project(cf.x, loadings, cf.obs, 5, stats)
    return sc.withColumn("score", round_half_up("score"))


# D4 ---------------------------------------------------------------------------
@query("reconstruction_error")
def reconstruction_error_q(spark, sf):
    vecs, _, _ = f4_features(spark, sf)
    _, mse = embed.linear_autoencoder(vecs, 64)
    return mse.withColumn("mse", round_half_up("mse"))


# D5 ---------------------------------------------------------------------------
@query("nb_residuals", F1_HVG + f""",
nb_ct AS (
  SELECT o.cell_id, o.batch, coalesce(t.tot, 0.0) AS t FROM f1_obs o
  LEFT JOIN (SELECT cell_id, CAST(sum(n) AS DOUBLE) AS tot FROM f1_x GROUP BY 1) t ON t.cell_id = o.cell_id),
nb_bt AS (SELECT o.batch, CAST(sum(x.n) AS DOUBLE) AS T FROM f1_x x JOIN f1_obs o ON x.cell_id = o.cell_id GROUP BY 1),
nb_gt AS (
  SELECT o.batch, x.gene_id, CAST(sum(x.n) AS DOUBLE) AS g
  FROM f1_x x JOIN f1_obs o ON x.cell_id = o.cell_id GROUP BY 1, 2),
nb_dense AS (
  SELECT c.cell_id, c.batch, c.t, a.gene_id, CAST(coalesce(x.n, 0) AS DOUBLE) AS v
  FROM nb_ct c CROSS JOIN f1_axis a LEFT JOIN f1_x x ON x.cell_id = c.cell_id AND x.gene_id = a.gene_id),
nb_mu AS (
  SELECT d.*, d.t * coalesce(g.g, 0.0) / b.T AS mu FROM nb_dense d
  LEFT JOIN nb_bt b ON b.batch = d.batch LEFT JOIN nb_gt g ON g.batch = d.batch AND g.gene_id = d.gene_id),
nb_n AS (SELECT sqrt(CAST(count(*) AS DOUBLE)) AS c FROM f1_obs)
SELECT cell_id, gene_id,
       {rnd('CASE WHEN mu > 0 THEN greatest(least((v - mu) / sqrt(mu + mu * mu / 100.0), (SELECT c FROM nb_n)), -(SELECT c FROM nb_n)) ELSE 0.0 END')}
         AS value
FROM nb_mu""")
def nb_residuals_q(spark, sf):
    f1 = f1_base(spark, sf, materialize=True)
    axis = hvg_axis(f1_hvg(spark, sf, f1))
    vecs = embed.nb_residual_vectors(f1, axis, "batch")
    return normalize.vectors_to_long(vecs, axis).withColumn("value", round_half_up("value"))


@query("nb_latent")
def nb_latent_q(spark, sf):
    f1 = f1_base(spark, sf, materialize=True)
    axis = hvg_axis(f1_hvg(spark, sf, f1))
    res = embed.nb_latent(f1, axis, 20, "batch")
    return _long(res.latent).withColumn("score", round_half_up("score"))


# D5 with frozen training totals and an unseen batch (T4's residual step) --------
@query("nb_residuals_unseen_batch", F2_SQL + f""",
u_ct AS (
  SELECT o.cell_id, coalesce(t.tot, 0.0) AS t FROM f2_qry_obs o
  LEFT JOIN (SELECT cell_id, CAST(sum(n) AS DOUBLE) AS tot FROM f2_qry_x GROUP BY 1) t ON t.cell_id = o.cell_id),
u_T AS (SELECT CAST(sum(x.n) AS DOUBLE) AS T FROM f2_ref_x x JOIN f2_ref_obs o ON x.cell_id = o.cell_id),
u_g AS (
  SELECT x.gene_id, CAST(sum(x.n) AS DOUBLE) AS g
  FROM f2_ref_x x JOIN f2_ref_obs o ON x.cell_id = o.cell_id GROUP BY 1),
u_dense AS (
  SELECT c.cell_id, c.t, a.gene_id, CAST(coalesce(x.n, 0) AS DOUBLE) AS v
  FROM u_ct c CROSS JOIN f2_axis a LEFT JOIN f2_qry_x x ON x.cell_id = c.cell_id AND x.gene_id = a.gene_id),
u_mu AS (
  SELECT d.*, d.t * coalesce(g.g, 0.0) / (SELECT T FROM u_T) AS mu
  FROM u_dense d LEFT JOIN u_g g ON g.gene_id = d.gene_id),
u_n AS (SELECT sqrt(CAST(count(*) AS DOUBLE)) AS c FROM f2_ref_obs)
SELECT cell_id, gene_id,
       {rnd('CASE WHEN mu > 0 THEN greatest(least((v - mu) / sqrt(mu + mu * mu / 100.0), (SELECT c FROM u_n)), -(SELECT c FROM u_n)) ELSE 0.0 END')}
         AS value
FROM u_mu""")
def nb_residuals_unseen_batch_q(spark, sf):
    """Query rows without a batch get 'test'; the residuals use the frozen
    reference totals, pooled over its batches for the unseen batch."""
    pair = f2_pair(spark, sf, materialize=True)
    ref, qry = pair
    axis = f2_train_axis(spark, sf, pair)
    qobs = qry.obs.drop("batch")  # the second dataset carries no batch: unseen
    totals = embed.nb_batch_totals(ref, axis, "batch")
    vecs = embed.nb_residual_vectors(CountFrame(qry.x, qobs), axis, "batch", batch_totals=totals, n_train=ref.obs.count())
    return normalize.vectors_to_long(vecs, axis).withColumn("value", round_half_up("value"))


# D1 on long triples ---------------------------------------------------------------
def f4_sparse(spark, sf, n_top: int = N_TOP_DOCS):
    """The same features as ``f4_features``: (entries of the documents that
    have any, written once; size of the axis; all cells)."""
    norm = fixtures.materialize(normalize.normalize_total(fixtures.document_tokens(spark, sf)))
    axis = hvg_axis(hvg.highly_variable(norm.x, norm.obs, n_top))
    sel = features.select_genes(normalize.log1p(norm).x, axis)
    return cut_lineage(features.cell_entries(sel, axis)), features.axis_size(axis), norm.obs


@query("pca_sparse_scores")
def pca_sparse_scores_q(spark, sf):
    res = sparsepca.pca_sparse_entries(*f4_sparse(spark, sf), 50)
    return _long(res.latent).withColumn("score", round_half_up("score"))


@query("pca_sparse_check", """
SELECT CAST(50 AS INTEGER) AS k, TRUE AS angle_below_a_thousandth, TRUE AS shares_equal, TRUE AS orthonormal""")
def pca_sparse_check_q(spark, sf):
    """Components of the long triples against those of the dense vectors."""
    dense = embed.pca(f4_features(spark, sf)[0], 50)
    sparse = sparsepca.pca_sparse_entries(*f4_sparse(spark, sf), 50)
    u = sparse.components
    row = (50, sparsepca.subspace_angle(dense.components, u) < 1e-3, bool(np.abs(dense.explained_ratio - sparse.explained_ratio).max() < 1e-6),
           bool(np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-9))
    return spark.createDataFrame([row], "k int, angle_below_a_thousandth boolean, shares_equal boolean, orthonormal boolean")


# A dispersion per gene ------------------------------------------------------------
@query("nb_dispersion_start", F1_HVG + f""",
dt AS (SELECT o.cell_id, o.batch, CAST(sum(n) AS DOUBLE) AS t FROM f1_obs o JOIN f1_x x ON o.cell_id = x.cell_id GROUP BY 1, 2 HAVING sum(n) > 0),
db AS (SELECT batch, sum(t) AS t FROM dt GROUP BY 1),
dp AS (
  SELECT x.gene_id, dt.batch, CAST(sum(n) AS DOUBLE) / any_value(db.t) AS p FROM f1_x x JOIN f1_axis a ON x.gene_id = a.gene_id
  JOIN dt ON x.cell_id = dt.cell_id JOIN db ON dt.batch = db.batch GROUP BY 1, 2),
dm AS (
  SELECT dp.gene_id, dt.t * dp.p AS mu, CAST(coalesce(x.n, 0) AS DOUBLE) AS y
  FROM dp JOIN dt ON dp.batch = dt.batch LEFT JOIN f1_x x ON x.cell_id = dt.cell_id AND x.gene_id = dp.gene_id),
ds AS (SELECT gene_id, sum(mu * mu) AS mm, sum((y - mu) * (y - mu)) - sum(mu) AS over FROM dm GROUP BY 1)
SELECT a.gene_id, {rnd(f'coalesce(CASE WHEN over > 0 THEN greatest(least(mm / over, {dispersion.MAX_THETA!r}), {dispersion.MIN_THETA!r}) END, {dispersion.MAX_THETA!r})', 4)} AS theta
FROM f1_axis a LEFT JOIN ds ON a.gene_id = ds.gene_id""")
def nb_dispersion_start_q(spark, sf):
    f1 = f1_base(spark, sf, materialize=True)
    return dispersion.dispersion_start(f1, hvg_axis(f1_hvg(spark, sf, f1))).withColumn("theta", round_half_up("theta", 4))


@query("nb_dispersion", F1_HVG + """
SELECT gene_id, TRUE AS in_bounds, TRUE AS not_below_start, TRUE AS rising FROM f1_axis""")
def nb_dispersion_q(spark, sf):
    """The fitted dispersions' invariants; ``dispersion.nb_dispersion`` gives the values."""
    f1 = f1_base(spark, sf, materialize=True)
    found = dispersion.nb_dispersion(f1, hvg_axis(f1_hvg(spark, sf, f1)))
    return found.select("gene_id", F.col("theta").between(dispersion.MIN_THETA, dispersion.MAX_THETA).alias("in_bounds"),
                        (F.col("gain") >= 0).alias("not_below_start"), "rising")


# T1 without a rescan: mergeable moments --------------------------------------------------
@query("merged_moments", F1_HVG + f""",
mv AS (SELECT l.cell_id, a.gene_idx, l.value FROM f1_log l JOIN f1_axis a ON l.gene_id = a.gene_id),
mn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM f1_obs),
ms AS (SELECT gene_idx, sum(value) AS s FROM mv GROUP BY 1),
mg AS (SELECT a.gene_idx AS i, b.gene_idx AS j, sum(a.value * b.value) AS g FROM mv a JOIN mv b ON a.cell_id = b.cell_id AND a.gene_idx <= b.gene_idx GROUP BY 1, 2)
SELECT a.gene_idx AS i, b.gene_idx AS j, {rnd('(coalesce(g, 0.0) - a.s * b.s / n) / (n - 1)')} AS cov
FROM ms a JOIN ms b ON a.gene_idx <= b.gene_idx CROSS JOIN mn LEFT JOIN mg ON mg.i = a.gene_idx AND mg.j = b.gene_idx""")
def merged_moments_q(spark, sf):
    """Covariances from two halves' states, each from its own scan."""
    f1 = f1_base(spark, sf, materialize=True)
    axis = hvg_axis(f1_hvg(spark, sf, f1))
    log = f1_log(spark, sf, f1)
    first = hash16(F.col("cell_id"), 5) < 32_768
    halves = [moments.moments(log.x.where(c), axis, log.obs.where(c)) for c in (first, ~first)]
    return moments.covariance(cut_lineage(moments.merge(*halves))).withColumn("cov", round_half_up("cov"))
