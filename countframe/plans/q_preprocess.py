"""Preprocessing queries: normalise, log, variable genes, statistics,
scaling, gene-set joins and alignment (N1-N7, P6, P7, P9, J1-J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.functions.hashing import round_half_up
from countframe.operators import features, hvg, normalize
from countframe.plans.catalog import query
from countframe.plans.sqlbits import (
    F1, F2, F4, hvg_ctes, log_cte, norm_cte, rnd, scale_cte, stats_cte, with_,
)
from countframe.sources import fixtures

N_TOP_BATCH = 50     # per-batch variable genes on the 150-gene F1 matrix
N_TOP = 1000         # variable genes on the documents x tokens matrix
N_TOP_KNN = 100      # variable genes of the PCA + kNN mapping: twice the others', like the reference's 2000 and 1000


def _r(df, col="value", digits=6):
    return df.withColumn(col, round_half_up(col, digits))


# ---- shared Spark steps ------------------------------------------------------
def f1_base(spark, sf, materialize: bool = False) -> CountFrame:
    """F1; multi-pass plans materialise it once instead of re-running the
    three-way join for every pass."""
    cf = fixtures.customer_products(spark, sf)
    return fixtures.materialize(cf) if materialize else cf


def f1_norm(spark, sf, base: CountFrame | None = None) -> CountFrame:
    return normalize.normalize_total(base if base is not None else fixtures.customer_products(spark, sf))


def f1_log(spark, sf, base: CountFrame | None = None) -> CountFrame:
    return normalize.log1p(f1_norm(spark, sf, base))


def f1_hvg(spark, sf, base: CountFrame | None = None):
    cf = f1_norm(spark, sf, base)
    return hvg.highly_variable(cf.x, cf.obs, N_TOP_BATCH, batch="batch")


def hvg_axis(hv):
    """Selected genes as a vector axis, indexed alphabetically (bounded by
    the top-n parameter, materialised once)."""
    return features.freeze_axis(features.index_genes(hv.where("highly_variable").select("gene_id")))


# ---- shared SQL steps --------------------------------------------------------
F1_LOG = with_(F1, norm_cte("f1_x", "f1_norm"), log_cte("f1_norm", "f1_log"))
F1_HVG = F1_LOG + "," + hvg_ctes("f1_norm", "f1_obs", N_TOP_BATCH, True, "f1_hv") + """,
f1_axis AS (
  SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS gene_idx
  FROM f1_hv WHERE highly_variable)"""


# N1 ---------------------------------------------------------------------------
@query("normalize_total", with_(F1, norm_cte("f1_x", "f1_norm")) +
       f" SELECT cell_id, gene_id, {rnd('value')} AS value FROM f1_norm")
def normalize_total_q(spark, sf):
    return _r(f1_norm(spark, sf).x)


# N2 ---------------------------------------------------------------------------
@query("log_normalize", F1_LOG + f" SELECT cell_id, gene_id, {rnd('value')} AS value FROM f1_log")
def log_normalize_q(spark, sf):
    return _r(f1_log(spark, sf).x)


# N3 ---------------------------------------------------------------------------
# the rank among selected genes is NULL for the others; the query reports
# the flag (a nullable integer column would not compare across engines)
_HVG_OUT = f"SELECT gene_id, n_batches, {rnd('dispersion_norm')} AS dispersion_norm, highly_variable"


@query("hvg_batch", F1_HVG + f" {_HVG_OUT} FROM f1_hv")
def hvg_batch_q(spark, sf):
    return _r(f1_hvg(spark, sf), "dispersion_norm").drop("rank")


# N3b --------------------------------------------------------------------------
@query("hvg", with_(F4, norm_cte("f4_x", "f4_norm")) + "," +
       hvg_ctes("f4_norm", "f4_obs", N_TOP, False, "f4_hv") + f" {_HVG_OUT} FROM f4_hv")
def hvg_q(spark, sf):
    cf = normalize.normalize_total(fixtures.document_tokens(spark, sf))
    return _r(hvg.highly_variable(cf.x, cf.obs, N_TOP), "dispersion_norm").drop("rank")


# N4 ---------------------------------------------------------------------------
@query("gene_stats", F1_LOG + "," + stats_cte("f1_log", "(SELECT count(*) FROM f1_obs)", "f1_st") +
       f" SELECT gene_id, {rnd('mean')} AS mean, {rnd('std')} AS std FROM f1_st")
def gene_stats_q(spark, sf):
    cf = f1_log(spark, sf)
    st = normalize.gene_stats(cf.x, normalize.n_cells_of(cf.obs))
    return _r(_r(st, "mean"), "std")


# P6 ---------------------------------------------------------------------------
@query("select_features", F1_HVG + f"""
SELECT cell_id, gene_id, {rnd('value')} AS value FROM f1_log
WHERE gene_id IN (SELECT gene_id FROM f1_hv WHERE highly_variable)""")
def select_features_q(spark, sf):
    base = f1_base(spark, sf, materialize=True)
    cf = f1_log(spark, sf, base).with_var(f1_hvg(spark, sf, base))
    return _r(features.select_features(cf, "highly_variable").x)


# N5 ---------------------------------------------------------------------------
@query("scale_clip", F1_HVG + """,
f1_sel AS (SELECT * FROM f1_log WHERE gene_id IN (SELECT gene_id FROM f1_axis)),""" +
       stats_cte("f1_sel", "(SELECT count(*) FROM f1_obs)", "f1_sst") + "," +
       scale_cte("f1_sel", "f1_axis", "f1_obs", "f1_sst", "f1_z") +
       f" SELECT cell_id, gene_id, {rnd('value')} AS value FROM f1_z")
def scale_clip_q(spark, sf):
    base = f1_base(spark, sf, materialize=True)
    cf = f1_log(spark, sf, base)
    axis = hvg_axis(f1_hvg(spark, sf, base))
    vecs = normalize.scale(cf, axis, "self")
    return _r(normalize.vectors_to_long(vecs, axis))


# P9 ---------------------------------------------------------------------------
@query("dense_vectors", F1_HVG + """
SELECT c.cell_id, g.gene_idx, CAST(coalesce(x.n, 0) AS DOUBLE) AS value
FROM f1_obs c CROSS JOIN f1_axis g
LEFT JOIN f1_x x ON x.cell_id = c.cell_id AND x.gene_id = g.gene_id""")
def dense_vectors_q(spark, sf):
    f1 = f1_base(spark, sf, materialize=True)
    axis = hvg_axis(f1_hvg(spark, sf, f1))
    vecs = features.to_vectors(f1.values(), axis, f1.obs)
    return vecs.select("cell_id", F.posexplode("vec").alias("gene_idx", "value"))


# ---- F2: reference / query pair -------------------------------------------------
def f2_pair(spark, sf, materialize: bool = False):
    """(reference, query) of F2, over one materialised F1 when asked."""
    return fixtures.reference_query_pair(spark, sf, f1_base(spark, sf, materialize) if materialize else None)


def f2_logs(spark, sf, pair=None):
    ref, qry = pair if pair is not None else fixtures.reference_query_pair(spark, sf)
    return normalize.log1p(normalize.normalize_total(ref)), normalize.log1p(normalize.normalize_total(qry))


def f2_dispersions(ref: CountFrame):
    """Per batch and gene of the reference, whatever the length of the list
    that is taken from it."""
    rn = normalize.normalize_total(ref)
    return hvg.dispersion_table(rn.x, rn.obs, "batch")


def f2_train_axis(spark, sf, pair=None, n_top: int = N_TOP_BATCH, dispersions=None):
    """Training feature list: per-batch variable genes of the reference."""
    ref, _ = pair if pair is not None else fixtures.reference_query_pair(spark, sf)
    rn = normalize.normalize_total(ref)
    return hvg_axis(hvg.highly_variable(rn.x, rn.obs, n_top, batch="batch", dispersions=dispersions))


F2_SQL = with_(F2, norm_cte("f2_ref_x", "f2_ref_norm"), log_cte("f2_ref_norm", "f2_ref_log"),
               norm_cte("f2_qry_x", "f2_qry_norm"), log_cte("f2_qry_norm", "f2_qry_log")) + """,
f2_ref_genes AS (SELECT DISTINCT gene_id FROM f2_ref_x),
f2_qry_genes AS (SELECT DISTINCT gene_id FROM f2_qry_x),
f2_common AS (SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS gene_idx
              FROM f2_ref_genes WHERE gene_id IN (SELECT gene_id FROM f2_qry_genes)),""" + \
    hvg_ctes("f2_ref_norm", "f2_ref_obs", N_TOP_BATCH, True, "f2_hv") + """,
f2_axis AS (
  SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) - 1 AS INTEGER) AS gene_idx
  FROM f2_hv WHERE highly_variable)"""


def f2_common_axis(spark, sf, pair=None):
    ref, qry = pair if pair is not None else fixtures.reference_query_pair(spark, sf)
    return features.freeze_axis(features.index_genes(features.common_genes(ref.genes(), qry.genes())))


# J1 ---------------------------------------------------------------------------
@query("common_genes", F2_SQL + " SELECT gene_id FROM f2_common")
def common_genes_q(spark, sf):
    ref, qry = fixtures.reference_query_pair(spark, sf)
    return features.common_genes(ref.genes(), qry.genes()).select("gene_id")


# J2 ---------------------------------------------------------------------------
@query("genes_present", F2_SQL + " SELECT gene_id, gene_idx FROM f2_axis WHERE gene_id IN (SELECT gene_id FROM f2_qry_genes)")
def genes_present_q(spark, sf):
    _, qry = fixtures.reference_query_pair(spark, sf)
    return features.genes_present(f2_train_axis(spark, sf), qry.genes())


# J3 ---------------------------------------------------------------------------
@query("genes_missing", F2_SQL + " SELECT gene_id, gene_idx FROM f2_axis WHERE gene_id NOT IN (SELECT gene_id FROM f2_qry_genes)")
def genes_missing_q(spark, sf):
    _, qry = fixtures.reference_query_pair(spark, sf)
    return features.genes_missing(f2_train_axis(spark, sf), qry.genes())


# J4 ---------------------------------------------------------------------------
@query("align_features", F2_SQL + f"""
SELECT c.cell_id, g.gene_id, {rnd('coalesce(v.value, 0.0)')} AS value
FROM f2_qry_obs c CROSS JOIN f2_axis g
LEFT JOIN f2_qry_log v ON v.cell_id = c.cell_id AND v.gene_id = g.gene_id""")
def align_features_q(spark, sf):
    pair = f2_pair(spark, sf, materialize=True)
    _, qlog = f2_logs(spark, sf, pair)
    return _r(features.align_features(qlog.x, f2_train_axis(spark, sf, pair), qlog.obs))


# P7 ---------------------------------------------------------------------------
@query("select_genes", F2_SQL + " SELECT cell_id, gene_id, n FROM f2_qry_x WHERE gene_id IN (SELECT gene_id FROM f2_common)")
def select_genes_q(spark, sf):
    _, qry = fixtures.reference_query_pair(spark, sf)
    return features.select_genes(qry.x, f2_common_axis(spark, sf))


# N6 ---------------------------------------------------------------------------
@query("scale_with_train_stats", F2_SQL + """,
f2_ref_sel AS (SELECT * FROM f2_ref_log WHERE gene_id IN (SELECT gene_id FROM f2_common)),""" +
       stats_cte("f2_ref_sel", "(SELECT count(*) FROM f2_ref_obs)", "f2_tst") + "," +
       scale_cte("f2_qry_log", "f2_common", "f2_qry_obs", "f2_tst", "f2_z") +
       f" SELECT cell_id, gene_id, {rnd('value')} AS value FROM f2_z")
def scale_with_train_stats_q(spark, sf):
    pair = f2_pair(spark, sf, materialize=True)
    rlog, qlog = f2_logs(spark, sf, pair)
    axis = f2_common_axis(spark, sf, pair)
    train = features.select_genes(rlog.x, axis)
    st = normalize.gene_stats(train, normalize.n_cells_of(rlog.obs))
    vecs = normalize.scale(qlog, axis, st)
    return _r(normalize.vectors_to_long(vecs, axis))


# N7 ---------------------------------------------------------------------------
@query("scale_self_stats", F2_SQL + """,
f2_qry_sel AS (SELECT * FROM f2_qry_log WHERE gene_id IN (SELECT gene_id FROM f2_common)),""" +
       stats_cte("f2_qry_sel", "(SELECT count(*) FROM f2_qry_obs)", "f2_sst") + "," +
       scale_cte("f2_qry_log", "f2_common", "f2_qry_obs", "f2_sst", "f2_z") +
       f" SELECT cell_id, gene_id, {rnd('value')} AS value FROM f2_z")
def scale_self_stats_q(spark, sf):
    pair = f2_pair(spark, sf, materialize=True)
    _, qlog = f2_logs(spark, sf, pair)
    axis = f2_common_axis(spark, sf, pair)
    return _r(normalize.vectors_to_long(normalize.scale(qlog, axis, "self"), axis))
