"""Entry 1 of the reference: load -> QC -> summaries -> mask -> label tables,
plus the sampling operators (S1, S2, Q1, Q2, P1, P3, P5, A1-A10, R1-R6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from countframe.frame import UNKNOWN
from countframe.functions.hashing import round_half_up
from countframe.operators import qc, sampling, summary
from countframe.operators.features import ensure_column
from countframe.plans.catalog import query
from countframe.plans.sqlbits import F1, F1_QC, F2, F4, F4_MASKED, F5, exact_k, md5k, rnd, with_
from countframe.sources import describe, fixtures
from countframe.sources.io import read_counts
from countframe.sources.tables import table

QC_METRICS = ["n_genes_by_counts", "total_counts"]


def f1_qc(spark, sf):
    return qc.qc_cells(fixtures.customer_products(spark, sf))


def f4_masked(spark, sf):
    return sampling.mask_labels(fixtures.document_tokens(spark, sf).obs)


# S1 -------------------------------------------------------------------------
@query("load_counts", with_(F1) + " SELECT cell_id, gene_id, n FROM f1_x")
def load_counts(spark, sf):
    f1 = fixtures.customer_products(spark, sf)
    return read_counts(spark, f1.x, f1.obs).x


# S2 -------------------------------------------------------------------------
@query("dataset_shape", with_(F1) + """
SELECT (SELECT count(*) FROM f1_obs) AS n_cells, count(DISTINCT gene_id) AS n_genes,
       count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS total_count
FROM f1_x""")
def dataset_shape(spark, sf):
    return describe(fixtures.customer_products(spark, sf))


# Q1 -------------------------------------------------------------------------
@query("qc_cells", with_(F1_QC) + " SELECT * FROM f1_qc")
def qc_cells(spark, sf):
    return f1_qc(spark, sf).select("cell_id", "batch", "label", *QC_METRICS)


# Q2 -------------------------------------------------------------------------
@query("qc_genes", with_(F1) + f"""
SELECT gene_id, CAST(count_if(n > 0) AS BIGINT) AS n_cells_by_counts, CAST(sum(n) AS BIGINT) AS total_counts,
       {rnd('CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM f1_obs)')} AS mean_counts,
       {rnd('(1.0 - CAST(count_if(n > 0) AS DOUBLE) / (SELECT count(*) FROM f1_obs)) * 100.0')}
         AS pct_dropout_by_counts
FROM f1_x GROUP BY gene_id""")
def qc_genes(spark, sf):
    g = qc.qc_genes(fixtures.customer_products(spark, sf))
    return g.select("gene_id", "n_cells_by_counts", "total_counts",
                    round_half_up("mean_counts").alias("mean_counts"),
                    round_half_up("pct_dropout_by_counts").alias("pct_dropout_by_counts"))


# A1 / A2 --------------------------------------------------------------------
def _summary_sql(by: str, aggs: list[str]) -> str:
    fn = {"mean": "avg({})", "median": "median({})", "std": "stddev_samp({})"}
    cols = ", ".join(f"{rnd(fn[a].format(f'CAST({m} AS DOUBLE)'), 1)} AS {m}_{a}"
                     for m in QC_METRICS for a in aggs)
    return with_(F1_QC) + f" SELECT {by}, {cols} FROM f1_qc GROUP BY {by}"


@query("qc_by_batch", _summary_sql("batch", ["mean", "median", "std"]))
def qc_by_batch(spark, sf):
    return summary.summarize(f1_qc(spark, sf), "batch", QC_METRICS, ("mean", "median", "std"))


@query("qc_by_label", _summary_sql("label", ["mean", "median"]))
def qc_by_label(spark, sf):
    return summary.summarize(f1_qc(spark, sf), "label", QC_METRICS, ("mean", "median"))


# A7 / A8 --------------------------------------------------------------------
def _dist_sql(by: str | None) -> str:
    qs = ", ".join(f"{rnd(f'quantile_cont(v, {q})')} AS q{int(q * 100)}" for q in summary.QUANTILES)
    sel_by = f"{by}, " if by else ""
    unions = " UNION ALL ".join(
        f"SELECT {sel_by}'{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM f1_qc" for m in QC_METRICS)
    return with_(F1_QC) + f"""
SELECT {sel_by}metric, count(v) AS n, {rnd('avg(v)')} AS mean, {qs}
FROM ({unions}) GROUP BY {sel_by}metric"""


@query("qc_distribution", _dist_sql(None))
def qc_distribution(spark, sf):
    return summary.distribution(f1_qc(spark, sf), QC_METRICS)


@query("qc_distribution_by_batch", _dist_sql("batch"))
def qc_distribution_by_batch(spark, sf):
    return summary.distribution(f1_qc(spark, sf), QC_METRICS, by="batch")


# R2 + P1 --------------------------------------------------------------------
@query("label_masking", with_(F4_MASKED) +
       " SELECT cell_id, batch, label_truth, label_masked, masked FROM f4_mobs")
def label_masking(spark, sf):
    return f4_masked(spark, sf).select("cell_id", "batch", "label_truth", "label_masked", "masked")


# A3 / P5 --------------------------------------------------------------------
@query("labeled_split_counts", with_(F4_MASKED) + """
SELECT CAST(count_if(label_masked <> 'Unknown') AS BIGINT) AS n_labeled,
       CAST(count_if(label_masked = 'Unknown') AS BIGINT) AS n_unlabeled
FROM f4_mobs""")
def labeled_split_counts(spark, sf):
    return summary.label_counts(f4_masked(spark, sf))


# A4-A6 ----------------------------------------------------------------------
_CT_SQL = with_(F4_MASKED) + """,
lab AS (SELECT label_truth AS label, batch FROM f4_mobs WHERE label_masked <> 'Unknown'),
ct AS (
  SELECT l.label, b.batch, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT label FROM lab) l
  CROSS JOIN (SELECT DISTINCT batch FROM lab) b
  LEFT JOIN (SELECT label, batch, count(*) AS n FROM lab GROUP BY 1, 2) c
    ON c.label = l.label AND c.batch = b.batch)"""


def _crosstab(spark, sf):
    lab = sampling.labeled(f4_masked(spark, sf)).select(F.col("label_truth").alias("label"), "batch")
    return summary.crosstab(lab, "label", "batch")


@query("crosstab_label_batch", _CT_SQL + " SELECT label, batch, n FROM ct")
def crosstab_label_batch(spark, sf):
    return _crosstab(spark, sf)


@query("crosstab_prop", _CT_SQL + f"""
SELECT label, batch, n, {rnd('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY batch)', 3)} AS prop FROM ct""")
def crosstab_prop(spark, sf):
    return summary.crosstab_prop(_crosstab(spark, sf), "label", "batch")


@query("absent_labels", """
WITH g AS (SELECT role, turn FROM (SELECT DISTINCT role FROM conversations), (SELECT DISTINCT turn FROM conversations)),
n AS (SELECT role, turn, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT g.role FROM g LEFT JOIN n ON g.role = n.role AND g.turn = n.turn GROUP BY g.role HAVING bool_or(n IS NULL)""")
def absent_labels(spark, sf):
    """Roles that some turn of the conversations lacks."""
    turns = table(spark, sf, "conversations").select("role", "turn")
    return summary.absent_labels(summary.crosstab(turns, "role", "turn"), "role")


# R1 -------------------------------------------------------------------------
CAP = 1000


@query("cap_rows", with_(F1) + f""",
kept AS ({exact_k('f1_obs', f'least(N, {CAP})', flag='keep')})
SELECT x.cell_id, x.gene_id, x.n FROM f1_x x
WHERE x.cell_id IN (SELECT cell_id FROM kept WHERE keep)""")
def cap_rows(spark, sf):
    f1 = fixtures.customer_products(spark, sf)
    return sampling.cap_counts(f1.x, sampling.cap_rows(f1.obs, CAP))


# R3 -------------------------------------------------------------------------
@query("stratified_split", with_(F4_MASKED) + f""",
lab AS (SELECT cell_id, label_truth AS label FROM f4_mobs WHERE label_masked <> 'Unknown')
SELECT cell_id, label, is_val FROM ({exact_k('lab', 'floor(0.2 * N + 0.5)', partition='label', flag='is_val')})""")
def stratified_split(spark, sf):
    lab = sampling.labeled(f4_masked(spark, sf)).select("cell_id", F.col("label_truth").alias("label"))
    return sampling.stratified_split(lab, "label", 0.20).select("cell_id", "label", "is_val")


# R4 -------------------------------------------------------------------------
@query("random_split", with_(F4) + """
SELECT cell_id, label, CAST('0x' || substr(md5('42:' || CAST(cell_id AS VARCHAR)), 1, 4) AS BIGINT) < 6553
  AS is_val FROM f4_obs""")
def random_split(spark, sf):
    obs = fixtures.document_tokens(spark, sf).obs
    return sampling.random_split(obs, 0.10).select("cell_id", "label", "is_val")


# R5 -------------------------------------------------------------------------
@query("sample_per_label", with_(F4) + f"""
SELECT cell_id, label FROM (
  SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5k('cell_id', 42)}, cell_id) AS r
  FROM f4_obs) WHERE r <= 100""")
def sample_per_label(spark, sf):
    obs = fixtures.document_tokens(spark, sf).obs
    return sampling.sample_per_label(obs, 100).select("cell_id", "label")


# R6 -------------------------------------------------------------------------
@query("limit_per_label", with_(F4) + """
SELECT cell_id, label FROM (
  SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY cell_id) AS r FROM f4_obs)
WHERE r <= 50""")
def limit_per_label(spark, sf):
    obs = fixtures.document_tokens(spark, sf).obs
    return sampling.limit_per_label(obs, 50).select("cell_id", "label")


# P3 -------------------------------------------------------------------------
@query("query_obs_defaults", with_(F2) + """
SELECT cell_id, 'test' AS batch, 'Unknown' AS label_query FROM f2_qry_obs""")
def query_obs_defaults(spark, sf):
    _, qry = fixtures.reference_query_pair(spark, sf)
    obs = qry.obs.select("cell_id")  # the second dataset carries no batch
    obs = ensure_column(obs, "batch", "test")
    return obs.withColumn("label_query", F.lit(UNKNOWN))


# A9 / A10 -------------------------------------------------------------------
@query("prediction_counts", with_(F5) + " SELECT pred, count(*) AS n FROM f5_preds GROUP BY pred")
def prediction_counts(spark, sf):
    preds = fixtures.rule_predictions(fixtures.document_tokens(spark, sf).obs)
    return summary.value_counts(preds, "pred")


@query("distinct_labels", with_(F4) + """
SELECT DISTINCT label FROM f4_obs WHERE label IS NOT NULL ORDER BY label LIMIT 3""")
def distinct_labels(spark, sf):
    return summary.distinct_labels(fixtures.document_tokens(spark, sf).obs, "label", 3)


# A7 (histogram) ---------------------------------------------------------------
@query("qc_histogram", with_(F1_QC) + """
SELECT batch, bin, count(*) AS n FROM (
  SELECT batch, CAST(least(9, coalesce(floor((n_genes_by_counts - min(n_genes_by_counts) OVER w)
           / nullif(max(n_genes_by_counts) OVER w - min(n_genes_by_counts) OVER w, 0) * 10), 0)) AS INTEGER) AS bin
  FROM f1_qc WINDOW w AS (PARTITION BY batch))
GROUP BY batch, bin""")
def qc_histogram(spark, sf):
    return summary.histogram(f1_qc(spark, sf), "n_genes_by_counts", bins=10, by="batch")
