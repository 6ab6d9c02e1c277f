"""Quality-control metrics.

Per-cell groups are bounded by the number of genes (one entry per
(cell, gene)); per-gene groups can be huge for a gene present everywhere,
so they are plain aggregates whose partial step combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.functions.hashing import safe_div

QC_CELL_COLS = ("n_genes_by_counts", "total_counts")


def qc_cells(cf: CountFrame) -> DataFrame:
    """Q1. obs + n_genes_by_counts (entries > 0) + total_counts.
    Cells without any entry stay, with zeros."""
    vc = cf.value_col
    per_cell = cf.x.groupBy("cell_id").agg(
        F.count_if(F.col(vc) > 0).alias("n_genes_by_counts"),
        F.sum(vc).alias("total_counts"))
    out = cf.obs.join(per_cell, "cell_id", "left")
    zero = F.lit(0).cast(per_cell.schema["total_counts"].dataType)
    return (out.withColumn("n_genes_by_counts", F.coalesce("n_genes_by_counts", F.lit(0).cast("bigint")))
            .withColumn("total_counts", F.coalesce("total_counts", zero)))


def ensure_qc(cf: CountFrame) -> CountFrame:
    """P4. Compute the per-cell QC columns only if they are absent."""
    if all(c in cf.obs.columns for c in QC_CELL_COLS):
        return cf
    return cf.with_obs(qc_cells(cf))


def qc_genes(cf: CountFrame) -> DataFrame:
    """Q2. Per gene: n_cells_by_counts, total_counts, mean_counts and
    pct_dropout_by_counts, dividing by the number of *all* cells."""
    vc = cf.value_col
    n_cells = cf.obs.select(F.count(F.lit(1))).scalar()
    g = cf.x.groupBy("gene_id").agg(
        F.count_if(F.col(vc) > 0).alias("n_cells_by_counts"),
        F.sum(vc).alias("total_counts"))
    return g.select(
        "gene_id", "n_cells_by_counts", "total_counts",
        safe_div(F.col("total_counts"), n_cells).alias("mean_counts"),
        ((1.0 - safe_div(F.col("n_cells_by_counts"), n_cells)) * 100.0).alias("pct_dropout_by_counts"))
