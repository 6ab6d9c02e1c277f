"""Highly variable genes, dispersion ("seurat") flavour, optionally per
batch (N3, N3b).

Input: the library-size normalised matrix *before* the log (the flavour
works on expm1 of the log data, which is that matrix).  Per gene and batch,
over all cells of the batch including implicit zeros:

    m = S1/n, s2 = (S2 - n m^2)/(n - 1), d = ln(s2/m), lm = ln(1 + m)
    bin = min(19, floor((lm - lo)/(hi - lo) * 20))    (lo/hi over the batch)
    norm = (d - mean_bin(d)) / std_bin(d);   a bin with one gene -> 1

The per-batch top ``n_top`` by norm are flagged; genes are then ranked by
(number of batches flagged desc, mean norm over batches desc, gene_id) and
the first ``n_top`` kept.  Bins are left-closed (the original cuts are
right-closed; they differ only for a value exactly on an edge), and a gene
absent from a batch counts 0 in the mean norm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.functions.hashing import round_half_up, safe_div
from countframe.operators.normalize import moments_with_zeros, stored_moments
from countframe.session import cut_lineage

N_BINS = 20


def dispersion_table(x_norm: DataFrame, obs: DataFrame, batch: str | None = None,
                     value: str = "value") -> DataFrame:
    """(batch, gene_id, mean, log_disp, log_mean, bin, norm) per batch."""
    if batch is None:
        xb = x_norm.withColumn("_batch", F.lit("all"))
        per = xb.groupBy("_batch", "gene_id").agg(*stored_moments(value))
        # one batch: the number of cells is a scalar subquery
        per = per.withColumn("_n", obs.select(F.count(F.lit(1))).scalar())
    else:
        # the row table carries the batch of each cell (one row per cell)
        xb = x_norm.join(obs.select("cell_id", F.col(batch).alias("_batch")), "cell_id")
        cells = obs.groupBy(F.col(batch).alias("_batch")).agg(F.count(F.lit(1)).alias("_n"))
        per = xb.groupBy("_batch", "gene_id").agg(*stored_moments(value))
        # one row per batch; AQE broadcasts it once it has measured it
        per = per.join(cells, "_batch")
    mean, var = moments_with_zeros(F.col("_n").cast("double"))
    # the per-(batch, gene) table is small (genes x batches) and is read
    # by several aggregates and scalar subqueries below: materialise it once
    # so the whole matrix is scanned a single time
    per = cut_lineage(per.select("_batch", "gene_id", mean.alias("mean"), var.alias("var")))
    disp = safe_div(F.col("var"), F.col("mean"))
    per = per.select("_batch", "gene_id", "mean",
                     F.when(disp > 0, F.log(disp)).alias("log_disp"),
                     F.log1p("mean").alias("log_mean"))
    # per-batch range of log means: an aggregate joined back (one row per
    # batch), not a window holding every gene of a batch
    if batch is None:
        # one batch: the range is two scalar subqueries (a join on the
        # constant batch key would become a nested-loop join)
        per = per.withColumn("_lo", per.select(F.min("log_mean")).scalar()) \
                 .withColumn("_hi", per.select(F.max("log_mean")).scalar())
    else:
        rng = per.groupBy("_batch").agg(F.min("log_mean").alias("_lo"), F.max("log_mean").alias("_hi"))
        per = per.join(rng, "_batch")
    frac = safe_div(F.col("log_mean") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    per = per.withColumn("bin", F.least(F.lit(N_BINS - 1),
                                         F.coalesce(F.floor(frac * N_BINS), F.lit(0))).cast("int"))
    # per-bin mean / std of the log dispersion: at most 20 rows per batch
    bins = per.groupBy("_batch", "bin").agg(F.avg("log_disp").alias("_bm"), F.stddev_samp("log_disp").alias("_bs"))
    per = per.join(bins, ["_batch", "bin"])
    norm = F.when(F.col("log_disp").isNull(), F.lit(None).cast("double")) \
        .when(F.col("_bs").isNull(), F.lit(1.0)) \
        .otherwise(safe_div(F.col("log_disp") - F.col("_bm"), F.col("_bs")))
    return per.withColumn("norm", norm).select(
        F.col("_batch").alias("batch"), "gene_id", "mean", "log_disp", "log_mean", "bin", "norm")


def highly_variable(x_norm: DataFrame, obs: DataFrame, n_top: int = 2000, batch: str | None = None,
                    value: str = "value", dispersions: DataFrame | None = None) -> DataFrame:
    """N3/N3b. (gene_id, n_batches, dispersion_norm, highly_variable, rank);
    ``rank`` is the position among the selected genes (NULL otherwise).
    ``dispersions``: the ``dispersion_table`` of these rows, if it is there."""
    d = dispersions if dispersions is not None else dispersion_table(x_norm, obs, batch, value)
    # ranks compare values rounded to 1e-9, so that last-bit differences of
    # floating sums never reorder genes
    d = d.withColumn("_n9", round_half_up("norm", 9))
    # per-batch top n: rank() <= n  <=>  norm >= the n-th largest norm of the
    # batch.  row_number <= n is limited per partition before the shuffle.
    # Spark does that up to 1000 rows; a larger n first ranks within 1024
    # groups of genes, so that at most 1024 n rows of a batch meet.
    def top_rows(rows, *by):
        w = Window.partitionBy(*by).orderBy(F.col("_n9").desc())
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_top).drop("_r")

    top_b = d.where(F.col("_n9").isNotNull())
    if n_top > 1000:
        top_b = top_rows(top_b.withColumn("_g", F.pmod(F.xxhash64("gene_id"), F.lit(1024))), "batch", "_g")
    top_b = top_rows(top_b, "batch")
    if batch is None:
        d = d.withColumn("_cut", top_b.select(F.min("_n9")).scalar())
    else:
        d = d.join(top_b.groupBy("batch").agg(F.min("_n9").alias("_cut")), "batch", "left")
    d = d.withColumn("flag", F.coalesce(F.col("_n9") >= F.col("_cut"), F.lit(False)))
    n_batches = (obs.select(batch).distinct().select(F.count(F.lit(1))).scalar()
                 if batch is not None else F.lit(1))
    g = d.groupBy("gene_id").agg(
        F.count_if("flag").alias("n_batches"),
        F.sum(F.coalesce("norm", F.lit(0.0))).alias("_sn"))
    g = g.withColumn("dispersion_norm", F.col("_sn") / n_batches) \
        .withColumn("_d9", round_half_up("dispersion_norm", 9))
    # overall top n: a bounded take-ordered, numbered, broadcast back
    order = [F.col("n_batches").desc(), F.col("_d9").desc(), F.col("gene_id")]
    top = g.orderBy(*order).limit(n_top).select("gene_id", "n_batches", "_d9")
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("gene_id", "rank")
    g = g.join(F.broadcast(top), "gene_id", "left")
    return g.select("gene_id", "n_batches", "dispersion_norm",
                    F.col("rank").isNotNull().alias("highly_variable"), F.col("rank").cast("int").alias("rank"))
