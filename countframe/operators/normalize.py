"""Library-size normalisation, log transform, zero-aware gene statistics
and scaling (N1, N2, N4-N7).

Sparse entries stay sparse until scaling; every statistic counts the
implicit zeros through the number of cells ``n_cells`` (all cells of ``obs``,
also cells without any entry).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.functions.hashing import safe_div
from countframe.operators.features import MAX_FEATURES, axis_size, cell_entries, dense_vectors

TARGET_SUM = 1e4
MAX_VALUE = 10.0


def normalize_total(cf: CountFrame, target: float = TARGET_SUM) -> CountFrame:
    """N1. value = count * target / cell total.  The per-cell window is
    bounded by the number of genes; cells without entries stay empty."""
    vc = cf.value_col
    total = F.sum(F.col(vc)).over(Window.partitionBy("cell_id"))
    x = cf.x.select("cell_id", "gene_id",
                    safe_div(F.col(vc).cast("double") * F.lit(float(target)), total).alias("value"))
    return cf.with_x(x)


def log1p(cf: CountFrame) -> CountFrame:
    """N2. ln(1 + value) on stored entries (zero stays zero)."""
    vc = cf.value_col
    return cf.with_x(cf.x.select("cell_id", "gene_id", F.log1p(F.col(vc).cast("double")).alias("value")))


def gene_stats(x: DataFrame, n_cells: Column | int, value: str = "value") -> DataFrame:
    """N4. Per gene mean and sample std over *all* cells:
    the squared deviations of the stored entries about their own mean, moved to
    the overall mean, plus those of the zeros.  One aggregation, never dense."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    g = x.groupBy("gene_id").agg(*stored_moments(value))
    mean, var = moments_with_zeros(n)
    return g.select("gene_id", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def stored_moments(value: str = "value") -> list[Column]:
    return [F.count(value).alias("_m"), F.avg(value).alias("_a"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("_v")]


def moments_with_zeros(n) -> tuple[Column, Column]:
    """Mean and sample variance over n cells, from the moments of the stored
    entries; no difference of large sums."""
    m, a, v = F.col("_m"), F.col("_a"), F.col("_v")
    mean = safe_div(m * a, n)
    squares = (m - 1) * v + m * (a - mean) * (a - mean) + (n - m) * mean * mean
    return mean, safe_div(squares, n - 1)


def n_cells_of(obs: DataFrame) -> Column:
    return obs.select(F.count(F.lit(1))).scalar()


def _stats_arrays(stats: DataFrame, genes: DataFrame) -> tuple[list[float], list[float]]:
    """Means and stds in gene_idx order, collected with a size check (the
    feature axis is bounded: a selected gene list)."""
    rows = (genes.select("gene_id", "gene_idx").join(stats, "gene_id", "left")
            .orderBy("gene_idx").limit(MAX_FEATURES + 1).collect())
    if len(rows) > MAX_FEATURES:
        raise ValueError("feature axis too wide for dense scaling")
    means = [float(r["mean"]) if r["mean"] is not None else 0.0 for r in rows]
    stds = [float(r["std"]) if r["std"] not in (None, 0.0) else 1.0 for r in rows]
    return means, stds


def scale_vectors(x: DataFrame, genes: DataFrame, cells: DataFrame, stats: DataFrame,
                  max_value: float | None = MAX_VALUE, value: str = "value") -> DataFrame:
    """N5/N6. Dense standardised vectors (cell_id, vec): z = (v - mean)/std
    with std 0 -> 1, clipped to [-max_value, max_value].  Implicit zeros
    become -mean/std.  ``stats`` may come from another dataset (training
    statistics applied to query data)."""
    means, stds = _stats_arrays(stats, genes)
    return dense_vectors(cell_entries(x, genes, cells, value), axis_size(genes), (means, stds, max_value))


def entry_scaling(rows: DataFrame, g: int, max_value: float | None = MAX_VALUE, n: int | None = None) -> tuple:
    """N4/N5 for ``features.dense_vectors``: (means, stds, max_value) over all
    ``rows`` (entries MAP<gene_idx, value>), absent entries counted as 0.  One
    aggregation of g rows, and the number of rows (``n``: of cells, if some
    have no row)."""
    n = rows.count() if n is None else n
    entry = rows.select(F.explode("entries").alias("idx", "value"))
    mean, var = moments_with_zeros(F.lit(n))
    got = entry.groupBy("idx").agg(*stored_moments()).select("idx", mean.alias("mean"), var.alias("var")).toArrow()
    means, stds = np.zeros(g), np.ones(g)
    at = got["idx"].to_numpy()
    v = np.sqrt(np.maximum(np.nan_to_num(got["var"].to_numpy().astype(float)), 0))
    means[at], stds[at] = np.nan_to_num(got["mean"].to_numpy().astype(float)), np.where(v > 0, v, 1.0)
    return means.tolist(), stds.tolist(), max_value


def scale(cf: CountFrame, genes: DataFrame, stats: DataFrame | str = "self",
          max_value: float | None = MAX_VALUE) -> DataFrame:
    """N5-N7 on a CountFrame: ``stats="self"`` computes them on ``cf``."""
    vals = cf.values()
    if isinstance(stats, str):
        stats = gene_stats(vals.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi"),
                           n_cells_of(cf.obs))
    return scale_vectors(vals, genes, cf.obs, stats, max_value)


def vectors_to_long(vecs: DataFrame, genes: DataFrame, vec: str = "vec", value: str = "value") -> DataFrame:
    """(cell_id, gene_id, value) from dense vectors on a (bounded) axis."""
    long = vecs.select("cell_id", F.posexplode(vec).alias("gene_idx", value))
    return long.join(F.broadcast(genes.select("gene_id", "gene_idx")), "gene_idx").select("cell_id", "gene_id", value)


def scale_dense(vecs: DataFrame, max_value: float | None = MAX_VALUE, vec: str = "vec") -> DataFrame:
    """N5 on dense vectors that already hold every cell (implicit zeros
    included): per-feature mean and sample variance in one MLlib
    ``Summarizer`` pass, then a row-local standardise-and-clip.  Meant for a
    materialised vector table that later stages read several times."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    summ = vecs.select(Summarizer.metrics("mean", "variance").summary(array_to_vector(vec)).alias("s")).first()["s"]
    means = [float(x) for x in summ["mean"].toArray()]
    stds = [float(x) ** 0.5 if x > 0 else 1.0 for x in summ["variance"].toArray()]
    if len(means) > MAX_FEATURES:
        raise ValueError("feature axis too wide for dense scaling")
    mu, sd = F.lit(means), F.lit(stds)

    def z(v, i):
        s = (v - F.element_at(mu, i + 1)) / F.element_at(sd, i + 1)
        return F.greatest(F.least(s, F.lit(max_value)), F.lit(-max_value)) if max_value is not None else s

    return vecs.withColumn(vec, F.transform(vec, lambda v, i: z(v, i)))
