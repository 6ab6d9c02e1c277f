"""Group summaries, cross-tabulations and distributions.

Zero-filled cross-tabs expand each distinct row value by an array of the
distinct column values (a scalar subquery) and join the counts: every (row
value, column value) pair appears without a cross join, and values stay what
they are (any type, any characters).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN
from countframe.functions.hashing import round_half_up, safe_div
from countframe.operators import quantiles
from countframe.session import cut_lineage

_AGGS = {
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
}


APPROX_ACCURACY = 10_000  # percentile sketch: relative rank error about 1e-4


def _quantile(c, q: float):
    """A bounded sketch of the percentile."""
    return F.percentile_approx(c, q, APPROX_ACCURACY).cast("double")


def _with_quantiles(table: DataFrame, df: DataFrame, by: list[str], metrics: Sequence[str], shares: Sequence[float],
                    name, few: int) -> DataFrame:
    """``table`` (one row per group) plus exact quantiles by ``name``(metric, share)."""
    found = quantiles.exact_quantiles(df, by, metrics, shares, few)
    cell = lambda m, s: F.max(F.when((F.col("metric") == m) & (F.col("share") == s), F.col("value"))).alias(name(m, s))
    wide = found.groupBy(*by).agg(*[cell(m, s) for m in metrics for s in shares])
    if not by:
        table, wide = table.withColumn("__cf_one", F.lit(1)), wide.withColumn("__cf_one", F.lit(1))
        return table.join(wide, "__cf_one", "left").drop("__cf_one")
    wide = wide.select(*[F.col(b).alias(f"__cf_{i}") for i, b in enumerate(by)], *[F.col(name(m, s)) for m in metrics for s in shares])
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"__cf_{i}")) for i, b in enumerate(by)])
    return table.join(wide, same, "left").drop(*[f"__cf_{i}" for i in range(len(by))])


def summarize(df: DataFrame, by: str | Sequence[str], metrics: Sequence[str],
              aggs: Sequence[str] = ("mean", "median", "std"), digits: int | None = 1,
              approx: bool = False, few: int = quantiles.FEW) -> DataFrame:
    """A1/A2. ``groupBy(by)`` with <metric>_<agg> columns, rounded half-up.
    std is the sample standard deviation (NULL for a single row); median is
    exact like the reference's, found by distributed selection
    (``quantiles``), or a bounded sketch with ``approx``."""
    by = [by] if isinstance(by, str) else list(by)
    selected = "median" in aggs and not approx
    cols = []
    for m in metrics:
        for a in aggs:
            if a != "median":
                cols.append(_AGGS[a](F.col(m)).cast("double").alias(f"{m}_{a}"))
            elif approx:
                cols.append(_quantile(F.col(m), 0.5).alias(f"{m}_{a}"))
    table = df.groupBy(*by).agg(*(cols or [F.count(F.lit(1)).alias("__cf_n")]))
    if selected:
        table = _with_quantiles(table, df, by, metrics, [0.5], lambda m, s: f"{m}_median", few)
    rounded = (lambda c: round_half_up(c, digits)) if digits is not None else F.col
    return table.select(*by, *[rounded(f"{m}_{a}").alias(f"{m}_{a}") for m in metrics for a in aggs])


def label_counts(obs: DataFrame, col: str = "label_masked") -> DataFrame:
    """A3. Numbers of labelled and unlabelled rows."""
    unknown = F.col(col).isNull() | (F.col(col) == UNKNOWN)
    return obs.agg(F.count_if(~unknown).alias("n_labeled"), F.count_if(unknown).alias("n_unlabeled"))


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a class column (a short list by nature)."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """A4. (rows, cols, n) for every row value x column value, zero-filled.
    A null column value is not a column; a null row value is a row."""
    pairs = df.select(F.col(rows).alias("_r"), F.col(cols).alias("_c"))
    n = pairs.groupBy("_r", "_c").agg(F.count(F.lit(1)).alias("n"))
    every = pairs.where(F.col("_c").isNotNull()).select(F.sort_array(F.collect_set("_c"))).scalar()
    grid = pairs.select("_r").distinct().select(F.col("_r").alias("_row"), F.explode(every).alias("_col"))
    full = grid.join(n, F.col("_row").eqNullSafe(F.col("_r")) & (F.col("_col") == F.col("_c")), "left")
    return full.select(F.col("_row").alias(rows), F.col("_col").alias(cols), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def crosstab_prop(ct: DataFrame, rows: str, cols: str, digits: int = 3) -> DataFrame:
    """A5. Share of each row value within its column (each column sums to 1).
    The cross-tab is small (rows x cols values), the window is per column."""
    total = F.sum("n").over(Window.partitionBy(cols))
    return ct.select(rows, cols, "n", round_half_up(safe_div(F.col("n"), total), digits).alias("prop"))


def absent_labels(ct: DataFrame, rows: str) -> DataFrame:
    """A6. Row values with a zero count in at least one column."""
    return ct.groupBy(rows).agg(F.bool_or(F.col("n") == 0).alias("_absent")).where("_absent").select(rows)


QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def distribution(df: DataFrame, metric: str | Sequence[str], by: str | Sequence[str] | None = None,
                 digits: int = 6, approx: bool = False, few: int = quantiles.FEW) -> DataFrame:
    """A7/A8. Quantile summary (the data of a violin/box plot) of one or
    more metrics, optionally per group: (by..., metric, n, mean, q0..q100).
    Exact by default; ``approx`` uses the bounded percentile sketch."""
    metrics = [metric] if isinstance(metric, str) else list(metric)
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_m"))
    long = long.select(*by, "_m.metric", "_m.v")
    if not approx:
        long = cut_lineage(long)
    name = lambda q: f"q{int(q * 100)}"
    sketched = [_quantile(F.col("v"), q).alias(name(q)) for q in QUANTILES] if approx else []
    table = long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *sketched)
    if not approx:
        keyed = long.withColumnRenamed("metric", "__cf_metric")
        table = _with_quantiles(table.withColumnRenamed("metric", "__cf_metric"), keyed, [*by, "__cf_metric"], ["v"], QUANTILES, lambda m, s: name(s), few)
        table = table.withColumnRenamed("__cf_metric", "metric")
    return table.select(*by, "metric", "n", *[round_half_up(c, digits).alias(c) for c in ("mean", *map(name, QUANTILES))])


def histogram(df: DataFrame, metric: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """A7. Equal-width histogram counts between the (group) min and max.
    The range is an aggregate (one row per group) brought back by a join,
    so a group holding a third of all rows is never one window partition."""
    keys = [by] if by else []
    if keys:
        rng = df.groupBy(*keys).agg(F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
        df = df.join(rng, keys)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        r = df.select(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi"))).scalar()
        lo, hi = r["lo"], r["hi"]
    width = safe_div(F.col(metric) - lo, hi - lo)
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor(width * bins), F.lit(0))).cast("int")
    return df.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A9. (value, n)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def distinct_labels(df: DataFrame, col: str, n: int = 3) -> DataFrame:
    """A10. First n distinct values in sort order (the limit is the feature)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(n)
