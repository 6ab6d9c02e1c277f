"""Seeded sampling, masking and splitting.

All randomness is ``md5('<seed>:<key>')`` ordering, ties by key, so a result
is a pure function of the data and the seed, identical in plain SQL.

Exact-k selection never funnels the data through one task: rows are first
counted per hash bucket (first 4 hex digits, 65 536 buckets per stratum);
whole buckets below the cut are taken by a narrow filter, and only the rows
of the single cut bucket of each stratum are ranked in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN
from countframe.functions.hashing import hash16, md5_key

SEED = 42
_HELPERS = ["_hx", "_hb", "_cut_b", "_rem", "_r", "_s0"]


def _hash_cols(df: DataFrame, key: str, seed) -> DataFrame:
    hx = md5_key(F.col(key), seed)
    return df.withColumn("_hx", hx).withColumn("_hb", F.conv(F.substring("_hx", 1, 4), 16, 10).cast("int"))


def exact_k_flag(df: DataFrame, key: str, seed, k_of_n: Callable[[Column], Column],
                 strata: Sequence[str] = (), flag: str = "selected") -> DataFrame:
    """Add boolean ``flag``: the row is among the first ``k_of_n(n)`` rows of
    its stratum in (md5, key) order, where n is the stratum size."""
    strata = list(strata)
    h = _hash_cols(df, key, seed)
    groups = strata if strata else ["_s0"]
    counts_src = h if strata else h.withColumn("_s0", F.lit(0))
    counts = counts_src.groupBy(*groups, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    # at most 65 536 rows per stratum: bounded window partitions
    cum_w = Window.partitionBy(*groups).orderBy("_hb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (counts.withColumn("_cum", F.sum("_c").over(cum_w))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(*groups)))
              .withColumn("_k", k_of_n(F.col("_n")).cast("bigint")))
    # one row per stratum with k >= 1: the bucket where the running count
    # crosses k, and how many of its rows are still needed
    cut = (counts.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
           .select(*groups, F.col("_hb").alias("_cut_b"),
                   (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_rem")))
    if strata:
        # one row per stratum; AQE broadcasts it after measuring it
        j = h.join(cut, strata, "left")
    else:
        # a single stratum: the cut is one (bucket, remainder) pair, read as a
        # single scalar subquery (no join, one pass over the counts)
        c = cut.select(F.first(F.struct("_cut_b", "_rem")).alias("c")).scalar()
        j = h.withColumn("_cut_b", c["_cut_b"]).withColumn("_rem", c["_rem"])
    outside = (j.where(F.col("_cut_b").isNull() | (F.col("_hb") != F.col("_cut_b")))
               .withColumn(flag, F.coalesce(F.col("_hb") < F.col("_cut_b"), F.lit(False))))
    rank_w = Window.partitionBy(*strata, "_hb").orderBy("_hx", key)
    inside = (j.where(F.col("_hb") == F.col("_cut_b"))
              .withColumn("_r", F.row_number().over(rank_w))
              .withColumn(flag, F.col("_r") <= F.col("_rem")))
    out = outside.unionByName(inside, allowMissingColumns=True)
    return out.drop(*[c for c in _HELPERS if c in out.columns])


def cap_rows(obs: DataFrame, n: int, seed=SEED, key: str = "cell_id") -> DataFrame:
    """R1. Exactly min(n, rows) rows without replacement (all if not larger)."""
    flagged = exact_k_flag(obs, key, seed, lambda total: F.least(total, F.lit(n)), flag="_keep")
    return flagged.where("_keep").drop("_keep")


def cap_counts(x: DataFrame, kept_obs: DataFrame, key: str = "cell_id") -> DataFrame:
    """R1 on the matrix: keep entries of the kept rows (semi join)."""
    return x.join(kept_obs.select(key), key, "left_semi")


def mask_labels(obs: DataFrame, frac: float = 0.30, seed=SEED, label: str = "label",
                key: str = "cell_id") -> DataFrame:
    """R2 + P1. Copy ``label`` to ``label_truth`` and hide exactly
    floor(frac * n) labels: ``label_masked`` = 'Unknown' for those rows."""
    flagged = exact_k_flag(obs, key, seed, lambda total: F.floor(F.lit(float(frac)) * total), flag="masked")
    # Labels of any type become strings, so that 'Unknown' is one of them
    return (flagged.withColumn("label_truth", F.col(label).cast("string"))
            .withColumn("label_masked", F.when(F.col("masked"), F.lit(UNKNOWN)).otherwise(F.col(label).cast("string"))))


def labeled(obs: DataFrame, col: str = "label_masked") -> DataFrame:
    """P5. Rows with a known label (NULL counts as unknown)."""
    return obs.where(F.col(col).isNotNull() & (F.col(col) != UNKNOWN))


def unlabeled(obs: DataFrame, col: str = "label_masked") -> DataFrame:
    """P5. The complement of ``labeled``."""
    return obs.where(F.col(col).isNull() | (F.col(col) == UNKNOWN))


def stratified_split(df: DataFrame, label: str = "label", frac: float = 0.20, seed=SEED,
                     key: str = "cell_id") -> DataFrame:
    """R3. Per label, exactly floor(frac * n_label + 0.5) rows go to
    validation (``is_val``); a class of size 1 stays in training."""
    return exact_k_flag(df, key, seed, lambda total: F.floor(F.lit(float(frac)) * total + 0.5),
                        strata=[label], flag="is_val")


def random_split(df: DataFrame, frac: float = 0.10, seed=SEED, key: str = "cell_id") -> DataFrame:
    """R4. Row-local hash threshold: ``is_val`` for ~frac of the rows."""
    return df.withColumn("is_val", hash16(F.col(key), seed) < F.lit(int(frac * 65536)))


def sample_per_label(df: DataFrame, n: int = 100, label: str = "label", seed=SEED,
                     key: str = "cell_id") -> DataFrame:
    """R5. At most n rows per label, chosen by seeded hash order: the counted
    cut of ``exact_k_flag``, so neither a hot label nor a large n meets in one
    window."""
    flagged = exact_k_flag(df, key, seed, lambda total: F.least(total, F.lit(n)), strata=[label], flag="_keep")
    return flagged.where("_keep").drop("_keep")


def limit_per_label(df: DataFrame, n: int = 50, label: str = "label", key: str = "cell_id") -> DataFrame:
    """R6. The first n rows of each label by key.  ``row_number <= n`` keeps n
    rows per label and map task before the shuffle; Spark does so up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) rows, so a larger
    n first ranks within 1024 hash groups of the key."""
    top = lambda d, *by: d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_r") <= n).drop("_r")
    if n > 1000:
        df = top(df.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(1024))), label, "_g").drop("_g")
    return top(df, label)
