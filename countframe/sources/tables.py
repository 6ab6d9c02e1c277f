"""Access to the parquet test tables (one parquet per table under a folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` on a unique (or bounded-group) ``key`` when its
    scan yields fewer partitions than there are task slots.

    Small parquet files come as a handful of splits, which would leave most
    cores idle for the heavy per-row work that follows; large inputs have
    many splits already and are left untouched (no extra shuffle)."""
    try:
        par = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access keep the scan as is
        return df
    return df.repartition(par, key) if n < par else df
