"""Sources and sinks (S1-S5): Parquet triples in, Parquet/CSV tables out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.session import cut_lineage

X_REQUIRED = {"cell_id", "gene_id"}


def _check_x(x: DataFrame) -> DataFrame:
    missing = X_REQUIRED - set(x.columns)
    if missing:
        raise ValueError(f"count table lacks columns {sorted(missing)}")
    if "n" not in x.columns and "value" not in x.columns:
        raise ValueError("count table needs a count column 'n' or a 'value' column")
    return x


def normalize_obs_columns(obs: DataFrame) -> DataFrame:
    """Spark resolves names case-insensitively: a row table holding both
    ``Batch`` and ``batch`` is ambiguous, so the capitalised one is renamed
    ``batch_src`` on ingestion."""
    cols = obs.columns
    if "Batch" in cols and "batch" in cols:
        renamed = [F.col(f"`{c}`").alias("batch_src") if c == "Batch" else F.col(f"`{c}`") for c in cols]
        return obs.select(*renamed)
    return obs


def _read_case_safe(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet row table; when two column names differ only in case
    (``Batch`` / ``batch``), rewrite it once with ``Batch`` renamed
    ``batch_src`` into the shared checkpoint folder and read that copy."""
    prev = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        cols = spark.read.parquet(path).columns
        lowered = [c.lower() for c in cols]
        if len(set(lowered)) == len(lowered):
            return spark.read.parquet(path)
        from countframe.session import ensure_checkpoint_dir

        target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/obs-{uuid.uuid4().hex}"
        df = spark.read.parquet(path)
        renamed = [F.col(f"`{c}`").alias("batch_src") if c == "Batch" else F.col(f"`{c}`") for c in cols]
        df.select(*renamed).write.parquet(target)
    finally:
        spark.conf.set("spark.sql.caseSensitive", prev)
    return spark.read.parquet(target)


def read_counts(spark: SparkSession, x, obs, var=None) -> CountFrame:
    """S1. Load a matrix dataset from parquet paths (or ready DataFrames)."""
    def load(src):
        return src if isinstance(src, DataFrame) else spark.read.parquet(src)

    x_df = _check_x(load(x))
    obs_df = normalize_obs_columns(obs if isinstance(obs, DataFrame) else _read_case_safe(spark, obs))
    if "cell_id" not in obs_df.columns:
        raise ValueError("row table lacks 'cell_id'")
    var_df = load(var) if var is not None else None
    return CountFrame(x=x_df, obs=obs_df, var=var_df)


def describe(cf: CountFrame) -> DataFrame:
    """S2. One-row shape summary: cells, genes, stored entries, total count.

    Three aggregations over the same scan; each is a partial + final
    aggregate (no shuffle of the entries themselves)."""
    vc = cf.value_col
    xs = cf.x.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.countDistinct("gene_id").alias("n_genes"),
        F.sum(vc).alias("total_count"),
    )
    n_cells = cf.obs.select(F.count(F.lit(1))).scalar()
    return xs.select(n_cells.alias("n_cells"), "n_genes", "n_entries", "total_count")


def write_latent(latent: DataFrame, path: str, space: str = "default") -> None:
    """S4. Persist an embedding, partitioned by its space name."""
    (latent.withColumn("space", F.lit(space))
     .write.mode("overwrite").partitionBy("space").parquet(path))


def read_latent(spark: SparkSession, path: str, space: str = "default") -> DataFrame:
    """S4. Reload one embedding space (partition pruning on ``space``)."""
    return spark.read.parquet(path).where(F.col("space") == space).drop("space")


def fit_or_load(path: str, fit_fn: Callable[[], object], load_fn: Callable[[str], object]):
    """S3. Reload a saved model if ``path`` exists, else fit and save it.

    ``fit_fn`` returns an MLlib model (anything with ``.write()``)."""
    if _exists(path):
        return load_fn(path)
    model = fit_fn()
    model.write().overwrite().save(path)
    return model


def _exists(path: str) -> bool:
    """Looked up where models are saved: on the path's Hadoop file system, or
    the default one for a path without scheme."""
    spark = SparkSession.getActiveSession()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


REPORT_ROWS = 1_000_000


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> list[str]:
    """S5. Write the table behind each figure.  Report tables are small
    aggregates, written as a single file each; one that turns out larger gets
    a file per ``REPORT_ROWS`` rows, so no task holds a large table."""
    written = []
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df = cut_lineage(df)                     # counted and written from one run
        writer = df.coalesce(max(1, -(-df.count() // REPORT_ROWS))).write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", "true").csv(path)
        else:
            writer.parquet(path)
        written.append(path)
    return written
