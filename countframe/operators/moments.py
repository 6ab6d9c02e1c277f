"""Mergeable model state: counts, sums and Gram moments of a feature set.

``moments`` is one pass over the triples; the state is a long table (kind, i,
j, value) of at most g (g + 3) / 2 + 1 rows for g features, written and read
like any table.  States of parts of a dataset, or of a second one with the
same axis, are added (``merge``) instead of scanning the parts again; means,
standard deviations, covariances and principal components follow from the
state alone.

Absent entries are zeros: they enter through the number of cells only.  A
task multiplies dense pieces of its rows (at most PIECE numbers at a time)
and returns its upper triangle.  Components are taken on the driver from g x g
correlations; g is checked against MAX_AXIS.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.operators.embed import _fix_signs
from countframe.operators.sparsepca import _pieces
from countframe.session import ship_library

MAX_AXIS = 4096
_STATE = "kind string, i int, j int, value double"


def moments(x: DataFrame, axis: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """The state of ``x`` (cell_id, gene_id, value) on ``axis`` (gene_id,
    gene_idx from 0) over all ``cells``."""
    spark = x.sparkSession
    ship_library(spark)
    g = axis.count()
    if g > MAX_AXIS:
        raise ValueError(f"an axis of {g} features; at most {MAX_AXIS} for Gram moments")
    entry = x.join(F.broadcast(axis.select("gene_id", F.col("gene_idx").cast("int").alias("idx"))), "gene_id")       # bounded by MAX_AXIS
    rows = entry.groupBy("cell_id").agg(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("d"))).alias("e")).select(
        F.col("cell_id").cast("long").alias("cell_id"), F.col("e.idx").alias("idx"), F.col("e.d").alias("d"))

    def add(batches):
        total, gram = np.zeros(g), np.zeros((g, g))
        for piece, _ in _pieces(batches, g):
            total += piece.sum(axis=0)
            gram += piece.T @ piece
        i = np.flatnonzero(total)
        yield _batch("sum", i, np.zeros(len(i)), total[i])
        i, j = np.nonzero(np.triu(gram))
        yield _batch("gram", i, j, gram[i, j])

    n = cells.agg(F.lit("n").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.count(F.lit(1)).cast("double").alias("value"))
    return merge(rows.mapInArrow(add, _STATE), n)


def _batch(kind, i, j, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(i), pa.string()), pa.array(np.asarray(i, np.int32)), pa.array(np.asarray(j, np.int32)),
                                       pa.array(np.asarray(value, float))], ["kind", "i", "j", "value"])


def merge(*states: DataFrame) -> DataFrame:
    """The state of the parts together."""
    return reduce(DataFrame.unionByName, states).groupBy("kind", "i", "j").agg(F.sum("value").alias("value"))


def covariance(state: DataFrame) -> DataFrame:
    """(i, j, cov) for i <= j: sample covariances; pairs that never occur
    together are left out unless both features occur."""
    n = state.where("kind = 'n'").select(F.sum("value")).scalar()
    one = state.where("kind = 'sum'").select("i", F.col("value").alias("s"))
    a, b = one.toDF("i", "a"), one.toDF("j", "b")
    # every pair of features that occur: the axis is bounded
    every = F.sort_array(F.collect_list("i"))
    grid = a.select("i", "a", F.explode(one.select(every).scalar()).alias("j")).where("i <= j").join(b, "j")
    gram = state.where("kind = 'gram'").select("i", "j", F.col("value").alias("g"))
    return grid.join(gram, ["i", "j"], "left").select("i", "j", ((F.coalesce("g", F.lit(0.0)) - F.col("a") * F.col("b") / n) / (n - 1)).alias("cov"))


def space(state: DataFrame, axis: DataFrame, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(statistics, loadings, explained shares) of a state: (gene_id, mean,
    std) and (gene_id, pc, w), as ``embed.project`` takes them (without a clip,
    which no state of second moments can know)."""
    spark = state.sparkSession
    g = axis.count()
    got = state.toPandas()                                     # bounded by MAX_AXIS
    n = got.value[got.kind == "n"].sum()
    total, gram = np.zeros(g), np.zeros((g, g))
    s, q = got[got.kind == "sum"], got[got.kind == "gram"]
    total[s.i], gram[q.i, q.j] = s.value, q.value
    gram = np.triu(gram) + np.triu(gram, 1).T
    cov = (gram - np.outer(total, total) / n) / (n - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 0, sd, 1)
    value, vector = np.linalg.eigh(cov / np.outer(scale, scale))
    k = min(k, g)
    value, (vector, _) = value[::-1], _fix_signs(vector[:, ::-1][:, :k])
    names = axis.select("gene_id", "gene_idx").toPandas().sort_values("gene_idx").gene_id.to_numpy()
    stats = spark.createDataFrame(pd.DataFrame({"gene_id": names, "mean": total / n, "std": sd}))
    loadings = spark.createDataFrame(pd.DataFrame({"gene_id": np.repeat(names, k), "pc": np.tile(np.arange(k, dtype=np.int32), g), "w": vector.ravel()}))
    return stats, loadings, value[:k] / value.sum()
