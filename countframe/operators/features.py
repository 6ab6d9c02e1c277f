"""Feature axis operators: column defaults, gene subsets, gene-set joins,
alignment to a training feature list, and sparse -> dense vectors
(P3, P6-P9, J1-J5).

The feature list that becomes a vector axis is bounded by the caller (a
top-n selection or a given gene list), so it may be broadcast; anything
whose size grows with the data is left to the optimizer and AQE.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from countframe.frame import CountFrame
from countframe.session import ship_library

# Dense feature axes are selected gene lists; PCA decomposes a g x g matrix on
# the driver and MLP/soft-max weights scale with g, so wider axes are refused.
MAX_FEATURES = 20_000
PIECE = 1 << 20          # numbers of a dense piece: cells x axis


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """P3. Add a constant column only when it is missing."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default))


def index_genes(genes: DataFrame, order_col: str = "gene_id") -> DataFrame:
    """(gene_id, gene_idx) numbered from 0 in ``order_col`` order.  Used on a
    selected, bounded feature list only."""
    w = Window.orderBy(order_col, "gene_id") if order_col != "gene_id" else Window.orderBy("gene_id")
    return genes.select("gene_id", *([order_col] if order_col != "gene_id" else [])) \
        .withColumn("gene_idx", (F.row_number().over(w) - 1).cast("int")).select("gene_id", "gene_idx")


def freeze_axis(axis: DataFrame) -> DataFrame:
    """Materialise a bounded feature axis (gene_id, gene_idx) once.

    The axis is a selected gene list whose size is fixed by a parameter (a
    top-n selection, a gene-set intersection); it is collected with a size
    check and re-created as a local relation, so later actions (vector
    width, statistics, broadcasts) do not recompute the selection."""
    rows = axis.select("gene_id", "gene_idx").limit(MAX_FEATURES + 1).collect()
    if len(rows) > MAX_FEATURES:
        raise ValueError(f"feature axis exceeds {MAX_FEATURES} genes")
    return axis.sparkSession.createDataFrame([(r[0], int(r[1])) for r in rows], "gene_id string, gene_idx int")


def select_features(cf: CountFrame, flag: str = "highly_variable") -> CountFrame:
    """P6. Keep entries of genes whose ``var`` flag is true."""
    chosen = cf.var.where(F.col(flag)).select("gene_id")
    return CountFrame(cf.x.join(F.broadcast(chosen), "gene_id", "left_semi"), cf.obs,
                      cf.var.where(F.col(flag)), cf.latent)


def select_genes(x: DataFrame, genes: DataFrame) -> DataFrame:
    """P7. Keep entries of an explicit gene list (semi join; the list is a
    bounded feature list, broadcast)."""
    return x.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi")


def common_genes(var_a: DataFrame, var_b: DataFrame) -> DataFrame:
    """J1. Genes present in both sets, with the left side's columns."""
    return var_a.join(var_b.select("gene_id").distinct(), "gene_id", "inner")


def genes_present(train: DataFrame, query_genes: DataFrame) -> DataFrame:
    """J2. Training genes (with their training order) found in the query data."""
    return train.join(query_genes.select("gene_id"), "gene_id", "left_semi")


def genes_missing(train: DataFrame, query_genes: DataFrame) -> DataFrame:
    """J3. Training genes absent from the query data."""
    return train.join(query_genes.select("gene_id"), "gene_id", "left_anti")


def cell_entries(x: DataFrame, genes: DataFrame, cells: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(cell_id, entries MAP<gene_idx, value>): the entries on a bounded axis
    by cell (at most g of them).  With ``cells`` every listed cell has a row;
    one without entries has none (NULL)."""
    g = genes.select("gene_id", "gene_idx")
    entries = x.join(F.broadcast(g), "gene_id").groupBy("cell_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("gene_idx").cast("int").alias("gene_idx"), F.col(value).cast("double").alias("v")))).alias("entries"))
    return entries if cells is None else cells.select("cell_id").join(entries, "cell_id", "left")


def scatter(entries, g: int, fill) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, indices, values, dense rows of ``fill``) of an Arrow array of
    entry maps; NULL maps have no entries, NULL values are left out."""
    at = entries.offsets.to_numpy()
    idx = entries.keys.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    items = entries.items
    known = items.is_valid().to_numpy(zero_copy_only=False)[at[0]:at[-1]] & (idx >= 0) & (idx < g)
    row = np.repeat(np.arange(len(entries)), np.diff(at))
    v = items.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
    out = np.empty((len(entries), g))
    out[:] = fill
    return row[known], idx[known], v[known], out


def list_of(dense: np.ndarray) -> pa.Array:
    """Dense rows as an Arrow list array."""
    n, g = dense.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * g), pa.array(dense.ravel()))


def dense_vectors(rows: DataFrame, g: int, scaling: tuple | None = None, fill: Column | None = None) -> DataFrame:
    """``rows`` with ``vec`` (g doubles) in place of ``entries``; other columns
    are kept.  ``scaling`` = (means, stds, max_value or None) gives
    clip((v - mean) / std), absent entries included.  Each task scatters the
    entries of at most PIECE numbers at a time."""
    ship_library(rows.sparkSession)
    kept = [c for c in rows.columns if c != "entries"]
    schema = StructType([rows.schema[c] for c in kept] + [StructField("vec", ArrayType(DoubleType(), False))])
    most = max(1, PIECE // max(g, 1))
    filled = fill is not None                    # a column cannot go to the tasks
    mu, sd, top = (np.array(scaling[0], float), np.array(scaling[1], float), scaling[2]) if scaling else (None, None, None)

    def scaled(v, m, s):
        z = (v - m) / s
        return z if top is None else np.fmax(np.fmin(z, top), -top)

    def fn(batches):
        zero = 0.0 if mu is None else scaled(np.zeros(g), mu, sd)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                some = batch.slice(start, most)
                base = some.column("_fill").to_numpy(zero_copy_only=False)[:, None] if filled else zero
                row, idx, v, out = scatter(some.column("entries"), g, base)
                out[row, idx] = v if mu is None else scaled(v, mu[idx], sd[idx])
                yield pa.RecordBatch.from_arrays([some.column(c) for c in kept] + [list_of(out)], kept + ["vec"])

    if fill is not None:
        rows = rows.withColumn("_fill", fill.cast("double"))
    return rows.mapInArrow(fn, schema)


def to_vectors(x: DataFrame, genes: DataFrame, cells: DataFrame | None = None,
               value: str = "value", fill: Column | None = None) -> DataFrame:
    """P9 + J4. Dense per-cell arrays on a fixed feature axis.

    ``genes`` is (gene_id, gene_idx) with idx 0..g-1 (a bounded feature
    list, broadcast).  Entries are grouped per cell (a cell holds at most g
    entries, so groups are bounded) into a map and scattered into arrays;
    genes the cell lacks become 0 (the implicit zero), or ``fill``.
    With ``cells`` every listed cell gets a vector, also cells without any
    entry on the axis.  Result: (cell_id, vec ARRAY<DOUBLE>).
    """
    return dense_vectors(cell_entries(x, genes, cells, value), axis_size(genes), fill=fill)


def axis_size(genes: DataFrame) -> int:
    """Length of a feature axis (an action on a bounded gene list)."""
    n = genes.count()
    if n > MAX_FEATURES:
        raise ValueError(f"feature axis of {n} genes exceeds {MAX_FEATURES}")
    return n


def align_features(x_query: DataFrame, genes: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """J4. Query matrix on the training feature axis, missing genes = 0,
    in long form (cell_id, gene_id, value) for every cell x training gene.
    Produced per cell from its own vector (no cross join)."""
    vecs = to_vectors(x_query, genes, cells, value)
    g = F.broadcast(genes.select("gene_id", "gene_idx"))
    long = vecs.select("cell_id", F.posexplode("vec").alias("gene_idx", "value"))
    return long.join(g, "gene_idx").select("cell_id", "gene_id", "value")
