"""Embeddings (D1-D6): PCA, projection of new rows, the linear autoencoder
and the batch-aware count-model latent.

PCA: the g x g covariance is added up from products of dense pieces inside
Arrow tasks (MLlib's tree aggregate for wide axes) and only this matrix
(bounded, g = selected features) is decomposed on the driver.  Scores are those
of centred rows; component signs are fixed so that each component's largest
absolute loading is positive.

The count-model latent (D5) re-aims the reference's negative-binomial VAE
as analytic Pearson residuals of a per-batch NB model,
``mu = cell_total * gene_total_batch / total_batch``,
``r = (v - mu) / sqrt(mu + mu^2 / theta)`` clipped to +-sqrt(n_cells),
followed by PCA.  The linear autoencoder (D4) is PCA with k = 64: the
minimum-MSE linear code spans the principal subspace.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from countframe.frame import CountFrame
from countframe.operators.features import PIECE, axis_size, list_of, scatter
from countframe.session import cut_lineage, ship_library

THETA = 100.0
MAX_GRAM = 4096          # features of a g x g product inside a task (128 MB)
POOLED = "__all__"


@dataclass
class PcaResult:
    latent: DataFrame              # (cell_id, vec ARRAY<DOUBLE>)
    components: np.ndarray         # g x k, orthonormal columns, sign-fixed
    mean: np.ndarray               # g
    explained_ratio: np.ndarray    # k

    def loadings(self, spark: SparkSession, genes: DataFrame | None = None) -> DataFrame:
        """(gene_idx[, gene_id], pc, w); a g x k table, bounded by the axis."""
        g, k = self.components.shape
        pdf = pd.DataFrame({"gene_idx": np.repeat(np.arange(g, dtype=np.int32), k),
                            "pc": np.tile(np.arange(k, dtype=np.int32), g),
                            "w": self.components.reshape(-1)})
        df = spark.createDataFrame(pdf)
        if genes is not None:
            df = df.join(F.broadcast(genes.select("gene_id", "gene_idx")), "gene_idx")
        return df


def _fix_signs(pc: np.ndarray) -> np.ndarray:
    idx = np.argmax(np.abs(pc), axis=0)
    signs = np.sign(pc[idx, np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    return pc * signs, signs


def _matrix(column) -> np.ndarray:
    """Dense rows of an Arrow column of equally long lists."""
    size = np.diff(column.offsets.to_numpy())
    if column.null_count or size.min(initial=size[0] if len(size) else 0) != size.max(initial=0):
        raise ValueError("vectors are missing or of different lengths")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _matrices(batches, vec: str, most: int | None = None):
    """(dense rows, their Arrow slice), at most PIECE numbers (or ``most``
    rows) at a time."""
    for batch in batches:
        if batch.num_rows:
            g = max(1, len(batch.column(vec)[0] or []))
            rows = max(1, PIECE // g if most is None else most)
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                yield _matrix(some.column(vec)), some


def mean_covariance(vecs: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance) of dense vectors, in two passes: sums, then
    products of centred rows, g x g numbers a task.  Tasks return them in bands
    of rows, which a second stage adds; the sum (g x g) reaches the driver."""
    spark = vecs.sparkSession
    ship_library(spark)
    slots = spark.sparkContext.defaultParallelism
    rows = vecs.select(F.col(vec).alias("vec"))

    def add(batches):
        n, total = 0, 0.0
        for x, _ in _matrices(batches, "vec"):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), list_of(total[None])], ["n", "s"])

    sums = rows.mapInArrow(add, "n long, s array<double>").toArrow()
    n = int(sums["n"].to_numpy().sum()) if len(sums) else 0
    if n < 2:
        raise ValueError(f"a covariance of {n} rows")
    mean = _matrix(sums["s"].combine_chunks()).sum(axis=0) / n
    g = len(mean)
    shared = spark.sparkContext.broadcast(mean)
    band = max(1, (1 << 17) // g)              # 1 MB

    def multiply(batches):
        gram = np.zeros((g, g))
        for x, _ in _matrices(batches, "vec"):
            x = x - shared.value
            gram += x.T @ x
        for at in range(0, g, band):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), list_of(gram[at:at + band].reshape(1, -1))], ["at", "s"])

    def together(key, bands):
        total = 0.0
        for b in bands["s"].chunks:
            total = total + _matrix(b).sum(axis=0)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), list_of(total[None])], names=["at", "s"])

    parts = rows.coalesce(max(1, 2 * slots)).mapInArrow(multiply, "at int, s array<double>")       # two products a slot at most
    bands = parts.groupBy("at").applyInArrow(together, "at int, s array<double>").toArrow().sort_by("at")
    gram = bands["s"].combine_chunks().flatten().to_numpy().reshape(g, g)
    return mean, gram / (n - 1)


def pca(vecs: DataFrame, k: int = 50, vec: str = "vec", key: str = "cell_id", moments: tuple | None = None) -> PcaResult:
    """D1. Principal components of dense vectors (cell_id, vec).  Axes of up to
    MAX_GRAM features take their covariance from Arrow tasks, wider ones from
    MLlib.  ``moments``: the ``mean_covariance`` of these rows, if it is there."""
    g = len(vecs.select(vec).first()[0])
    if k > g:
        raise ValueError(f"{k} components of {g} features")
    if g <= MAX_GRAM:
        mean, cov = mean_covariance(vecs, vec) if moments is None else moments
        value, vector = np.linalg.eigh(cov)
        value, raw_pc = np.maximum(value[::-1], 0), vector[:, ::-1][:, :k]
        share = value[:k] / value.sum() if value.sum() > 0 else np.zeros(k)
    else:
        v = vecs.select(key, array_to_vector(F.col(vec)).alias("_v"))
        model = PCA(k=k, inputCol="_v", outputCol="_raw").fit(v)
        raw_pc, share = model.pc.toArray(), model.explainedVariance.toArray()
        mean = np.asarray(v.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray())
    pc, _ = _fix_signs(raw_pc)
    return PcaResult(_project(vecs, pc, mean, vec, key), pc, mean, share)


def project_vectors(vecs: DataFrame, components: np.ndarray, mean: np.ndarray | None = None,
                    vec: str = "vec", key: str = "cell_id") -> DataFrame:
    """D2 (vector form). (x - mean) @ PC per Arrow batch; the g x k matrix is
    shipped to the tasks once.  Row-local, so it also runs on a stream."""
    return _project(vecs.withColumn(key, F.col(key).cast("long")), components, mean, vec, key)


def _project(vecs: DataFrame, components: np.ndarray, mean: np.ndarray | None, vec: str, key: str) -> DataFrame:
    spark = vecs.sparkSession
    ship_library(spark)
    bc = spark.sparkContext.broadcast((np.asarray(components, dtype=np.float64),
                                       None if mean is None else np.asarray(mean, dtype=np.float64)))
    rows = vecs.select(key, F.col(vec).alias("vec"))

    def fn(batches):
        pcm, mu = bc.value
        for x, some in _matrices(batches, "vec"):
            z = (x if mu is None else x - mu) @ pcm
            yield pa.RecordBatch.from_arrays([some.column(key), list_of(z)], [key, "vec"])

    return rows.mapInArrow(fn, StructType([rows.schema[key], StructField("vec", ArrayType(DoubleType()))]))


def project(x: DataFrame, loadings: DataFrame, cells: DataFrame, n_pcs: int, stats: DataFrame | None = None,
            max_value: float | None = 10.0, value: str = "value") -> DataFrame:
    """D2 (long form). Scores (cell_id, pc, score) = sum_g z_g w_g.

    Without ``stats`` z is the stored value (implicit zeros add nothing).
    With ``stats`` z = clip((v - mean)/std), and sparsity is kept exactly:
    every gene contributes its implicit-zero value z0 = clip(-mean/std)
    through a per-component offset, and stored entries add (z - z0).
    ``loadings`` (gene_id, pc, w) is bounded by the feature axis."""
    L = F.broadcast(loadings.select("gene_id", "pc", "w"))
    if stats is None:
        contrib = x.join(L, "gene_id").groupBy("cell_id", "pc").agg(F.sum(F.col(value) * F.col("w")).alias("_s"))
        offset = None
    else:
        sd = F.when(F.col("std").isNull() | (F.col("std") == 0.0), F.lit(1.0)).otherwise(F.col("std"))

        def clip(c):
            return F.greatest(F.least(c, F.lit(max_value)), F.lit(-max_value)) if max_value is not None else c

        # statistics of the loadings' genes only: bounded by the axis
        st = stats.join(loadings.select("gene_id").distinct(), "gene_id", "left_semi") \
            .select("gene_id", F.col("mean").alias("_mu"), sd.alias("_sd"))
        st = st.withColumn("_z0", clip(-F.col("_mu") / F.col("_sd")))
        xs = x.join(F.broadcast(st), "gene_id").select(
            "cell_id", "gene_id", (clip((F.col(value) - F.col("_mu")) / F.col("_sd")) - F.col("_z0")).alias("_d"))
        contrib = xs.join(L, "gene_id").groupBy("cell_id", "pc").agg(F.sum(F.col("_d") * F.col("w")).alias("_s"))
        offset = loadings.join(st, "gene_id", "left").groupBy("pc").agg(
            F.sum(F.coalesce(F.col("_z0"), F.lit(0.0)) * F.col("w")).alias("_o"))
    grid = cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(n_pcs - 1))).alias("pc"))
    out = grid.join(contrib, ["cell_id", "pc"], "left")
    score = F.coalesce(F.col("_s"), F.lit(0.0))
    if offset is not None:
        out = out.join(F.broadcast(offset), "pc", "left")
        score = score + F.coalesce(F.col("_o"), F.lit(0.0))
    return out.select("cell_id", F.col("pc").cast("int").alias("pc"), score.alias("score"))


def latent_head(latent: DataFrame, n: int = 30, vec: str = "vec") -> DataFrame:
    """D3. First n components only."""
    return latent.withColumn(vec, F.slice(vec, 1, n))


def linear_autoencoder(vecs: DataFrame, k: int = 64, vec: str = "vec", key: str = "cell_id", moments: tuple | None = None):
    """D4. k-dim linear code + per-row reconstruction MSE.
    With orthonormal components the residual is ||x - mean||^2 - ||z||^2,
    so the MSE needs no reconstruction pass."""
    res = pca(vecs, k, vec, key, moments)
    bc = vecs.sparkSession.sparkContext.broadcast((res.components, res.mean))
    rows = vecs.select(key, F.col(vec).alias("vec"))

    def fn(batches):
        pcm, mu = bc.value
        for x, some in _matrices(batches, "vec"):
            x = x - mu
            z = x @ pcm
            yield pa.RecordBatch.from_arrays([some.column(key), pa.array((x * x).sum(axis=1)), pa.array((z * z).sum(axis=1))], [key, "_c", "_z"])

    # two numbers a row are joined by key, not the vectors
    size = cut_lineage(rows.mapInArrow(fn, StructType([rows.schema[key], StructField("_c", DoubleType()), StructField("_z", DoubleType())])))
    j = size.select(key, "_c").join(size.select(key, "_z"), key)
    return res, j.select(key, (F.greatest(F.col("_c") - F.col("_z"), F.lit(0.0)) / len(res.mean)).alias("mse"))


def nb_residual_vectors(cf: CountFrame, genes: DataFrame, batch: str = "batch",
                        theta: float = THETA, batch_totals: DataFrame | None = None,
                        n_train: int | None = None) -> DataFrame:
    """D5. Dense NB Pearson residual vectors (cell_id, vec) on the axis,
    clipped at the square root of the number of *training* cells: frozen
    totals need their ``n_train``, so that a row's vector never depends on
    the rows it is scored with.

    ``batch_totals`` (batch, gene_idx, g_total) and the batch sums may come
    from a frozen training set (query mapping); a batch unseen in training
    falls back to the totals over all training batches."""
    n = axis_size(genes)
    vc = cf.value_col
    # one pass per cell over *all* its entries: the library size and the
    # entries on the (broadcast, bounded) axis, gathered together
    g = F.broadcast(genes.select("gene_id", "gene_idx"))
    per_cell = cf.x.join(g, "gene_id", "left").groupBy("cell_id").agg(
        F.sum(vc).cast("double").alias("_ctot"),
        F.map_from_entries(F.collect_list(
            F.when(F.col("gene_idx").isNotNull(), F.struct(F.col("gene_idx").cast("int").alias("gene_idx"), F.col(vc).cast("double").alias("v"))))).alias("entries"))
    if batch_totals is None:
        n_train = cf.obs.count()
        batch_totals = nb_batch_totals(cf, genes, batch)
    # batch x axis arrays: bounded by (#batches + 1) x g
    gvec = _batch_arrays(batch_totals, n)
    # the pooled row as one scalar subquery (an axis-length array and a total)
    pooled = gvec.where(F.col("_b") == F.lit(POOLED)).select(F.first(F.struct("_g", "_btot"))).scalar()
    if batch in cf.obs.columns:
        cells = cf.obs.select("cell_id", F.col(batch).alias("_b")).join(per_cell, "cell_id", "left")
        # a batch unseen in the totals falls back to the pooled row
        # (#batches + 1) rows: AQE broadcasts them once measured
        cells = (cells.join(gvec, "_b", "left")
                 .withColumn("_g", F.coalesce("_g", pooled["_g"]))
                 .withColumn("_btot", F.coalesce("_btot", pooled["_btot"])))
    else:
        # rows without a batch (a second dataset, batch "test") are an
        # unseen batch: pooled totals for every row, no join needed
        cells = cf.obs.select("cell_id").join(per_cell, "cell_id", "left") \
            .withColumn("_g", pooled["_g"]).withColumn("_btot", pooled["_btot"])
    cells = cells.withColumn("_ctot", F.coalesce("_ctot", F.lit(0.0)))
    if n_train is None:
        raise ValueError("frozen totals need the number of their cells (n_train)")
    clipv = float(np.sqrt(n_train))
    ship_library(cf.x.sparkSession)
    cells = cells.select("cell_id", "entries", "_ctot", "_g", F.col("_btot").cast("double").alias("_btot"))
    most = max(1, PIECE // max(n, 1))

    def fn(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                some = whole.slice(at, most)
                row, idx, v, out = scatter(some.column("entries"), n, 0.0)
                out[row, idx] = v
                total, of = (some.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("_ctot", "_btot"))
                with np.errstate(all="ignore"):
                    mu = total * _matrix(some.column("_g")) / of
                    res = np.fmax(np.fmin((out - mu) / np.sqrt(mu + mu * mu / theta), clipv), -clipv)
                yield pa.RecordBatch.from_arrays([some.column("cell_id"), list_of(np.where(mu > 0, res, 0.0))], ["cell_id", "vec"])

    return cells.mapInArrow(fn, StructType([cells.schema["cell_id"], StructField("vec", ArrayType(DoubleType()))]))


def nb_batch_totals(cf: CountFrame, genes: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, gene_idx, g_total, T_total) per batch, plus the pooled
    '__all__' batch: batch x axis, bounded."""
    vc = cf.value_col
    xb = cf.x.join(cf.obs.select("cell_id", F.col(batch).alias("batch")), "cell_id")
    by = cut_lineage(xb.groupBy("batch", "gene_id").agg(F.sum(vc).alias("_s")))      # one pass over the entries
    T = by.groupBy("batch").agg(F.sum("_s").cast("double").alias("T_total"))
    g = by.join(F.broadcast(genes.select("gene_id", "gene_idx")), "gene_id") \
        .groupBy("batch", "gene_idx").agg(F.sum("_s").cast("double").alias("g_total"))
    per = g.join(T, "batch")
    pooled = per.groupBy("gene_idx").agg(F.sum("g_total").alias("g_total")) \
        .withColumn("batch", F.lit(POOLED)) \
        .withColumn("T_total", T.select(F.sum("T_total")).scalar())
    return per.unionByName(pooled)


def _batch_arrays(bt: DataFrame, n: int) -> DataFrame:
    grouped = bt.groupBy(F.col("batch").alias("_b")).agg(
        F.map_from_entries(F.collect_list(F.struct("gene_idx", "g_total"))).alias("_m"),
        F.first("T_total").alias("_btot"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                      lambda i: F.coalesce(F.element_at(F.col("_m"), i.cast("int")), F.lit(0.0)))
    return grouped.select("_b", vec.alias("_g"), "_btot")


def nb_latent(cf: CountFrame, genes: DataFrame, k: int = 20, batch: str = "batch", theta: float = THETA):
    """D5. PCA of the residual vectors: the batch-aware count latent."""
    return pca(nb_residual_vectors(cf, genes, batch, theta), k)
