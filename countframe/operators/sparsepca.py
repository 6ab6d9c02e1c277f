"""PCA of long triples (D1) without dense rows or a covariance matrix.

Scaled values are z = clip((v - mean) / std); an absent entry has z0 =
clip(-mean / std).  So the centred matrix is D - 1 c', with the sparse D =
z - z0 on stored entries and c its column means: centring and scaling are
never written out, and its covariance works on a block of g-vectors as
Q -> (D' (D Q) - n c (c' Q)) / (n - 1).

``principal`` finds the leading eigenvectors by block Lanczos (a randomised
range finder that keeps every block): each step is one pass over the sparse
rows, in which a task multiplies small dense pieces of at most
``PIECE`` numbers and returns a g x block sum; steps end when the residuals of
the wanted pairs are below ``tol``, at the latest when the blocks span the
whole axis.

What reaches the driver is g x (block * steps) numbers, where g is the size
of the selected axis (checked against MAX_AXIS); never g x g, and never a row
per cell.  Rows are grouped by cell once and written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.operators.embed import PcaResult, _fix_signs
from countframe.operators.features import scatter
from countframe.operators.normalize import entry_scaling
from countframe.session import cut_lineage, ship_library

MAX_AXIS = 100_000
PIECE = 1 << 21          # numbers of a dense piece: cells x axis
EXTRA = 10               # columns of a block beyond the wanted ones
SEED = 42


class SparseRows:
    """D by cell, with what its implicit parts need."""

    def __init__(self, rows: DataFrame, axis_size: int, n: int, centre: np.ndarray, total_variance: float, base: np.ndarray,
                 scaling: tuple | None = None):
        self.rows, self.g, self.n, self.centre, self.total_variance, self.base = rows, axis_size, n, centre, total_variance, base
        self.scaling = scaling

    @classmethod
    def of(cls, x: DataFrame, axis: DataFrame, cells: DataFrame, stats: DataFrame, max_value: float = 10.0) -> "SparseRows":
        """``x`` (cell_id, gene_id, value), ``axis`` (gene_id, gene_idx from
        0), ``cells`` (cell_id), ``stats`` (gene_id, mean, std)."""
        g = axis.count()
        if g > MAX_AXIS:
            raise ValueError(f"an axis of {g} features; at most {MAX_AXIS} are worked on")
        sd = F.when(F.col("std").isNull() | (F.col("std") == 0.0), F.lit(1.0)).otherwise(F.col("std"))
        clip = lambda c: F.greatest(F.least(c, F.lit(max_value)), F.lit(-max_value))
        # a gene without statistics is absent everywhere
        scaled = axis.join(stats.select("gene_id", "mean", sd.alias("sd")), "gene_id", "left").select(
            "gene_id", F.col("gene_idx").cast("int").alias("idx"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(1.0)).alias("sd"))
        scaled = scaled.withColumn("z0", clip(-F.col("mean") / F.col("sd")))
        entry = x.join(F.broadcast(scaled), "gene_id").select(          # bounded by MAX_AXIS
            "cell_id", "idx", (clip((F.col("value") - F.col("mean")) / F.col("sd")) - F.col("z0")).alias("d"))
        rows = cut_lineage(entry.groupBy("cell_id").agg(F.collect_list(F.struct("idx", "d")).alias("e"))
                           .select("cell_id", F.col("e.idx").alias("idx"), F.col("e.d").alias("d")))
        z0 = scaled.select("idx", "z0").toArrow()
        base = np.zeros(g)
        base[z0["idx"].to_numpy()] = z0["z0"].to_numpy()
        return cls._summed(rows, g, cells.count(), base)

    @classmethod
    def of_entries(cls, rows: DataFrame, g: int, n: int, scaling: tuple) -> "SparseRows":
        """``rows`` (cell_id, entries MAP<gene_idx, value>), written; ``n`` cells,
        ``scaling`` = (means, stds, max_value) by index.  Nothing is shuffled by
        cell nor written again: values are scaled in every pass."""
        mu, sd, top = np.asarray(scaling[0], float), np.asarray(scaling[1], float), scaling[2]
        base = np.clip(-mu / sd, -top, top)
        return cls._summed(rows.select("cell_id", "entries"), g, n, base, (mu, sd, top))

    @classmethod
    def _summed(cls, rows, g, n, base, scaling=None):
        if scaling is None:
            entry = rows.select(F.explode(F.arrays_zip("idx", "d")).alias("e")).select(F.col("e.idx").alias("idx"), F.col("e.d").alias("d"))
        else:
            mu, sd, top = scaling
            at = lambda x: F.get(F.lit(x.tolist()), F.col("idx"))
            z = F.greatest(F.least((F.col("v") - at(mu)) / at(sd), F.lit(top)), F.lit(-top))
            entry = rows.select(F.explode("entries").alias("idx", "v")).select("idx", (z - at(base)).alias("d"))
        sums = (entry.groupBy("idx").agg(F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q")).toArrow())
        s, q = np.zeros(g), np.zeros(g)
        s[sums["idx"].to_numpy()], q[sums["idx"].to_numpy()] = sums["s"].to_numpy(), sums["q"].to_numpy()
        centre = s / max(n, 1)
        return cls(rows, g, n, centre, float((q - n * centre ** 2).sum() / max(n - 1, 1)), base, scaling)

    def covariance_times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of columns: one pass."""
        g, width = block.shape
        spark = self.rows.sparkSession
        shared = spark.sparkContext.broadcast((block, self.scaling, self.base))

        def multiply(batches):
            out = np.zeros((g, width))
            q, scaling, base = shared.value
            for piece, _ in _pieces(batches, g, scaling, base):
                out += piece.T @ (piece @ q)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel()[at])], ["at", "s"])

        # two sums a slot at most, whatever the number of splits
        few = self.rows.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))
        sums = few.mapInArrow(multiply, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(g * width)
        out[sums["at"].to_numpy()] = sums["s"].to_numpy()
        shared.unpersist()
        return (out.reshape(g, width) - self.n * np.outer(self.centre, self.centre @ block)) / max(self.n - 1, 1)

    def scores(self, cells: DataFrame, components: np.ndarray) -> DataFrame:
        """(cell_id, vec) of all cells; those without entries included."""
        spark = cells.sparkSession
        k, g = components.shape[1], self.g
        away = self.centre @ components
        shared = spark.sparkContext.broadcast((components, away, self.scaling, self.base))

        def project(batches):
            w, off, scaling, base = shared.value
            for piece, ids in _pieces(batches, g, scaling, base):
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"cell_id": ids, "vec": list(piece @ w - off)}),
                                                 pa.schema([("cell_id", pa.int64()), ("vec", pa.list_(pa.float64()))]), preserve_index=False)

        found = self.rows.withColumn("cell_id", F.col("cell_id").cast("long")).mapInArrow(project, "cell_id long, vec array<double>")
        none = F.array(*[F.lit(float(-away[i])) for i in range(k)])
        return cells.select("cell_id").join(found, "cell_id", "left").select("cell_id", F.coalesce("vec", none).alias("vec"))


def _pieces(batches, g: int, scaling=None, base=None):
    """(dense rows, ids) of Arrow batches, at most PIECE numbers at a time;
    ``scaling``, ``base``: of rows that hold raw entries."""
    most = max(1, PIECE // max(g, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            if scaling is not None:
                mu, sd, top = scaling
                row, idx, v, piece = scatter(some.column("entries"), g, 0.0)
                piece[row, idx] = np.clip((v - mu[idx]) / sd[idx], -top, top) - base[idx]
                yield piece, some.column("cell_id").to_numpy(zero_copy_only=False)
                continue
            idx, d = some.column("idx"), some.column("d")
            size = np.diff(idx.offsets.to_numpy())
            piece = np.zeros((some.num_rows, g))
            piece[np.repeat(np.arange(some.num_rows), size), idx.flatten().to_numpy()] = d.flatten().to_numpy()
            yield piece, some.column("cell_id").to_numpy()


def principal(times, g: int, k: int, tol: float = 1e-8, max_steps: int = 200) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors, passes) of the k largest pairs of a
    symmetric map ``times`` on blocks of g-vectors."""
    width = min(g, k + EXTRA)
    block = np.linalg.qr(np.random.default_rng(SEED).normal(size=(g, width)))[0]
    basis, image = np.zeros((g, 0)), np.zeros((g, 0))
    for step in range(1, max_steps + 1):
        basis, image = np.hstack([basis, block]), np.hstack([image, times(block)])
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        found = basis @ vector
        wrong = np.linalg.norm(image @ vector - found * value, axis=0)
        room = g - basis.shape[1]
        if room == 0 or wrong.max(initial=0) <= tol * max(value.max(initial=0), 1e-300):
            break
        block = image[:, -block.shape[1]:]
        for _ in range(2):                                   # twice is enough
            block = block - basis @ (basis.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        left = left[:, size > 1e-12 * max(size.max(initial=0), 1e-300)][:, :room]
        if not left.shape[1]:
            break
        left = left - basis @ (basis.T @ left)
        block = np.linalg.qr(left)[0]
    return value, found, step


def pca_sparse(x: DataFrame, axis: DataFrame, cells: DataFrame, stats: DataFrame, k: int = 50, max_value: float = 10.0) -> PcaResult:
    """D1 on long triples: the same components as ``embed.pca`` of the scaled
    dense vectors, up to ``principal``'s tolerance.  ``mean`` is that of the
    scaled values."""
    ship_library(x.sparkSession)
    return _principal(SparseRows.of(x, axis, cells, stats, max_value), cells, k)


def pca_sparse_entries(rows: DataFrame, g: int, cells: DataFrame, k: int = 50) -> PcaResult:
    """D1 on entries by cell (``features.cell_entries``, written): statistics
    over all ``cells``, then as ``pca_sparse``."""
    ship_library(rows.sparkSession)
    n = cells.count()
    return _principal(SparseRows.of_entries(rows, g, n, entry_scaling(rows, g, n=n)), cells, k)


def _principal(sparse: SparseRows, cells: DataFrame, k: int) -> PcaResult:
    value, vector, _ = principal(sparse.covariance_times, sparse.g, min(k, sparse.g))
    components, _ = _fix_signs(vector)
    share = value / sparse.total_variance if sparse.total_variance > 0 else np.zeros_like(value)
    return PcaResult(sparse.scores(cells, components), components, sparse.base + sparse.centre, share)


def subspace_angle(a: np.ndarray, b: np.ndarray) -> float:
    """Largest principal angle between the spans of orthonormal columns."""
    return float(np.arcsin(min(1.0, np.linalg.norm(b - a @ (a.T @ b), 2))))
