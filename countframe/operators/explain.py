"""Per-feature attributions (X1-X3): integrated gradients of a class logit
with a zero baseline, mean attribution per feature, top features per class.

The model weights are small (bounded by layers x features) and shipped to
the tasks once; each Arrow batch of rows runs a numpy forward/backward pass
for all interpolation steps.  For the linear soft-max model the integral is
exact in closed form: attr_i = x_i * W[c, i].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.operators.embed import _matrices
from countframe.operators.features import list_of
from countframe.session import ship_library

STEPS = 50


def mlp_layers(model: MultilayerPerceptronClassificationModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """(W, b) per layer, W of shape (in, out), from MLlib's flat weights
    (per layer: the out x in matrix stored column-major, i.e. the in x out
    matrix row by row, then the bias)."""
    w = model.weights.toArray()
    sizes = list(model.getLayers())
    out, pos = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        W = w[pos:pos + n_in * n_out].reshape(n_in, n_out)
        pos += n_in * n_out
        b = w[pos:pos + n_out]
        pos += n_out
        out.append((W, b))
    return out


def mlp_logits(layers, X: np.ndarray) -> np.ndarray:
    """Output-layer pre-softmax values; sigmoid hidden layers."""
    h = X
    for i, (W, b) in enumerate(layers):
        z = h @ W + b
        h = z if i == len(layers) - 1 else 1.0 / (1.0 + np.exp(-z))
    return h


def _mlp_path_grad(layers, X: np.ndarray, target: np.ndarray, steps: int) -> np.ndarray:
    """Mean of d logit[target] / dX at the midpoints of ``steps`` pieces of the
    way from 0 to X, for every row.  The first layer is linear in X and in the
    gradient behind it: its two products are made once, not once a step."""
    (W0, b0), rest = layers[0], layers[1:]
    first = X @ W0
    behind, spare = np.zeros_like(first), [np.empty((len(X), len(b))) for _, b in layers]
    for s in range(steps):
        z = np.multiply(first, (s + 0.5) / steps, out=spare[0])
        z += b0
        acts = [_sigmoid(z) if rest else z]
        for i, (W, b) in enumerate(rest):
            z = np.matmul(acts[-1], W, out=spare[i + 1])
            z += b
            acts.append(z if i == len(rest) - 1 else _sigmoid(z))
        g = np.zeros_like(acts[-1])
        g[np.arange(len(X)), target] = 1.0
        for i in range(len(rest) - 1, -1, -1):
            g = g @ rest[i][0].T
            g *= acts[i]
            g *= np.subtract(1.0, acts[i], out=acts[i])
        behind += g
    return (behind / steps) @ W0.T


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(z, out=z), out=z)
    z += 1.0
    return np.divide(1.0, z, out=z)


def integrated_gradients(model, df: DataFrame, target: str = "target", vec: str = "vec",
                         key: str = "cell_id", steps: int = STEPS) -> DataFrame:
    """X1. (cell_id, target, attr ARRAY<DOUBLE>, gap) where ``gap`` is the
    completeness error sum(attr) - (f(x) - f(0)) of the target logit.
    Midpoint rule with ``steps`` points for the network; exact for the
    linear model."""
    spark = df.sparkSession
    ship_library(spark)
    if isinstance(model, LogisticRegressionModel):
        kind, params = "linear", (model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    elif isinstance(model, MultilayerPerceptronClassificationModel):
        kind, params = "mlp", mlp_layers(model)
    else:
        raise TypeError(f"unsupported model {type(model).__name__}")
    bc = spark.sparkContext.broadcast((kind, params))
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vec).alias("vec"), F.col(target).cast("int").alias(target))

    def fn(batches):
        kind_, p = bc.value
        for X, some in _matrices(batches, "vec"):
            t = some.column(target).to_numpy().astype(np.int64)
            if kind_ == "linear":
                W, b = p
                attr = X * W[t]
                fx = np.einsum("ij,ij->i", X, W[t]) + b[t]
                f0 = b[t]
            else:
                attr = X * _mlp_path_grad(p, X, t, steps)
                fx = mlp_logits(p, X)[np.arange(len(X)), t]
                f0 = mlp_logits(p, np.zeros((1, X.shape[1])))[0, t]
            gap = attr.sum(axis=1) - (fx - f0)
            yield pa.RecordBatch.from_arrays([some.column(key), some.column(target), list_of(attr), pa.array(gap)], [key, target, "attr", "gap"])

    return rows.mapInArrow(fn, f"{key} long, {target} int, attr array<double>, gap double")


def mean_attribution(attrs: DataFrame, by: list[str] | None = None, attr: str = "attr") -> DataFrame:
    """A11. Mean attribution per feature index (optionally per group)."""
    by = by or []
    ex = attrs.select(*by, F.posexplode(attr).alias("gene_idx", "a"))
    return ex.groupBy(*by, "gene_idx").agg(F.avg("a").alias("mean_attr"))


def top_features(means: DataFrame, n: int = 10, by: list[str] | None = None, value: str = "mean_attr",
                 name: str = "gene_id", digits: int = 9) -> DataFrame:
    """X2. Top n features by |mean attribution| (sign kept), highest first;
    ties by name.  Per group when ``by`` is given (a per-group top-n that
    Spark limits before the shuffle)."""
    by = by or []
    order = [F.abs(F.floor(F.col(value) * float(10 ** digits) + 0.5)).desc(), F.col(name)]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
