"""Supervised models on dense feature vectors (M1-M6), all MLlib.

The reference trains a 512-256-128 network with dropout, batch norm and
AdamW on a GPU.  Here the same layer sizes run as MLlib's
multilayer perceptron (sigmoid hidden units, L-BFGS, no dropout or
batch norm): gradients and scores come from Arrow tasks, in matrix products; the
fitted model is MLlib's.  Scaled counts differ from a usual row (that of a cell
without counts) in few features: only these are kept and multiplied.  It is trained in short warm-started chunks so that validation
log-loss can stop training early and keep the best weights (M3).  Numbers
therefore differ from the reference's; the operator contract is the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from countframe.operators.embed import _matrices as matrices
from countframe.operators.embed import _matrix as matrix
from countframe.operators.evaluate import weighted_f1
from countframe.operators.features import list_of
from countframe.session import cut_lineage, ship_library, shuffles_removed

SEED = 42
BAND = 1 << 16            # weights of a band of gradients
LARGEST = 1 << 21         # numbers of the largest layer of a piece
CROWDED = 32              # a piece with more than one entry in so many is multiplied densely
USUAL_ROWS = 63           # of which the usual row is the median


def encode_labels(df: DataFrame, label: str = "label", out: str = "label_idx"):
    """M1. Alphabetical label encoding; returns (model, encoded frame)."""
    model = StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    enc = model.transform(df).withColumn(out, F.col(out).cast("int"))
    return model, enc


def decode_labels(df: DataFrame, labels: list[str], col: str = "pred_idx", out: str = "pred") -> DataFrame:
    """M1. Integer class -> label name."""
    return IndexToString(inputCol=col, outputCol=out, labels=labels).transform(
        df.withColumn(col, F.col(col).cast("double")))


def _vec(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec)))


def _training(df: DataFrame, label_idx: str) -> DataFrame:
    """MLlib's training input in a few partitions a slot: a fit runs hundreds
    of jobs, and the driver keeps a record of every task of them."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return _vec(df).select("features", F.col(label_idx).cast("double").alias("label")).coalesce(max(1, 2 * slots))


@dataclass
class FitResult:
    model: object
    labels: list[str]
    history: list[dict] = field(default_factory=list)


def log_loss(model, df: DataFrame, label_idx: str = "label_idx") -> float:
    """Mean negative log-likelihood of the true class (validation loss)."""
    pr = vector_to_array(F.col("probability"))
    p_true = F.element_at(pr, F.col(label_idx) + 1)
    out = model.transform(_vec(df)).agg(F.avg(-F.log(F.greatest(p_true, F.lit(1e-15)))).alias("l")).first()
    return float(out["l"])


def f1_of(model, df: DataFrame, label_idx: str = "label_idx") -> float:
    """Weighted F1 of a fitted classifier on (vec, label_idx) rows."""
    scored = model.transform(_vec(df)).select(F.col(label_idx).alias("truth"), F.col("prediction").cast("int").alias("pred"))
    return float(weighted_f1(scored).first()[0])


def fit_mlp(train: DataFrame, labels: list[str], hidden=(512, 256, 128), val: DataFrame | None = None,
            steps_per_chunk: int = 10, max_chunks: int = 5, patience: int = 2, seed: int = SEED,
            label_idx: str = "label_idx") -> FitResult:
    """M2 + M3 + M4.  ``train``/``val``: (cell_id, vec, label_idx).

    Fits ``steps_per_chunk`` L-BFGS iterations at a time from the previous
    weights (at first MLlib's initial ones), on gradients that Arrow tasks add
    up (``Network``); the result is MLlib's model with the best weights; after each chunk records training objective,
    validation loss and both weighted F1s, keeps the best state by validation
    loss and stops after ``patience`` chunks without improvement."""
    n_in = len(train.select("vec").first()["vec"])
    net = Network(train, [n_in, *hidden, len(labels)], label_idx)
    val = None if val is None else net.thin(val)
    best, best_loss, wait, history = None, float("inf"), 0, []
    weights = net.initial_weights(seed)
    for chunk in range(max_chunks):
        weights, objective = minimise(net.loss, weights, steps_per_chunk)
        rec = {"step": (chunk + 1) * steps_per_chunk, "train_loss": objective}
        if val is not None:
            rec["val_loss"], rec["val_f1"] = net.judge(weights, val)
            _, rec["train_f1"] = net.judge(weights, net.rows)
        history.append(rec)
        if val is None:
            best = weights
            continue
        if rec["val_loss"] < best_loss - 1e-9:
            best, best_loss, wait = weights, rec["val_loss"], 0
        else:
            wait += 1
            if wait >= patience:
                break
    return FitResult(net.model(best), labels, history)


class Network:
    """Loss, gradient and scores of a sigmoid network with a soft-max output,
    over the rows of a DataFrame (vec, label): Arrow tasks take pieces
    through matrix products, sums of gradients are added in bands by a second
    stage.  Weights are laid out as MLlib's.

    Rows are kept as (label, idx, diff): where and by how much they differ from
    the usual row, whose part of the first layer is computed once a task."""

    def __init__(self, rows: DataFrame, sizes: list[int], label_idx: str):
        self.spark, self.sizes, self.label_idx = rows.sparkSession, sizes, label_idx
        ship_library(self.spark)
        self.slots = max(1, self.spark.sparkContext.defaultParallelism)
        some = matrix(rows.select("vec").limit(USUAL_ROWS).toArrow()["vec"].combine_chunks())
        usual = np.sort(some, axis=0)[len(some) // 2]
        self.usual = np.where(np.isfinite(usual), usual, 0.0)
        self.rows = self.thin(rows)                                  # read in every evaluation
        self.last = None

    def thin(self, rows: DataFrame) -> DataFrame:
        """(label, idx, diff) of (vec, label) rows, written, a file a slot."""
        usual, label, most = self.usual, self.label_idx, LARGEST // max(self.sizes)

        def fn(batches):
            for x, some in matrices(batches, "vec", most):
                other = x != usual
                row, col = np.nonzero(other)
                at = pa.array(np.r_[0, np.cumsum(other.sum(axis=1))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([some.column(label), pa.ListArray.from_arrays(at, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(x[row, col] - usual[col]))],
                                                 [label, "idx", "diff"])

        schema = StructType([rows.schema[label], StructField("idx", ArrayType(IntegerType())), StructField("diff", ArrayType(DoubleType()))])
        return cut_lineage(rows.select("vec", label).mapInArrow(fn, schema).repartition(self.slots))

    def _spread(self, rows: DataFrame) -> DataFrame:
        """A sum a slot, or a few, whatever the number of splits."""
        return rows if rows.rdd.getNumPartitions() <= 4 * self.slots else rows.coalesce(2 * self.slots)

    def _mllib(self, weights=None, seed: int = SEED, steps: int = 0):
        """MLlib's classifier with these weights (or its own initial ones):
        no step is made on its one row."""
        clf = MultilayerPerceptronClassifier(layers=self.sizes, maxIter=steps, seed=seed)
        if weights is not None:
            clf = clf.setInitialWeights(Vectors.dense(weights))
        one = self.spark.createDataFrame([(Vectors.dense([0.0] * self.sizes[0]), 0.0)], ["features", "label"])
        return clf.fit(one)

    def initial_weights(self, seed: int) -> np.ndarray:
        return self._mllib(seed=seed).weights.toArray()

    def model(self, weights: np.ndarray):
        return self._mllib(weights)

    def loss(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean cross-entropy, its gradient); kept for the weights asked for last."""
        if self.last is not None and np.array_equal(self.last[0], weights):
            return self.last[1]
        shared, sizes, usual, label = self.spark.sparkContext.broadcast(weights), self.sizes, self.usual, self.label_idx

        def fn(batches):
            layers = unpack(shared.value, sizes)
            total, n, loss = np.zeros(len(shared.value)), 0, 0.0
            sums = unpack(total, sizes)
            for entries, first, y in pieces(batches, layers[0], usual, label, LARGEST // max(sizes)):
                acts = forward(layers, None, first)
                p = acts[-1]
                n, loss = n + len(y), loss - np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
                delta = p.copy()
                delta[np.arange(len(y)), y] -= 1.0
                for i in range(len(layers) - 1, 0, -1):
                    sums[i][0][...] += acts[i].T @ delta
                    sums[i][1][...] += delta.sum(axis=0)
                    delta = delta @ layers[i][0].T
                    delta *= acts[i]
                    delta *= np.subtract(1.0, acts[i], out=acts[i])
                row, col, diff = entries
                order = np.argsort(col, kind="stable")
                add_product(sums[0][0], col[order], row[order], diff[order], delta)
                sums[0][1][...] += delta.sum(axis=0)
            if n:
                sums[0][0][...] += usual[:, None] * sums[0][1]
                total = np.r_[total, loss, n]
                for at in range(0, len(total), BAND):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), list_of(total[at:at + BAND][None])], ["at", "s"])

        def together(key, bands):
            total = sum(matrix(b).sum(axis=0) for b in bands["s"].chunks)
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), list_of(total[None])], names=["at", "s"])

        with shuffles_removed(self.spark):
            got = (self._spread(self.rows).mapInArrow(fn, "at int, s array<double>").groupBy("at").applyInArrow(together, "at int, s array<double>")
                   .toArrow().sort_by("at"))
        out = got["s"].combine_chunks().flatten().to_numpy()
        shared.destroy()
        self.last = np.array(weights), (float(out[-2] / out[-1]), out[:-2] / out[-1])
        return self.last[1]

    def judge(self, weights: np.ndarray, df: DataFrame) -> tuple[float, float]:
        """(mean negative log-likelihood, weighted F1) on (vec, label) rows, or
        on rows that are thin already."""
        shared, sizes, usual, label = self.spark.sparkContext.broadcast(weights), self.sizes, self.usual, self.label_idx

        def fn(batches):
            layers = unpack(shared.value, sizes)
            for _, first, y in pieces(batches, layers[0], usual, label, LARGEST // max(sizes)):
                p = forward(layers, None, first)[-1]
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15))
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(loss)], ["truth", "pred", "loss"])

        rows = df if "idx" in df.columns else self.thin(df)
        scored = cut_lineage(rows.mapInArrow(fn, "truth int, pred int, loss double"))
        return float(scored.agg(F.avg("loss")).first()[0]), float(weighted_f1(scored).first()[0])


def unpack(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(W in x out, b) of every layer, as views."""
    out, at = [], 0
    for n_in, n_out in zip(sizes[:-1], sizes[1:]):
        end = at + n_in * n_out
        out.append((weights[at:end].reshape(n_in, n_out), weights[end:end + n_out]))
        at = end + n_out
    return out


def add_product(out: np.ndarray, row, col, value, M: np.ndarray) -> None:
    """out += S @ M, S sparse (row in order, col, value): crowded ones densely,
    others by their entries, LARGEST numbers at a time."""
    if len(row) * CROWDED > len(out) * len(M):
        S = np.zeros((len(out), len(M)))
        S[row, col] = value
        out += S @ M
        return
    step = max(1, LARGEST // M.shape[1])
    for at in range(0, len(row), step):
        own = row[at:at + step]
        part = M[col[at:at + step]]
        part *= value[at:at + step, None]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[start]] += np.add.reduceat(part, start, axis=0)


def pieces(batches, layer, usual: np.ndarray, label: str, most: int):
    """(row, col, diff) of the entries of at most ``most`` thin rows, the first
    layer's sums of these rows, and their labels."""
    W, b = layer
    always = usual @ W + b
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            idx = some.column("idx")
            row = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
            col, diff = (c.flatten().to_numpy(zero_copy_only=False) for c in (idx, some.column("diff")))
            first = np.empty((len(idx), len(b)))
            first[:] = always
            add_product(first, row, col, diff, W)
            yield (row, col, diff), first, some.column(label).to_numpy().astype(np.int64)


def forward(layers, x: np.ndarray | None, first: np.ndarray | None = None) -> list[np.ndarray]:
    """Activations of every layer, the input first, chances last.  ``first``:
    the first layer's sums, if they are there (they are overwritten)."""
    acts = [x]
    for i, (W, b) in enumerate(layers):
        z = first if i == 0 and first is not None else acts[-1] @ W + b
        if i < len(layers) - 1:
            with np.errstate(over="ignore"):
                np.exp(np.negative(z, out=z), out=z)
            z += 1.0
            acts.append(np.divide(1.0, z, out=z))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            acts.append(e / e.sum(axis=1, keepdims=True))
    return acts


def minimise(loss, w: np.ndarray, steps: int, memory: int = 10, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, value) after up to ``steps`` L-BFGS steps, each with a line
    search for the strong Wolfe conditions.  ``loss``: weights -> (value,
    gradient)."""
    value, grad = loss(w)
    past = []
    for step in range(steps):
        direction, coefs = -grad, []
        for s, y in reversed(past):
            c = (s @ direction) / (s @ y)
            coefs.append(c)
            direction = direction - c * y
        if past:
            s, y = past[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), c in zip(past, reversed(coefs)):
            direction = direction + s * (c - (y @ direction) / (s @ y))
        slope = grad @ direction
        if not slope < 0:
            direction, past = -grad, []
            slope = grad @ direction
        if slope == 0:
            break
        low, high, rate = 0.0, np.inf, 1.0 if past else 1.0 / max(np.linalg.norm(grad), 1e-12)
        kept = None
        for _ in range(20):
            at_value, at_grad = loss(w + rate * direction)
            if not at_value <= value + 1e-4 * rate * slope:
                high = rate
            else:
                kept = (rate, at_value, at_grad)
                if at_grad @ direction < 0.9 * slope:
                    low = rate
                elif at_grad @ direction > -0.9 * slope:
                    high = rate
                else:
                    break
            rate = (low + high) / 2 if np.isfinite(high) else 2 * rate
        if kept is None:
            break
        rate, at_value, at_grad = kept
        s, y = rate * direction, at_grad - grad
        if s @ y > 1e-12 * (y @ y):
            past = (past + [(s, y)])[-memory:]
        done = abs(value - at_value) <= tol * max(abs(value), abs(at_value), 1e-12)
        w, value, grad = w + s, at_value, at_grad
        if done:
            break
    return w, float(value)


def fit_softmax(train: DataFrame, labels: list[str], max_iter: int = 100, reg: float = 1e-3,
                label_idx: str = "label_idx") -> FitResult:
    """M6. Multinomial logistic regression (linear soft-max)."""
    model = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg).fit(_training(train, label_idx))
    hist = [{"step": i + 1, "train_loss": float(v)} for i, v in enumerate(model.summary.objectiveHistory)]
    return FitResult(model, labels, hist)


def scored(model, df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with the likeliest class (pred_idx) and the chances of all (_p):
    MLlib's scores, of a network by matrix products in Arrow tasks."""
    if not isinstance(model, MultilayerPerceptronClassificationModel):
        return model.transform(_vec(df, vec)).select(*df.columns, F.col("prediction").cast("int").alias("pred_idx"), vector_to_array(F.col("probability")).alias("_p"))
    ship_library(df.sparkSession)
    sizes, kept = list(model.getLayers()), df.columns
    shared = df.sparkSession.sparkContext.broadcast(model.weights.toArray())

    def fn(batches):
        layers = unpack(shared.value, sizes)
        for x, some in matrices(batches, vec, LARGEST // max(sizes)):
            p = forward(layers, x)[-1]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(p.argmax(axis=1).astype(np.int32)), list_of(p)], [*kept, "pred_idx", "_p"])

    return df.mapInArrow(fn, StructType([*df.schema, StructField("pred_idx", IntegerType()), StructField("_p", ArrayType(DoubleType()))]))


def predict(fit: FitResult, df: DataFrame, key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """M5. (hard predictions, long probabilities).  Hard: (cell_id, pred,
    confidence); long: (cell_id, label, p) for every class."""
    return predicted(scored(fit.model, df.select(key, "vec")), fit.labels, key)


def predicted(scored: DataFrame, labels: list[str], key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """What ``predict`` returns, of rows that are scored already."""
    names = F.lit(labels)
    hard = scored.select(key, F.element_at(names, F.col("pred_idx") + 1).alias("pred"),
                         F.array_max("_p").alias("confidence"))
    long = scored.select(key, F.posexplode("_p").alias("_i", "p")).select(
        key, F.element_at(names, F.col("_i") + 1).alias("label"), "p")
    return hard, long


def history_frame(spark, fit: FitResult) -> DataFrame:
    """M4. Training history as a DataFrame (one row per recorded step)."""
    rows = [(h["step"], h.get("train_loss"), h.get("train_f1"), h.get("val_loss"), h.get("val_f1")) for h in fit.history]
    return spark.createDataFrame(rows, "step int, train_loss double, train_f1 double, val_loss double, val_f1 double")
