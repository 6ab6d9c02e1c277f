"""A network on rows that differ from the usual one in few features."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from countframe.operators import models

SIZES = [30, 9, 6, 3]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    usual = rng.normal(size=SIZES[0])
    X = np.tile(usual, (400, 1))
    X[rng.random(X.shape) < 0.03] = 2.5                    # few entries
    X[7] = rng.normal(size=SIZES[0])                       # one crowded row
    y = rng.integers(0, 3, len(X))
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(X, y))], "cell_id long, vec array<double>, label_idx int")
    return X, y, df


def test_rows_are_kept_by_what_is_unusual_and_sums_are_those_of_dense_rows(rows):
    X, y, df = rows
    net = models.Network(df, SIZES, "label_idx")
    assert net.rows.columns == ["label_idx", "idx", "diff"] and net.rows.count() == len(X)
    assert net.rows.select(F.sum(F.size("idx"))).first()[0] < 0.05 * X.size
    w = net.initial_weights(1)
    value, grad = net.loss(w)
    layers = models.unpack(w, SIZES)
    acts = models.forward(layers, X)
    assert abs(value + np.log(acts[-1][np.arange(len(X)), y]).mean()) < 1e-12
    delta, want = acts[-1].copy(), []
    delta[np.arange(len(X)), y] -= 1
    for i in range(len(layers) - 1, -1, -1):
        want.insert(0, np.r_[(acts[i].T @ delta).ravel(), delta.sum(axis=0)])
        delta = (delta @ layers[i][0].T) * acts[i] * (1 - acts[i])
    assert np.allclose(grad, np.concatenate(want) / len(X), atol=1e-13)
    assert np.allclose(net.judge(w, df), net.judge(w, net.rows), atol=1e-13)
    assert net.loss(w) is net.loss(w.copy())               # asked again: no pass


@pytest.mark.parametrize("share", [0.0, 0.004, 0.6])
def test_products_by_entries_are_dense_products(monkeypatch, share):
    monkeypatch.setattr(models, "LARGEST", 64)             # rows cut by the steps
    rng = np.random.default_rng(3)
    S = np.where(rng.random((50, 300)) < share, rng.normal(size=(50, 300)), 0.0)
    M, out = rng.normal(size=(300, 7)), rng.normal(size=(50, 7))
    want = out + S @ M
    row, col = np.nonzero(S)
    models.add_product(out, row, col, S[row, col], M)
    assert np.allclose(out, want, atol=1e-12)


def test_scores_are_mllibs_and_other_columns_stay(spark, rows):
    X, _, df = rows
    fit = models.fit_mlp(df, ["a", "b", "c"], hidden=(9, 6), steps_per_chunk=3, max_chunks=1)
    got = models.scored(fit.model, df)
    assert got.columns == [*df.columns, "pred_idx", "_p"] and "transform" not in got._jdf.queryExecution().toString()
    want = fit.model.transform(df.withColumn("features", array_to_vector("vec"))).select("cell_id", F.col("prediction").cast("int"), vector_to_array("probability"))
    a, b = sorted(got.select("cell_id", "pred_idx", "_p").collect()), sorted(map(tuple, want.collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-12)
    hard, long = models.predict(fit, df)
    assert hard.columns == ["cell_id", "pred", "confidence"] and long.count() == 3 * len(X)


def test_evaluations_leave_no_gradients_behind(spark, rows):
    from tests.test_large_mapping import _shuffle_files

    net = models.Network(rows[2], SIZES, "label_idx")
    w = net.initial_weights(1)
    before = _shuffle_files(spark)
    for i in range(3):
        net.loss(w + i)
    assert not _shuffle_files(spark) - before


def test_a_check_scores_rows_once_and_attributes_to_the_likeliest_class(spark, rows, monkeypatch):
    from countframe.operators import explain
    from countframe.plans import q_invariants as qi
    from countframe.plans import q_mapping as qm

    _, _, df = rows
    fit = models.fit_mlp(df, ["a", "b", "c"], hidden=(9, 6), steps_per_chunk=3, max_chunks=1)
    seen, real = [], models.scored
    monkeypatch.setattr(models, "scored", lambda *a: seen.append(1) or real(*a))
    out = qi._classified(fit, df)
    assert len(seen) == 1 and out.count() == df.count() and out.where("NOT (sums_to_one AND top_is_pred AND complete)").isEmpty()
    got = {r.cell_id: r.target for r in qm._attributed(fit, df).collect()}
    assert len(seen) == 2 and got == {r.cell_id: r.pred_idx for r in real(fit.model, df).collect()}
    layers = explain.mlp_layers(fit.model)
    X = rows[0][:5]
    kept = X.copy()
    explain._mlp_path_grad(layers, X, np.zeros(5, int), 4)
    assert (X == kept).all()                                # sums are made in place, not in the rows
