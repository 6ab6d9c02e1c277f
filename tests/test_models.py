"""Invariants of the model operators: PCA equals numpy's eigen-decomposition,
the linear autoencoder's MSE equals the unexplained variance, propagation
keeps seeds and sums to 1, integrated gradients are complete, MLlib's MLP
weights are read in the right layout."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from countframe.operators import embed, explain, models, neighbors, semisup


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(240, 12)) @ rng.normal(size=(12, 12))
    y = (base[:, 0] > 0).astype(int) + (base[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, base[i].tolist(), int(y[i])) for i in range(len(base))],
                               "cell_id long, vec array<double>, label_idx int")
    return base, y, df


def test_pca_matches_numpy(data):
    X, _, df = data
    res = embed.pca(df, 5)
    C = np.cov(X, rowvar=False)
    w, V = np.linalg.eigh(C)
    V = V[:, ::-1][:, :5]
    assert np.allclose(res.components.T @ res.components, np.eye(5), atol=1e-8)
    for j in range(5):
        assert abs(abs(V[:, j] @ res.components[:, j]) - 1) < 1e-6
        assert res.components[np.argmax(np.abs(res.components[:, j])), j] > 0
    Z = {r["cell_id"]: r["vec"] for r in res.latent.collect()}
    want = (X - X.mean(0)) @ res.components
    got = np.array([Z[i] for i in range(len(X))])
    assert np.allclose(got, want, atol=1e-8)


def test_linear_autoencoder_mse_is_unexplained_variance(data):
    X, _, df = data
    res, mse = embed.linear_autoencoder(df, 4)
    Xc = X - X.mean(0)
    R = Xc - (Xc @ res.components) @ res.components.T
    got = {r["cell_id"]: r["mse"] for r in mse.collect()}
    want = (R ** 2).mean(1)
    assert np.allclose([got[i] for i in range(len(X))], want, atol=1e-8)


def test_project_vectors_equals_latent(data):
    X, _, df = data
    res = embed.pca(df, 3)
    proj = {r["cell_id"]: r["vec"] for r in embed.project_vectors(df, res.components, res.mean).collect()}
    lat = {r["cell_id"]: r["vec"] for r in res.latent.collect()}
    for i in range(len(X)):
        assert np.allclose(proj[i], lat[i], atol=1e-8)


def test_propagation_keeps_seeds_and_sums_to_one(spark, data):
    X, y, df = data
    graph = neighbors.neighbors(df, 5)
    seeds = df.select("cell_id", F.when(F.col("cell_id") % 3 == 0, F.col("label_idx").cast("string")).alias("seed"))
    probs = semisup.propagate_labels(graph, seeds, "seed", rounds=5, checkpoint_every=2)
    sums = probs.groupBy("cell_id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    seeded = {r["cell_id"]: r["label"] for r in probs.where(F.col("cell_id") % 3 == 0).collect()}
    assert all(seeded[i] == str(y[i]) for i in seeded)
    ann = semisup.annotate(probs, seeds).collect()
    assert len(ann) == len(y)
    assert len(ann) == len(sums)


def test_mlp_weight_layout_and_ig_completeness(spark, data):
    X, y, df = data
    tr = df.withColumn("features", array_to_vector("vec")).withColumn("label", F.col("label_idx").cast("double"))
    model = MultilayerPerceptronClassifier(layers=[12, 7, 5, 3], maxIter=30, seed=1).fit(tr)
    layers = explain.mlp_layers(model)
    raw = np.array([r["r"] for r in model.transform(tr).select(vector_to_array("rawPrediction").alias("r"))
                    .orderBy("cell_id").collect()])
    assert np.allclose(explain.mlp_logits(layers, X), raw, atol=1e-8)
    rows = df.withColumn("target", F.col("label_idx"))
    coarse = max(abs(r["gap"]) for r in explain.integrated_gradients(model, rows, steps=20).collect())
    fine = max(abs(r["gap"]) for r in explain.integrated_gradients(model, rows, steps=2000).collect())
    # midpoint rule: the completeness gap shrinks with the number of steps
    assert fine < 1e-2 and fine < coarse / 10


def test_softmax_ig_is_exact(spark, data):
    _, _, df = data
    fit = models.fit_softmax(df, ["0", "1", "2"], max_iter=30)
    ig = explain.integrated_gradients(fit.model, df.withColumn("target", F.col("label_idx"))).collect()
    assert max(abs(r["gap"]) for r in ig) < 1e-9


def test_mlp_early_stopping_keeps_best(spark, data):
    _, _, df = data
    tr = df.where(F.col("cell_id") % 5 != 0)
    va = df.where(F.col("cell_id") % 5 == 0)
    fit = models.fit_mlp(tr, ["0", "1", "2"], hidden=(8,), val=va, steps_per_chunk=5, max_chunks=4, patience=1)
    assert len(fit.history) >= 1
    best = min(h["val_loss"] for h in fit.history)
    assert abs(models.log_loss(fit.model, va) - best) < 1e-9
    hard, long = models.predict(fit, va)
    assert hard.count() == va.count()
    assert long.count() == 3 * va.count()


def test_warm_start_from_stored_latent(spark, data, tmpdir_path):
    from countframe.sources import write_latent

    _, y, df = data
    seeds = df.select("cell_id", F.when(F.col("cell_id") % 4 == 0, F.col("label_idx").cast("string")).alias("seed"))
    write_latent(df.select("cell_id", "vec"), f"{tmpdir_path}/lat", "nb")
    warm = semisup.annotate_from_latent(spark, f"{tmpdir_path}/lat", seeds, "seed", "nb", k=5, rounds=3)
    cold = semisup.propagate_labels(neighbors.neighbors(df.select("cell_id", "vec"), 5), seeds, "seed", rounds=3)
    a = {(r["cell_id"], r["label"]): round(r["p"], 9) for r in warm.collect()}
    b = {(r["cell_id"], r["label"]): round(r["p"], 9) for r in cold.collect()}
    assert a == b


def test_weighted_f1_equals_mllib_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from countframe.operators import evaluate

    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 500)
    p = np.where(rng.random(500) < 0.6, y, rng.integers(0, 4, 500))
    df = spark.createDataFrame([(i, str(a), str(b), float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "cell_id long, truth string, pred string, label double, prediction double")
    ours = evaluate.weighted_f1(df).first()[0]
    ev = MulticlassClassificationEvaluator(metricName="weightedFMeasure").evaluate(df)
    assert abs(ours - ev) < 1e-12


def test_long_form_projection_equals_vector_projection(spark):
    from countframe.operators import features, normalize

    rng = np.random.default_rng(9)
    rows = [(c, f"g{g}", float(rng.integers(1, 20))) for c in range(60) for g in range(8) if rng.random() < 0.6]
    x = spark.createDataFrame(rows, "cell_id long, gene_id string, value double")
    cells = spark.range(0, 62).withColumnRenamed("id", "cell_id")  # two cells without entries
    axis = features.index_genes(x.select("gene_id").distinct())
    stats = normalize.gene_stats(x, 62)
    for clip in (None, 1.0):
        vecs = normalize.scale_vectors(x, axis, cells, stats, max_value=clip)
        res = embed.pca(vecs, 3)
        loadings = res.loadings(spark, axis)
        long = {(r["cell_id"], r["pc"]): r["score"]
                for r in embed.project(x, loadings, cells, 3, stats, max_value=clip).collect()}
        vec = {r["cell_id"]: r["vec"] for r in embed.project_vectors(vecs, res.components, None).collect()}
        for c in range(62):
            for k in range(3):
                assert abs(long[(c, k)] - vec[c][k]) < 1e-9


def test_dense_rows_covariance_and_scaling_of_entries(spark):
    """Entries become dense rows by scattering: absent and NULL values are 0,
    scaled alike; no stage of it looks up a map per feature."""
    from countframe.operators import features, normalize

    x = spark.createDataFrame([(1, "a", 2.0), (1, "c", 4.0), (2, "b", None), (3, "c", 1.0)], "cell_id long, gene_id string, value double")
    axis = features.index_genes(spark.createDataFrame([("a",), ("b",), ("c",)], "gene_id string"))
    cells = spark.createDataFrame([(1,), (2,), (3,), (3,), (9,)], "cell_id long")
    want = {1: [2.0, 0.0, 4.0], 2: [0.0] * 3, 3: [0.0, 0.0, 1.0], 9: [0.0] * 3}
    got = features.to_vectors(x, axis, cells)
    assert sorted((r.cell_id, r.vec) for r in got.collect()) == sorted((i, want[i]) for i in (1, 2, 3, 3, 9))
    assert {r.cell_id: r.vec for r in features.to_vectors(x, axis, cells, fill=F.lit(7.0)).collect()}[9] == [7.0] * 3
    assert "element_at" not in got._jdf.queryExecution().toString()
    rows = features.cell_entries(x, axis, cells)
    scaled = np.array([r.vec for r in features.dense_vectors(rows, 3, normalize.entry_scaling(rows, 3)).orderBy("cell_id").collect()])
    X = np.array([want[i] for i in (1, 2, 3, 3, 9)])
    sd = X.std(axis=0, ddof=1)
    assert np.allclose(scaled, (X - X.mean(0)) / np.where(sd > 0, sd, 1))
    mean, cov = embed.mean_covariance(got)
    assert np.allclose(mean, X.mean(0)) and np.allclose(cov, np.cov(X, rowvar=False))


def test_network_gradient_and_scores_are_mllibs(spark, data):
    """The gradient is that of the loss, training comes as low as MLlib's, and
    the model's chances are the network's."""
    X, y, df = data
    net = models.Network(df, [12, 7, 3], "label_idx")
    w = net.initial_weights(3)
    value, grad = net.loss(w)
    step = np.random.default_rng(1).normal(size=len(w)) * 1e-5
    assert abs((net.loss(w + step)[0] - net.loss(w - step)[0]) / 2 - grad @ step) < 1e-9
    tr = df.withColumn("features", array_to_vector("vec")).withColumn("label", F.col("label_idx").cast("double"))
    mllib = MultilayerPerceptronClassifier(layers=[12, 7, 3], maxIter=15, seed=3).fit(tr)
    got, low = models.minimise(net.loss, w, 15)
    assert low < value and low <= net.loss(mllib.weights.toArray())[0] * 1.25
    model = net.model(got)
    assert np.allclose(model.weights.toArray(), got)
    p = np.array([r[0] for r in model.transform(tr).orderBy("cell_id").select(vector_to_array("probability")).collect()])
    assert np.allclose(p, models.forward(models.unpack(got, [12, 7, 3]), X)[-1], atol=1e-9)
    assert abs(net.judge(got, df)[0] - models.log_loss(model, df)) < 1e-9


def test_path_gradient_is_the_mean_of_gradients():
    draw = np.random.default_rng(4)
    layers = [(draw.normal(size=(a, b)), draw.normal(size=b)) for a, b in ((6, 5), (5, 4), (4, 3))]
    X, t, logit = draw.normal(size=(3, 6)), np.array([0, 2, 1]), lambda x, c: explain.mlp_logits(layers, x[None])[0, c]
    got = explain._mlp_path_grad(layers, X, t, 7)
    for r in range(3):
        for j in range(6):
            e = np.eye(6)[j] * 1e-6
            want = np.mean([(logit((s + 0.5) / 7 * X[r] + e, t[r]) - logit((s + 0.5) / 7 * X[r] - e, t[r])) / 2e-6 for s in range(7)])
            assert abs(got[r, j] - want) < 1e-6
    one = layers[:1]
    assert np.allclose(explain._mlp_path_grad(one, X, t, 5), one[0][0].T[t])
