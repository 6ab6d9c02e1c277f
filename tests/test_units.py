"""Hand-made frames for the edge cases of the relational operators."""

import math

import numpy as np
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.operators import evaluate, features, neighbors, normalize, qc, sampling, summary


def _cf(spark):
    # 3 cells x 3 genes; cell 3 has no entry, gene g3 is all zero
    x = spark.createDataFrame([(1, "g1", 2), (1, "g2", 2), (2, "g1", 4)], "cell_id long, gene_id string, n long")
    obs = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "a", "A")],
                                "cell_id long, batch string, label string")
    var = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "gene_id string")
    return CountFrame(x, obs, var)


def test_qc_keeps_empty_cells(spark):
    q = {r["cell_id"]: (r["n_genes_by_counts"], r["total_counts"]) for r in qc.qc_cells(_cf(spark)).collect()}
    assert q == {1: (2, 4), 2: (1, 4), 3: (0, 0)}


def test_qc_genes_divides_by_all_cells(spark):
    g = {r["gene_id"]: r for r in qc.qc_genes(_cf(spark)).collect()}
    assert g["g1"]["n_cells_by_counts"] == 2
    assert abs(g["g1"]["mean_counts"] - 2.0) < 1e-12
    assert abs(g["g2"]["pct_dropout_by_counts"] - 100 * 2 / 3) < 1e-9


def test_normalize_total_and_log(spark):
    cf = normalize.normalize_total(_cf(spark), 10.0)
    v = {(r["cell_id"], r["gene_id"]): r["value"] for r in cf.x.collect()}
    assert v == {(1, "g1"): 5.0, (1, "g2"): 5.0, (2, "g1"): 10.0}
    lg = {(r["cell_id"], r["gene_id"]): r["value"] for r in normalize.log1p(cf).x.collect()}
    assert abs(lg[(2, "g1")] - math.log1p(10.0)) < 1e-12


def test_gene_stats_count_implicit_zeros(spark):
    cf = _cf(spark)
    st = {r["gene_id"]: r for r in normalize.gene_stats(cf.values(), 3).collect()}
    dense = np.array([[2, 2, 0], [4, 0, 0], [0, 0, 0]], dtype=float)
    assert abs(st["g1"]["mean"] - dense[:, 0].mean()) < 1e-12
    assert abs(st["g1"]["std"] - dense[:, 0].std(ddof=1)) < 1e-12


def test_scale_sigma_zero_and_clip(spark):
    cf = _cf(spark)
    axis = features.index_genes(cf.var)
    vecs = normalize.scale(cf, axis, "self", max_value=1.0)
    got = {r["cell_id"]: r["vec"] for r in vecs.collect()}
    dense = np.array([[2, 2, 0], [4, 0, 0], [0, 0, 0]], dtype=float)
    mu, sd = dense.mean(0), dense.std(0, ddof=1)
    sd[sd == 0] = 1.0
    want = np.clip((dense - mu) / sd, -1, 1)
    for i, c in enumerate([1, 2, 3]):
        assert np.allclose(got[c], want[i])
    assert got[3][2] == 0.0  # all-zero gene: sigma 0 -> 1, z = 0


def test_exact_k_sizes(spark):
    obs = spark.range(0, 1001).withColumnRenamed("id", "cell_id").withColumn(
        "label", F.when(F.col("cell_id") < 700, "big").when(F.col("cell_id") < 1000, "small").otherwise("one"))
    m = sampling.mask_labels(obs, 0.30)
    assert m.where("masked").count() == math.floor(0.3 * 1001)
    assert sampling.cap_rows(obs, 250).count() == 250
    assert sampling.cap_rows(obs, 5000).count() == 1001
    s = sampling.stratified_split(obs, "label", 0.20)
    per = {r["label"]: r["n"] for r in s.where("is_val").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert per == {"big": 140, "small": 60}  # the class of size 1 stays in training


def test_exact_k_equals_plain_ranking(spark):
    from countframe.functions.hashing import md5_key

    obs = spark.range(0, 3000).withColumnRenamed("id", "cell_id")
    got = {r["cell_id"] for r in sampling.cap_rows(obs, 777).collect()}
    ranked = obs.withColumn("h", md5_key(F.col("cell_id"), 42)).orderBy("h", "cell_id").limit(777)
    assert got == {r["cell_id"] for r in ranked.collect()}


def test_crosstab_zero_fill(spark):
    df = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x")], "label string, batch string")
    ct = {(r["label"], r["batch"]): r["n"] for r in summary.crosstab(df, "label", "batch").collect()}
    assert ct == {("A", "x"): 1, ("A", "y"): 1, ("B", "x"): 1, ("B", "y"): 0}
    assert [r["label"] for r in summary.absent_labels(summary.crosstab(df, "label", "batch"), "label").collect()] == ["B"]


def test_weighted_f1_zero_division(spark):
    # class C is never predicted, class D is never true
    df = spark.createDataFrame([(1, "A", "A"), (2, "A", "D"), (3, "C", "A"), (4, "A", "A")],
                               "cell_id long, truth string, pred string")
    f1 = evaluate.weighted_f1(df).first()[0]
    # A: tp 2, support 3, n_pred 3 -> f1 2/3; C: 0
    assert abs(f1 - (3 * (2 / 3) + 1 * 0) / 4) < 1e-12
    acc = evaluate.accuracy(df).first()["accuracy"]
    assert acc == 0.5


def test_roc_auc_ties_and_separation(spark):
    tie = spark.createDataFrame([(i, "A" if i % 2 else "B", "A", 0.5) for i in range(10)],
                                "cell_id long, truth string, class string, score double")
    assert evaluate.roc_auc(tie).first()["auc"] == 0.5
    sep = spark.createDataFrame([(i, "A" if i < 5 else "B", "A", 1.0 if i < 5 else 0.0) for i in range(10)],
                                "cell_id long, truth string, class string, score double")
    assert evaluate.roc_auc(sep).first()["auc"] == 1.0


def test_roc_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 400
    truth = rng.integers(0, 2, n)
    score = np.round(rng.random(n) + 0.3 * truth, 2)
    df = spark.createDataFrame([(i, "A" if t else "B", "A", float(s)) for i, (t, s) in enumerate(zip(truth, score))],
                               "cell_id long, truth string, class string, score double")
    pos, neg = score[truth == 1], score[truth == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(evaluate.roc_auc(df, n_buckets=7).first()["auc"] - round(brute, 6)) < 1e-6
    pts = evaluate.roc_points(df, n_buckets=7).collect()
    for r in pts:
        assert r["tps"] == (pos >= r["threshold"]).sum()
        assert r["fps"] == (neg >= r["threshold"]).sum()


def test_knn_vote_zero_distance_and_tie(spark):
    nbrs = spark.createDataFrame([(1, 10, 0.0), (1, 11, 1.0), (2, 12, 1.0), (2, 13, 1.0)],
                                 "query_id long, ref_id long, dist double")
    labels = spark.createDataFrame([(10, "Z"), (11, "A"), (12, "B"), (13, "A")], "cell_id long, label string")
    pr = neighbors.knn_predict_proba(nbrs, labels)
    p = {(r["query_id"], r["label"]): r["p"] for r in pr.collect()}
    assert p[(1, "Z")] == 1.0 and p[(1, "A")] == 0.0
    pred = {r["query_id"]: r["pred"] for r in neighbors.knn_predict(pr).collect()}
    assert pred == {1: "Z", 2: "A"}  # tie between A and B -> alphabetical


def test_knn_join_matches_numpy_and_blocks(spark):
    rng = np.random.default_rng(1)
    Q = rng.normal(size=(57, 8))
    T = rng.normal(size=(131, 8))
    T[5] = Q[3]  # an exact copy: zero distance
    q = spark.createDataFrame([(i, Q[i].tolist()) for i in range(len(Q))], "cell_id long, vec array<double>")
    t = spark.createDataFrame([(1000 + j, T[j].tolist()) for j in range(len(T))], "cell_id long, vec array<double>")
    d = np.sqrt(((Q[:, None, :] - T[None, :, :]) ** 2).sum(-1))
    # blocked cogroup path (broadcast disabled) and broadcast path
    for block, bbytes in ((16, 0), (4096, 0), (16, neighbors.BROADCAST_BYTES)):
        got = neighbors.knn_join(q, t, 5, block_rows=block, broadcast_bytes=bbytes).collect()
        assert len(got) == 57 * 5
        for r in got:
            i = r["query_id"]
            order = sorted(range(len(T)), key=lambda j: (round(d[i, j], 6), j))
            assert 1000 + order[r["rank"] - 1] == r["ref_id"]
    zero = [r for r in got if r["query_id"] == 3 and r["rank"] == 1][0]
    assert zero["ref_id"] == 1005 and zero["dist"] == 0.0


def test_attach_predictions_and_argmax(spark):
    obs = spark.createDataFrame([(1,), (2,)], "cell_id long")
    preds = spark.createDataFrame([(2, "X")], "cell_id long, pred string")
    out = {r["cell_id"]: r["pred"] for r in evaluate.attach_predictions(obs, preds).collect()}
    assert out == {1: "Unknown", 2: "X"}
    probs = spark.createDataFrame([(1, "b", 0.4), (1, "a", 0.4), (1, "c", 0.2)], "cell_id long, class string, score double")
    r = evaluate.argmax_label(probs).first()
    assert r["pred"] == "a" and r["confidence"] == 0.4


def test_ensure_qc_only_when_missing(spark):
    cf = qc.ensure_qc(_cf(spark))
    assert {"n_genes_by_counts", "total_counts"} <= set(cf.obs.columns)
    again = qc.ensure_qc(cf)
    assert again.obs is cf.obs  # present: not recomputed


def test_evaluate_query_with_and_without_truth(spark):
    preds = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "cell_id long, pred string")
    with_truth = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A")], "cell_id long, label_truth string")
    m = evaluate.evaluate_query(preds, with_truth).first()
    assert m["n"] == 3 and abs(m["accuracy"] - 2 / 3) < 1e-12
    no_truth = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    counts = {r["pred"]: r["n"] for r in evaluate.evaluate_query(preds, no_truth).collect()}
    assert counts == {"A": 2, "B": 1}


def test_histogram_and_distribution(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    h = {r["bin"]: r["n"] for r in summary.histogram(df, "v", bins=5).collect()}
    assert sum(h.values()) == 11 and h[4] == 3  # max value lands in the last bin
    d = summary.distribution(df, "v").first()
    assert (d["q0"], d["q50"], d["q100"], d["n"]) == (0.0, 5.0, 10.0, 11)


def test_approximate_quantiles_close_to_exact(spark):
    df = spark.range(0, 5001).select((F.col("id") % 97).cast("double").alias("v"), F.lit("a").alias("g"))
    ex = summary.distribution(df, "v", by="g").first()
    ap = summary.distribution(df, "v", by="g", approx=True).first()
    assert abs(ex["q50"] - ap["q50"]) <= 1.0 and ex["q0"] == ap["q0"] and ex["q100"] == ap["q100"]
    s = summary.summarize(df, "g", ["v"], ("median",), approx=True).first()
    assert abs(s["v_median"] - ex["q50"]) <= 1.0


def test_scale_dense_equals_long_form_scaling(spark):
    cf = _cf(spark)
    axis = features.index_genes(cf.var)
    long_form = {r["cell_id"]: r["vec"] for r in normalize.scale(cf, axis, "self").collect()}
    raw = features.to_vectors(cf.values(), axis, cf.obs)
    dense = {r["cell_id"]: r["vec"] for r in normalize.scale_dense(raw).collect()}
    for c in long_form:
        assert np.allclose(long_form[c], dense[c], atol=1e-12)


def test_knn_with_a_third_identical_rows(spark):
    # a third of the training rows are the same vector: all tie, ties go by id
    rng = np.random.default_rng(4)
    T = rng.normal(size=(300, 4))
    T[:100] = 0.25
    Q = np.vstack([np.full((1, 4), 0.25), rng.normal(size=(5, 4))])
    q = spark.createDataFrame([(i, Q[i].tolist()) for i in range(len(Q))], "cell_id long, vec array<double>")
    t = spark.createDataFrame([(1000 + j, T[j].tolist()) for j in range(len(T))], "cell_id long, vec array<double>")
    for bbytes in (0, neighbors.BROADCAST_BYTES):
        got = neighbors.knn_join(q, t, 7, block_rows=64, broadcast_bytes=bbytes).where("query_id = 0").collect()
        assert sorted(r["ref_id"] for r in got) == list(range(1000, 1007))
        assert all(r["dist"] == 0.0 for r in got)


def test_stratified_split_with_a_hot_label(spark):
    obs = spark.range(0, 3000).withColumnRenamed("id", "cell_id").withColumn(
        "label", F.when(F.col("cell_id") < 1000, "hot").otherwise(F.concat(F.lit("c"), (F.col("cell_id") % 7).cast("string"))))
    s = sampling.stratified_split(obs, "label", 0.25)
    per = {r["label"]: (r["n"], r["v"]) for r in
           s.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_val").alias("v")).collect()}
    for lab, (n, v) in per.items():
        assert v == math.floor(0.25 * n + 0.5)
    assert per["hot"] == (1000, 250)
