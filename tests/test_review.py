"""Cases found in review: odd names and types in cross-tabs, labels of other
types, rows that no seed reaches, empty sides, piled-up scores, whole texts,
and rows that must not depend on their company."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.operators import embed, evaluate, features, hvg, neighbors, normalize, sampling, semisup, summary
from countframe.sources import fixtures
from tests.conftest import SF_MID, SF_SMALL


def test_crosstab_of_awkward_values(spark):
    rows = [("CD4+ T cell.1", "X"), ("CD4+ T cell.1", "x"), ("b.c`d", "label"), (None, "X"), ("b.c`d", None)]
    ct = summary.crosstab(spark.createDataFrame(rows, "label string, batch string"), "label", "batch").collect()
    got = {(r["label"], r["batch"]): r["n"] for r in ct}
    assert len(got) == 9 and got[("CD4+ T cell.1", "X")] == got[("CD4+ T cell.1", "x")] == got[(None, "X")] == 1
    assert sum(got.values()) == 4 and all(c is not None for _, c in got)
    ints = summary.crosstab(spark.createDataFrame([(1, 10), (2, 20)], "label int, batch int"), "label", "batch")
    assert dict(ints.dtypes) == {"label": "int", "batch": "int", "n": "bigint"} and ints.count() == 4
    assert summary.crosstab(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    pred = spark.createDataFrame([("CD4+ T cell.1", "NK.2"), ("NK.2", "NK.2")], "truth string, pred string")
    assert {(r.truth, r.pred): r.frac for r in evaluate.confusion(pred).collect()} == {("CD4+ T cell.1", "NK.2"): 1.0, ("NK.2", "NK.2"): 1.0}


def test_labels_of_other_types_are_masked(spark):
    obs = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("label"))
    masked = sampling.mask_labels(obs, 0.3)
    assert masked.where("label_masked = 'Unknown'").count() == 30
    assert {r[0] for r in masked.select("label_truth").distinct().collect()} == {"0", "1", "2"}


def test_rows_without_a_seed_in_reach_are_unknown(spark):
    graph = spark.createDataFrame([(2, 1, 1, 0.5), (4, 3, 1, 0.5), (3, 4, 1, 0.5)], "src long, dst long, rank int, dist double")
    obs = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, None)], "cell_id long, label_seed string")
    probs = semisup.propagate_labels(graph, obs, rounds=30, checkpoint_every=2)
    got = {r.cell_id: (r.pred, r.confidence) for r in semisup.annotate(probs, obs).collect()}
    assert got == {1: ("a", 1.0), 2: ("a", 1.0), 3: ("Unknown", 0.0), 4: ("Unknown", 0.0)}


def test_knn_of_an_empty_side_and_of_blocks(spark):
    lat = fixtures.embedding_latent(spark, SF_SMALL)
    for q, t in ((lat, lat.limit(0)), (lat.limit(0), lat)):
        assert neighbors.knn_join(q, t, 5).count() == 0
    key = lambda df: sorted((r.query_id, r.rank, r.ref_id, round(r.dist, 9)) for r in df.collect())
    assert key(neighbors.knn_join(lat, lat, 5)) == key(neighbors.knn_join(lat, lat, 5, broadcast_bytes=0, block_rows=64))


def test_roc_with_piled_up_scores(spark):
    rng = np.random.default_rng(0)
    score = np.round(np.exp(-20 * rng.random(4000)), 7)
    truth = np.where(rng.random(4000) < 0.3 + 0.5 * score, "a", "b")
    df = spark.createDataFrame([(str(t), "a", float(s)) for t, s in zip(truth, score)], "truth string, class string, score double")
    pos, neg = score[truth == "a"], score[truth == "b"]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(want, abs=1e-6)
    points = sorted((r.tps, r.fps) for r in evaluate.roc_points(df).collect())
    assert points[0] == (0, 0) and points[-1] == (len(pos), len(neg)) and len(points) == len(set(score)) + 1


def test_every_token_of_every_text_counts(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("text").collect()]
    want = sum(len([w for w in t.lower().translate(str.maketrans("\n.,", "   ")).split(" ") if w]) for t in texts)
    assert fixtures.document_tokens(spark, SF_MID).x.agg(F.sum("n")).first()[0] == want


def test_a_row_scored_alone_equals_the_row_scored_with_others(spark):
    cf = fixtures.customer_products(spark, SF_SMALL)
    axis = features.freeze_axis(features.index_genes(cf.genes().orderBy("gene_id").limit(20)))
    totals, n = embed.nb_batch_totals(cf, axis, "batch"), cf.obs.count()
    some = [r.cell_id for r in cf.obs.select("cell_id").orderBy("cell_id").limit(3).collect()]
    vec = lambda ids: {r.cell_id: r.vec for r in embed.nb_residual_vectors(
        CountFrame(cf.x.where(F.col("cell_id").isin(ids)), cf.obs.where(F.col("cell_id").isin(ids))), axis, "batch",
        batch_totals=totals, n_train=n).collect()}
    assert vec(some[:1])[some[0]] == vec(some)[some[0]]
    with pytest.raises(ValueError):
        embed.nb_residual_vectors(cf, axis, "batch", batch_totals=totals)


def test_variance_of_large_values_is_stable(spark):
    big = 1e9
    x = spark.createDataFrame([(i, "g", big + i % 3) for i in range(30)] + [(0, "h", 1.0)], "cell_id long, gene_id string, value double")
    st = {r.gene_id: r for r in normalize.gene_stats(x, 30).collect()}
    assert st["g"].std == pytest.approx(np.std([big + i % 3 for i in range(30)], ddof=1), rel=1e-6)
    assert st["h"].std == pytest.approx(np.std([1.0] + [0.0] * 29, ddof=1))


def test_top_rows_beyond_a_thousand(spark):
    df = spark.range(6000).select(F.col("id").alias("cell_id"), F.lit("a").alias("label"))
    assert sampling.sample_per_label(df, 1500).count() == 1500
    assert sorted(r.cell_id for r in sampling.limit_per_label(df, 1500).collect()) == list(range(1500))
    cf = normalize.normalize_total(fixtures.document_tokens(spark, SF_SMALL))
    flags = hvg.highly_variable(cf.x, cf.obs, 1200, batch="batch")
    assert flags.where("highly_variable").count() == 1200
