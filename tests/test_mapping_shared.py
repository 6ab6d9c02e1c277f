"""Steps that the mapping queries share: propagation, neighbours, preparation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import countframe.operators.semisup as semisup
from countframe.operators import neighbors as nb
from countframe.plans import q_invariants as qi
from countframe.plans import q_mapping as qm
from tests.conftest import SF_SMALL


def _graph(rng, n, k):
    return [(i, int(j), r + 1, float(rng.random())) for i in range(n)
            for r, j in enumerate(rng.choice([x for x in range(n) if x != i], k, replace=False))]


@pytest.mark.parametrize("rounds", [0, 1, 2, 7])
def test_propagation_equals_rounds_over_all_edges(spark, rounds):
    rng = np.random.default_rng(rounds)
    n, labels = 60, ["a", "b", "c"]
    edges = _graph(rng, n, 4)
    seed = [labels[rng.integers(3)] if rng.random() < 0.4 else None for _ in range(n)]
    p = np.array([[float(s == x) for x in labels] for s in seed])
    for _ in range(rounds):
        new = np.zeros_like(p)
        for i, j, _, d in edges:
            new[i] += p[j] / (1 + d)
        new = np.divide(new, new.sum(axis=1, keepdims=True), out=np.zeros_like(new), where=new.sum(axis=1, keepdims=True) > 0)
        p = np.array([p[i] if seed[i] else new[i] for i in range(n)])
    graph = spark.createDataFrame(edges, "src long, dst long, rank int, dist double")
    obs = spark.createDataFrame(list(enumerate(seed)), "cell_id long, label_seed string")
    got = np.zeros_like(p)
    for r in semisup.propagate_labels(graph, obs, rounds=rounds, checkpoint_every=3, tol=0.0).collect():
        got[r.cell_id, labels.index(r.label)] += r.p
    assert np.allclose(got, p, atol=1e-12)


def test_rounds_read_only_edges_between_rows_without_seed(spark, monkeypatch):
    n = 40
    graph = spark.createDataFrame(_graph(np.random.default_rng(1), n, 5), "src long, dst long, rank int, dist double")
    obs = spark.range(n).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 30, F.lit("a")).alias("label_seed"))
    read, real = [], semisup.pull
    monkeypatch.setattr(semisup, "pull", lambda e, p: read.append(e) or real(e, p))
    semisup.propagate_labels(graph, obs, rounds=4, checkpoint_every=2, tol=-1.0)
    assert read[0].where("src < 30").isEmpty()                                    # what seeds give, once
    assert len(read) == 4 and all(e.where("src < 30 OR dst < 30").isEmpty() for e in read[1:])


@pytest.mark.parametrize("self_too", [True, False])
def test_nearest_with_repeated_ids_and_equal_rows(self_too):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 5)) * 3, 1) + 100
    x[300:360] = x[5]
    ids = np.arange(700) % 650                               # ids may repeat
    row, col, dist = nb.nearest(x, ids, x, ids, 6, self_too)
    d = np.floor(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) * 1e6 + 0.5) / 1e6
    for i in range(700):
        want = sorted((d[i, j], ids[j]) for j in range(700) if not (self_too and ids[i] == ids[j]))[:6]
        assert sorted(zip(dist[row == i], ids[col[row == i]])) == want


def test_queries_of_one_split_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nb, "SPREAD_PAIRS", 100)
    x = spark.range(50, numPartitions=1).select(F.col("id").alias("cell_id"), F.array(F.col("id").cast("double"), F.rand(3)).alias("vec"))
    assert nb.knn_join(x, x, 3).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism // 2


def test_map_query_check_prepares_once(spark, monkeypatch):
    seen, real = [], qm.f2_mapping
    monkeypatch.setattr(qi, "f2_mapping", lambda s, sf: seen.append(real(s, sf)) or seen[-1])
    for way in ("mapped_knn", "mapped_latent", "mapped_semisup"):
        monkeypatch.setattr(qi, way, lambda s, sf, m: m.qry.obs.select("cell_id", F.col("label").alias("pred")))
    out = qi.map_query_check_q(spark, SF_SMALL)
    assert len(seen) == 1 and out.count() == 3 * seen[0].qry.obs.count() and out.where("NOT known_label").isEmpty()
