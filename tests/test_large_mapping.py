"""The mapping queries on rows of their own: what each step does to the next."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countframe import session
from countframe.operators import knnindex as ki
from countframe.operators import neighbors as nb
from countframe.operators import project
from countframe.plans import q_mapping as qm


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Tables of 150 customers and 150 kinds of parts; some keys repeat or are null."""
    at = tmp_path_factory.mktemp("shop")
    rng = np.random.default_rng(5)
    n, parts = 150, [(i, f"Brand#{i % 25}", f"type {i // 25}") for i in range(150)]
    orders = [(i, i % n if i != 7 else None) for i in range(3 * n)]
    lines = [(int(rng.integers(3 * n)), int(p), float(rng.integers(1, 50))) for p in rng.integers(0, 150, 9000)]
    rows = {"region": ([(0, "north"), (1, "south")], "r_regionkey int, r_name string"),
            "nation": ([(i, f"n{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
            "customer": ([(i, i % 4, "ABC"[i % 3]) for i in range(n)], "c_custkey long, c_nationkey int, c_mktsegment string"),
            "part": (parts, "p_partkey long, p_brand string, p_type string"),
            "orders": (orders, "o_orderkey long, o_custkey long"),
            "lineitem": (lines + [(None, 1, 2.0), (1, None, 2.0)], "l_orderkey long, l_partkey long, l_quantity double")}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_the_components_of_the_knn_mapping_are_fewer_than_its_genes(spark, shop, monkeypatch):
    made, real = [], project.fit_knn_space
    monkeypatch.setattr(project, "fit_knn_space", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    m = qm.f2_mapping(spark, shop)
    out = qm.mapped_knn(spark, shop, m)
    genes, components = made[0].pca.components.shape
    assert components == 50 < genes < m.ref.x.select("gene_id").distinct().count()
    assert made[0].pca.explained_ratio.sum() < 1 - 1e-6                 # what is left out moves distances
    assert m.axis.count() == 50                                        # the other models' list is as before
    assert out.count() == m.qry.obs.count()


def _shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_a_written_frame_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    held = spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 997).alias("a")).agg(F.sum("id").alias("s"))
    kept = session.cut_lineage(held)
    assert kept.count() == 997 == held.count()                         # the plan itself can run again
    spark.conf.set(session.CLEANUP, "false")
    try:
        session.cut_lineage(held)
        assert spark.conf.get(session.CLEANUP) == "false"               # the session's own setting stays
    finally:
        spark.conf.unset(session.CLEANUP)
    names = {n.split("_")[1] for n in _shuffle_files(spark) - before}
    again = session.cut_lineage(held)
    assert again.count() == 997
    made = {n.split("_")[1] for n in _shuffle_files(spark) - before} - names
    assert len(made) <= 1                                              # of count() alone, whose aggregate is not written


@pytest.mark.parametrize("exclude_self", [True, False])
def test_far_blocks_pass_by_queries_that_stay(spark, monkeypatch, exclude_self):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 5)), 1)                          # equal distances, equal rows
    x[100:140] = x[3]
    ids = np.arange(600) % 550                                         # ids may repeat
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "cell_id long, vec array<double>")
    met, real = [], ki._meet
    monkeypatch.setattr(ki, "_meet", lambda index, q, *a: met.append(q.count()) or real(index, q, *a))
    monkeypatch.setattr(ki, "GROUP_ROWS", 40)
    want = nb.knn_join(t, t, 6, exclude_self=exclude_self).dropDuplicates(["query_id", "rank"])
    want = {(r.query_id, r.rank): r.dist for r in want.collect() if r.query_id >= 50}       # of repeated ids, one of two rows
    for sent, at_once in ((1 << 20, 16), (2000, 2)):
        met.clear()
        monkeypatch.setattr(ki, "SENT_BYTES", sent)
        monkeypatch.setattr(ki, "ROUND", at_once)
        index = ki.PivotIndex.build(t, 6, block_rows=16)
        got = index.search(t, 6, exclude_self=exclude_self)
        assert {(r.query_id, r.rank): r.dist for r in got.collect() if r.query_id >= 50} == want
        assert sum(met) == 600 < index.meetings.met                    # a query is copied to its home alone
        assert index.meetings.row_pairs <= index.meetings.all_row_pairs


def test_counts_and_moments_that_are_there_are_not_made_again(spark, tmp_path, monkeypatch):
    from countframe.operators import embed
    from countframe.plans import q_embedding as qe
    from countframe.sources import fixtures

    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9 + i % 5)), "ab"[i % 2], f"s{i % 3}") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    f4 = fixtures.materialize(fixtures.document_tokens(spark, str(tmp_path)))
    want = {r.cell_id: r.entries for r in qe.f4_entries(spark, str(tmp_path), 10)[0].collect()}
    monkeypatch.setattr(fixtures, "document_tokens", None)
    rows, axis, scaling, _ = qe.f4_entries(spark, str(tmp_path), 10, f4)
    assert {r.cell_id: r.entries for r in rows.collect()} == want
    vecs = qe.f4_dense(rows, axis, scaling)
    plain, moments = embed.pca(vecs, 3), embed.mean_covariance(vecs)
    monkeypatch.setattr(embed, "mean_covariance", None)
    for got in (embed.pca(vecs, 3, moments=moments), embed.linear_autoencoder(vecs, 3, moments=moments)[0]):
        assert np.allclose(got.components, plain.components) and np.allclose(got.explained_ratio, plain.explained_ratio)


def test_rows_that_were_placed_or_projected_are_not_kept_twice(spark, shop, monkeypatch):
    import glob

    def folders():
        return set(glob.glob(session.scratch_dir(spark).removeprefix("file:") + "/*"))

    before = folders()
    gone = session.cut_lineage(spark.range(3))
    assert len(folders() - before) == 1
    session.discard(gone)
    session.discard(gone)                                              # once is enough
    session.discard(spark.range(3))                                    # not written: nothing to delete
    assert folders() == before
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "cell_id long, vec array<double>")
    index = ki.PivotIndex.build(x, 4, block_rows=20)
    assert index.rows.count() == 300 and len(folders() - before) == 2  # repeated vectors (none), rows by block
    assert index.search(x, 4).count() == 1200
    m = qm.f2_mapping(spark, shop)
    axis, before = m.axis, folders()
    space = project.fit_nb_space(m.ref, axis, "batch", 5)
    assert space.pca.latent.count() == m.ref.obs.count()
    wide = [p for p in folders() - before if "vec" in spark.read.parquet(p).columns]
    assert len(wide) == 1                                              # the latent, not the residuals
