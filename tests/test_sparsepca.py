"""PCA of long triples against numpy on the dense matrix."""

import numpy as np

from countframe.operators import sparsepca as sp


def triples(spark, n=60, g=17, seed=3):
    draw = np.random.default_rng(seed)
    m = draw.poisson(0.6, (n, g)).astype(float) * draw.normal(2, 1, (n, g)) * (draw.random((n, g)) < 0.5)
    m[:, 4] = 0                                   # a gene without entries
    m[7] = m[21] = 0                              # cells without entries
    m[3, 9] = 500                                 # beyond the clip
    x = [(c, f"g{j:02}", float(m[c, j])) for c in range(n) for j in range(g) if m[c, j]]
    sd = m.std(axis=0, ddof=1)
    z = np.clip((m - m.mean(axis=0)) / np.where(sd == 0, 1, sd), -3, 3)
    stats = [(f"g{j:02}", float(m[:, j].mean()), float(sd[j])) for j in range(g) if j != 4]
    return (spark.createDataFrame(x, "cell_id long, gene_id string, value double"),
            spark.createDataFrame([(f"g{j:02}", j) for j in range(g)], "gene_id string, gene_idx int"),
            spark.createDataFrame([(c,) for c in range(n)], "cell_id long"),
            spark.createDataFrame(stats, "gene_id string, mean double, std double")), z


def test_equals_the_dense_eigenvectors(spark):
    frames, z = triples(spark)
    value, vector = np.linalg.eigh(np.cov(z, rowvar=False))
    for k in (1, 3, 5):
        res = sp.pca_sparse(*frames, k, max_value=3.0)
        assert sp.subspace_angle(vector[:, ::-1][:, :k], res.components) < 1e-6
        assert np.allclose(res.explained_ratio, value[::-1][:k] / value.sum(), atol=1e-10)
        assert np.allclose(res.mean, z.mean(axis=0)) and np.allclose(res.components.T @ res.components, np.eye(k))
        got = {r.cell_id: r.vec for r in res.latent.collect()}
        want = (z - z.mean(axis=0)) @ res.components
        assert len(got) == 60 and all(np.allclose(got[c], want[c]) for c in got)
    whole = sp.pca_sparse(*frames, 40, max_value=3.0)             # more than the axis has
    assert whole.components.shape == (17, 17) and np.allclose(whole.explained_ratio.sum(), 1)


def test_lanczos_needs_few_passes_where_eigenvalues_are_close():
    draw = np.random.default_rng(0)
    q = np.linalg.qr(draw.normal(size=(600, 600)))[0]
    spectrum = 1 / np.sqrt(1 + np.arange(600))
    a = (q * spectrum) @ q.T
    value, vector, passes = sp.principal(lambda b: a @ b, 600, 20)
    assert np.allclose(value, spectrum[:20]) and sp.subspace_angle(q[:, :20], vector) < 1e-5 and passes < 15
    value, vector, _ = sp.principal(lambda b: np.zeros_like(b), 30, 4)
    assert not value.any() and vector.shape == (30, 4)


def test_entries_give_the_components_of_the_triples(spark):
    from countframe.operators import features, normalize

    rng = np.random.default_rng(6)
    x = [(c, f"g{g}", float(rng.integers(1, 9))) for c in range(80) for g in range(12) if rng.random() < 0.3]
    x = spark.createDataFrame(x, "cell_id long, gene_id string, value double").repartition(40)
    cells = spark.range(90).withColumnRenamed("id", "cell_id")           # ten cells without entries
    axis = spark.createDataFrame([(f"g{g}", g) for g in range(12)] + [("absent", 12)], "gene_id string, gene_idx int")
    stats = normalize.gene_stats(x, normalize.n_cells_of(cells))
    want = sp.pca_sparse(x, axis, cells, stats, 4)
    rows = features.cell_entries(x, axis).repartition(40)
    got = sp.pca_sparse_entries(rows, 13, cells, 4)
    assert np.allclose(got.components, want.components, atol=1e-9) and np.allclose(got.explained_ratio, want.explained_ratio, atol=1e-12)
    assert np.allclose(got.mean, want.mean, atol=1e-12)
    score = lambda res: np.array([r.vec for r in res.latent.orderBy("cell_id").collect()])
    assert score(got).shape == (90, 4) and np.allclose(score(got), score(want), atol=1e-9)
