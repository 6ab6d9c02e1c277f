"""Mergeable moments: parts together equal the whole, and the fit from them."""

import numpy as np

from countframe.operators import embed, moments, sparsepca
from tests.test_sparsepca import triples


def test_halves_equal_the_whole_and_survive_writing(spark, tmpdir_path):
    (x, axis, cells, _), _ = triples(spark, n=90)
    whole = {(r.kind, r.i, r.j): r.value for r in moments.moments(x, axis, cells).collect()}
    parts = []
    for part in ("cell_id % 3 = 0", "cell_id % 3 = 1", "cell_id % 3 = 2"):
        path = f"{tmpdir_path}/{len(parts)}"
        moments.moments(x.where(part), axis, cells.where(part)).write.parquet(path)
        parts.append(spark.read.parquet(path))
    merged = {(r.kind, r.i, r.j): r.value for r in moments.merge(*parts).collect()}
    assert merged.keys() == whole.keys() and all(abs(merged[k] - whole[k]) <= 1e-9 * max(1, abs(whole[k])) for k in whole)


def test_space_equals_the_dense_fit(spark):
    (x, axis, cells, _), _ = triples(spark)
    state = moments.moments(x, axis, cells)
    m = np.zeros((60, 17))
    for r in x.collect():
        m[r.cell_id, int(r.gene_id[1:])] = r.value
    got = np.zeros((17, 17))
    for r in moments.covariance(state).collect():
        got[r.i, r.j] = got[r.j, r.i] = r.cov
    assert np.allclose(got, np.cov(m, rowvar=False))
    stats, loadings, share = moments.space(state, axis, 4)
    sd = m.std(axis=0, ddof=1)
    z = (m - m.mean(axis=0)) / np.where(sd > 0, sd, 1)
    value, vector = np.linalg.eigh(np.cov(z, rowvar=False))
    w = loadings.toPandas().sort_values(["gene_id", "pc"]).w.to_numpy().reshape(17, 4)
    assert sparsepca.subspace_angle(vector[:, ::-1][:, :4], w) < 1e-6 and np.allclose(share, value[::-1][:4] / value.sum())
    scores = {(r.cell_id, r.pc): r.score for r in embed.project(x, loadings, cells, 4, stats, max_value=None).collect()}
    assert all(np.isclose(scores[c, p], (z @ w)[c, p]) for c in range(60) for p in range(4))
