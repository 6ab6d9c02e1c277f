"""Semi-supervised mixture against plain numpy, and its objective."""

import numpy as np

from countframe.frame import CountFrame
from countframe.operators import mixture


def drawn(spark, n=160, g=30, seed=2):
    draw = np.random.default_rng(seed)
    phi = draw.dirichlet(np.full(g, 0.4), 3)
    truth = draw.integers(0, 3, n)
    m = np.array([draw.multinomial(draw.integers(1, 40), phi[c]) for c in truth])
    m[5] = 0                                             # a cell without counts
    x = [(i, f"g{j}", int(m[i, j])) for i in range(n) for j in range(g) if m[i, j]]
    seeds = [(i, "abc"[truth[i]]) for i in range(18)] + [(30, None), (31, "Unknown")]
    cf = CountFrame(spark.createDataFrame(x, "cell_id long, gene_id string, n long"), spark.createDataFrame([(i,) for i in range(n)], "cell_id long"))
    return cf, spark.createDataFrame(seeds, "cell_id long, label string"), m[:, m.sum(axis=0) > 0], truth, seeds[:18]


def plain(m, seeds, rounds, alpha=1.0):
    r = np.zeros((len(m), 3))
    for i, c in seeds:
        r[i, "abc".index(c)] = 1
    free = np.setdiff1d(np.arange(len(m)), [i for i, _ in seeds])
    out = []
    for _ in range(rounds):
        share = r.sum(axis=0) / r.sum()
        c = r.T @ m
        phi = np.log((c + alpha) / (c.sum(axis=1) + alpha * m.shape[1])[:, None])
        score = np.log(share) + m @ phi.T
        e = np.exp(score - score.max(axis=1)[:, None])
        r[free] = (e / e.sum(axis=1)[:, None])[free]
        like = score.max(axis=1) + np.log(e.sum(axis=1))
        out.append(like[free].sum() + sum(score[i, "abc".index(c)] for i, c in seeds) + alpha * phi.sum())
    return r, out


def test_rounds_equal_numpy_and_raise_the_objective(spark):
    cf, seeds, m, truth, given = drawn(spark)
    for rounds in (1, 4):
        got = mixture.em_annotate(cf, seeds, rounds, sparse=0.0)
        want, objective = plain(m, given, rounds)
        assert np.allclose(got.objective, objective) and all(np.diff(got.objective) > -1e-9)
        p = np.zeros_like(want)
        for r in got.probs.collect():
            p[r.cell_id, "abc".index(r.label)] = r.p
        assert np.allclose(p, want)
    assert (want.argmax(axis=1) == truth).mean() > 0.9
    sparse = mixture.em_annotate(cf, seeds, 2, sparse=1e-3).probs
    total = {r.cell_id: r["sum(p)"] for r in sparse.groupBy("cell_id").sum("p").collect()}
    assert len(total) == 160 and all(abs(v - 1) < 1e-9 for v in total.values()) and sparse.count() < 160 * 3
    assert mixture.em_annotate(cf, seeds.limit(0), 2).probs.count() == 0
