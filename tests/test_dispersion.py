"""Negative-binomial dispersions: the dense likelihood, its steps and planted values."""

import math

import numpy as np

from countframe.frame import CountFrame
from countframe.operators import dispersion as dp


def dense(y, mu, theta):
    return sum(math.lgamma(a + theta) - math.lgamma(theta) + theta * math.log(theta / (theta + m)) - a * math.log(theta + m) for a, m in zip(y, mu))


def likelihood(y, mu):
    some = y > 0
    values, times = np.unique(y[some], return_counts=True)
    return dp.Likelihood(mu, np.ones(len(mu)), mu[some], y[some].astype(float), values, times.astype(float))


def test_likelihood_equals_the_dense_sum_and_its_slopes():
    draw = np.random.default_rng(5)
    mu = draw.gamma(2, 2, 300)
    for y in (draw.poisson(mu), draw.negative_binomial(0.7, 0.7 / (0.7 + mu)), draw.negative_binomial(0.5, 0.5 / (0.5 + 4000 * mu))):
        of = likelihood(y, mu)
        for theta in (0.01, 0.6, 3.0, 200.0):
            value, first, second = of.at(theta)
            h = theta * 1e-4
            assert abs(value - of.at(1.0)[0] - (dense(y, mu, theta) - dense(y, mu, 1.0))) < 1e-6 * max(1, abs(value))
            assert abs(first - (of.at(theta + h)[0] - of.at(theta - h)[0]) / (2 * h)) < 1e-4 * max(1, abs(first))
            assert abs(second - (of.at(theta + h)[1] - of.at(theta - h)[1]) / (2 * h)) < 1e-4 * max(1, abs(second))


def test_every_newton_step_rises_from_any_start():
    draw = np.random.default_rng(6)
    mu = draw.gamma(2, 2, 500)
    y = draw.negative_binomial(1.5, 1.5 / (1.5 + mu))
    ends = []
    for start in (1e-3, 0.1, 1.0, 50.0, 1e6):
        theta, values = dp.newton(likelihood(y, mu), start)
        assert all(np.diff(values) > 0) and len(values) < 40
        ends.append(theta)
    assert max(ends) - min(ends) < 1e-4 * min(ends) and 1.0 < ends[0] < 2.3


def test_planted_dispersions_come_back(spark):
    draw = np.random.default_rng(7)
    n, planted = 1500, {"a": 0.4, "b": 2.0, "c": 20.0, "p": 1e6}
    size = draw.uniform(0.5, 2, n)
    rows, obs = [], []
    for c in range(n):
        batch = "x" if c % 3 else "y"
        obs.append((c, batch))
        for g, theta in planted.items():
            mu = size[c] * (6.0 if batch == "x" else 3.0)
            k = int(draw.negative_binomial(theta, theta / (theta + mu)))
            if k:
                rows.append((c, g, k))
        rows.append((c, "rest", int(size[c] * 5000)))          # keeps totals near the size
    obs.append((n, "x"))                                       # a cell without counts
    cf = CountFrame(spark.createDataFrame(rows, "cell_id long, gene_id string, n long"), spark.createDataFrame(obs, "cell_id long, batch string"))
    genes = spark.createDataFrame([(g,) for g in [*planted, "never"]], "gene_id string")
    got = {r.gene_id: r for r in dp.nb_dispersion(cf, genes).collect()}
    assert all(r.rising and r.gain >= 0 for r in got.values()) and set(got) == {*planted, "never"}
    for g, theta in planted.items():
        assert got[g].theta > 50 if theta > 100 else abs(math.log(got[g].theta / theta)) < 0.35, (g, got[g])
    assert got["never"].theta == dp.MAX_THETA and sum(got[g].gain for g in planted) > 0.01
