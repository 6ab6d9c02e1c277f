"""Exact quantiles by distributed selection against percentile and numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from countframe.operators import quantiles, summary

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_every_round_equals_percentile(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.gauss(0, 1), 7.0, 10.0 ** draw.randrange(-200, 200), -0.5, None])) for _ in range(3000)]
    rows += [("hot", 2.0)] * 2000 + [("hot", 1.0), ("one", 5.0), ("none", None)] + [("low", 1.0)] * 400 + [("low", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {(r.g, s): q for r in df.groupBy("g").agg(F.percentile("v", SHARES).alias("q")).collect() if r.q is not None for s, q in zip(SHARES, r.q)}
    for few in (1, 50, 10_000):
        got = {(r.g, r.share): r.value for r in quantiles.exact_quantiles(df, ["g"], ["v"], SHARES, few).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-12 * abs(want[k]) for k in want), few


def test_one_group_of_millions_of_values(spark):
    n = 4_000_003
    df = spark.range(n).select(F.pmod(F.col("id") * 7_919, F.lit(n)).cast("double").alias("v"))       # every value once
    got = {r.share: r.value for r in quantiles.exact_quantiles(df, [], ["v"], [0.25, 0.5, 0.9], few=1000).collect()}
    assert got == {s: float(np.quantile(np.arange(n, dtype=float), s)) for s in (0.25, 0.5, 0.9)}
    row = summary.distribution(df, "v", few=1000).first()
    assert (row.n, row.q0, row.q50, row.q100) == (n, 0.0, (n - 1) / 2, float(n - 1))


def test_summaries_have_no_value_maps(spark):
    df = spark.createDataFrame([("x", 1.0, 4), ("x", 2.0, None), (None, 3.0, 5)], "b string, m double, k int")
    got = {r.b: r for r in summary.summarize(df, "b", ["m", "k"]).collect()}
    assert (got["x"].m_median, got["x"].k_median, got[None].m_median, got[None].m_std) == (1.5, 4.0, 3.0, None)
    plan = summary.distribution(df, ["m", "k"], "b")._jdf.queryExecution().toString()
    assert "percentile(" not in plan and {r.metric for r in summary.distribution(df, ["m", "k"], "b").collect()} == {"m", "k"}
    assert summary.distribution(df.limit(0), "m").count() == 0 and summary.summarize(df.limit(0), "b", ["m"]).count() == 0
