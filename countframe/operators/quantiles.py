"""Exact quantiles per group in bounded memory.

Distributed selection: a group's values are cut at edges taken from a bounded
sketch, the ranges are counted, only the range that holds a wanted rank goes
on and is cut again.  A range whose values are all equal, or that holds at
most ``few`` values, ends the search.  Edges only speed it up: counts are
exact, and a value equal to an edge is a range of its own, so every round
shrinks every open range, whatever the values are.

No task ever holds a group's values or a map of them: the sketch keeps about
``SKETCH`` samples a group, counts are partially aggregated, and at most
``few`` values of a range come together.  Rounds grow with the logarithm of
the largest group (the first cuts it to some thousandths, each later one by
about ``GRID``); the values still searched are written once a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.session import cut_lineage

FEW = 10_000             # values of one range that are sorted together
GRID = 16
SKETCH = 10_000
NEAR = 1e-3              # first cuts, as shares of a group beside each quantile


def _met(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names, nulls included; the names of ``a`` stay."""
    key = [f"__met{i}" for i in range(len(names))]
    b = b.select(*[F.col(c).alias(k) for c, k in zip(names, key)], *[c for c in b.columns if c not in names])
    return a.join(b, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(names, key)]), how).drop(*key)


def ranked(rows: DataFrame, group: list[str], ranks: DataFrame, first_cuts: Sequence[float], few: int = FEW) -> DataFrame:
    """(group..., rank, value): the values at 0-based ``ranks`` (group...,
    rank) among the non-null ``v`` of each group of ``rows``, which are read
    several times."""
    cell = [*group, "path"]
    rows = rows.select(*group, F.lit("").alias("path"), "v")
    size = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    sizes = rows.groupBy(*cell).agg(*size)
    want = cut_lineage(_met(ranks.select(*group, "rank", F.col("rank").alias("r")), sizes, group))
    cuts, found = list(first_cuts), []
    while True:
        at_edge = (F.col("r") == 0) | (F.col("r") == F.col("n") - 1) | (F.col("lo") == F.col("hi"))
        found.append(want.where(at_edge).select(*group, "rank", F.when(F.col("r") == 0, F.col("lo")).otherwise(F.col("hi")).alias("value")))
        inside = want.where(~at_edge)
        small = inside.where(F.col("n") <= few)
        values = _met(rows, small.select(*cell).distinct(), cell, "left_semi").groupBy(*cell).agg(F.sort_array(F.collect_list("v")).alias("all"))
        found.append(_met(small, values, cell).select(*group, "rank", F.get("all", F.col("r").cast("int")).alias("value")))
        large = inside.where(F.col("n") > few)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        part = _met(rows, large.select(*cell).distinct(), cell, "left_semi")
        shares = F.array(*[F.lit(float(c)) for c in cuts])
        edges = part.groupBy(*cell).agg(F.percentile_approx("v", shares, SKETCH).alias("edges"))
        edge = [F.get("edges", i) for i in range(len(cuts))]
        piece = reduce(Column.__add__, [(F.col("v") >= e).cast("int") + (F.col("v") > e).cast("int") for e in edge])
        binned = _met(part, edges, cell).select(*cell, piece.alias("bin"), "v")
        pieces = cut_lineage(binned.groupBy(*cell, "bin").agg(*size))               # at most 2 len(cuts) + 1 a range
        before = F.sum("n").over(Window.partitionBy(*cell).orderBy("bin")) - F.col("n")
        pieces = pieces.withColumn("before", before)
        into = _met(large.drop("n", "lo", "hi"), pieces, cell).where((F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("n")))
        path = F.concat_ws("/", "path", F.col("bin").cast("string")).alias("path")
        want = cut_lineage(into.select(*group, "rank", (F.col("r") - F.col("before")).alias("r"), path, "n", "lo", "hi"))
        rows = cut_lineage(_met(binned.select(*group, path, "v"), want.where("lo < hi").select(*cell).distinct(), cell, "left_semi"))
        cuts = [i / GRID for i in range(1, GRID)]


def exact_quantiles(df: DataFrame, by: Sequence[str], metrics: Sequence[str], shares: Sequence[float], few: int = FEW) -> DataFrame:
    """(by..., metric, share, value): exact quantiles with linear
    interpolation, as ``percentile`` gives them; null values do not count, a
    group without values has no row."""
    by = list(by)
    group = [f"__g{i}" for i in range(len(by))] + ["metric"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, group)], each).select(*group[:-1], "m.metric", "m.v").where("v IS NOT NULL")
    rows = cut_lineage(rows)
    largest = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    if largest <= few:                           # nothing to search: every group is sorted as it is
        sizes = rows.groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("all")).withColumn("n", F.size("all"))
        place = sizes.select(*group, "all", "n", share).withColumn("at", (F.col("n") - 1) * F.col("share"))
        value = lambda rank: F.get("all", rank.cast("int"))
        both = place.select(*group, "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"),
                            value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
        return _interpolated(both, by, group)
    n = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    place = cut_lineage(n.select(*group, "n", share).withColumn("at", (F.col("n") - 1) * F.col("share"))
                        .select(*group, "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high")))
    ranks = place.select(*group, F.explode(F.array("low", "high")).alias("rank")).distinct()
    inner = sorted({min(max(s + d, 0.0), 1.0) for s in shares if 0 < s < 1 for d in (-NEAR, NEAR)}) or [0.5]
    value = cut_lineage(ranked(rows, group, ranks, inner, few))
    low = _met(place, value.withColumnRenamed("rank", "low").withColumnRenamed("value", "a"), [*group, "low"])
    both = _met(low, value.withColumnRenamed("rank", "high").withColumnRenamed("value", "b"), [*group, "high"])
    return _interpolated(both, by, group)


def _interpolated(both: DataFrame, by: list[str], group: list[str]) -> DataFrame:
    mixed = F.when((F.col("low") == F.col("high")) | (F.col("a") == F.col("b")), F.col("a")).otherwise(
        (F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    return both.select(*[F.col(g).alias(b) for g, b in zip(group, by)], "metric", "share", mixed.alias("value"))
