"""Connected components of links between nodes, by hash-to-min with pointer
jumping: rounds grow with the logarithm of a component's diameter, each round
is joins and aggregations on nodes (partial aggregation absorbs hot nodes),
and lineage is cut after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.session import cut_lineage


def connect(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node of the component."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    now = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")))
    while True:
        # the smallest name among the neighbours, told to the own name too
        told = both.join(now.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").select("node", "c")
        best = told.groupBy("node").agg(F.min("c").alias("c")).join(now, "node").select(
            "node", "comp", F.least("c", "comp").alias("c"))
        names = best.groupBy(F.col("comp").alias("name")).agg(F.min("c").alias("c"))
        moved = best.join(names.select(F.col("name").alias("comp"), F.col("c").alias("d")), "comp").select(
            "node", F.col("comp").alias("was"), F.least("c", "d").alias("comp"))
        # one jump: take the name that the name itself has now
        moved = cut_lineage(moved)
        jump = moved.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        new = cut_lineage(moved.join(jump, "comp", "left").select("node", "was", F.coalesce("far", "comp").alias("comp")))
        if not new.where("comp <> was").limit(1).count():
            return new.select("node", "comp")
        now = new.select("node", "comp")
