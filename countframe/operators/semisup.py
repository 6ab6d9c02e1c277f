"""Semi-supervised annotation by label propagation on a kNN graph (M7, M8,
M10): labelled rows are clamped to their label, every other row takes the
weight-averaged class distribution of its neighbours, until nothing
moves or a bound on the rounds (Zhu & Ghahramani 2002).  Probabilities are kept long and sparse:
(cell_id, label, p), only non-zero classes stored.

Seeds never move, so what they give their neighbours is summed once.  Each
round is one join of the edges between rows without seed (written once) with
their current probabilities, which can be split at hub nodes, and one
aggregation; lineage is cut, and convergence tested, every few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN
from countframe.operators.evaluate import argmax_label
from countframe.session import cut_lineage

ROUNDS = 10
CHECKPOINT_EVERY = 4
TOL = 1e-4


def edge_weights(graph: DataFrame) -> DataFrame:
    """w = 1 / (1 + dist) on (src, dst, dist) edges."""
    return graph.select("src", "dst", (1.0 / (1.0 + F.col("dist"))).alias("w"))


def seed_probs(obs: DataFrame, label: str) -> DataFrame:
    """Clamped one-hot rows for the labelled cells."""
    return obs.where(F.col(label).isNotNull()).select("cell_id", F.col(label).alias("label"),
                                                        F.lit(1.0).alias("p"))


def shares(sums: DataFrame) -> DataFrame:
    """(cell_id, label, _s) -> (cell_id, label, p), summing to 1 per cell."""
    return sums.select("cell_id", "label", (F.col("_s") / F.sum("_s").over(Window.partitionBy("cell_id"))).alias("p"))


def pull(edges: DataFrame, probs: DataFrame) -> DataFrame:
    """(cell_id, label, _s): what each neighbour in ``probs`` gives a cell."""
    return (edges.join(probs.withColumnRenamed("cell_id", "dst"), "dst")
            .select(F.col("src").alias("cell_id"), "label", (F.col("w") * F.col("p")).alias("_s")))


def added(parts: DataFrame) -> DataFrame:
    """(cell_id, label, _s) summed.  A cell has at most k edges, so it is dealt
    out by cell: the shares and the next round's join then need no shuffle."""
    return parts.repartition("cell_id").groupBy("cell_id", "label").agg(F.sum("_s").alias("_s"))


def propagate_step(edges: DataFrame, free: DataFrame, fixed: DataFrame) -> DataFrame:
    """One round of the rows without seed: ``fixed`` (cell_id, label, _s) comes
    from seeds and stays, ``free`` are the rows' probabilities."""
    return shares(added(fixed.unionByName(pull(edges, free))))


def propagate_labels(graph: DataFrame, obs: DataFrame, label: str = "label_seed", rounds: int = ROUNDS,
                     checkpoint_every: int = CHECKPOINT_EVERY, tol: float = TOL) -> DataFrame:
    """M7. (cell_id, label, p) after ``rounds`` rounds, or earlier once no
    probability moved by more than ``tol`` in a round.  ``obs`` holds the
    seed label (NULL = unlabelled).  A row that no seed reaches has no entry
    here; ``annotate`` gives it 'Unknown'.  The graph is computed once.

    A seed keeps its label, so edges that leave one are not needed, and what
    seeds give their neighbours is summed once; the rounds only move the rows
    without seed, along the edges between them."""
    seeds = cut_lineage(seed_probs(obs, label))
    if rounds < 1:
        return seeds
    seeded = seeds.select("cell_id").distinct()
    edges = cut_lineage(edge_weights(graph).join(seeded.withColumnRenamed("cell_id", "src"), "src", "left_anti"))
    fixed = cut_lineage(added(pull(edges, seeds)))
    between = cut_lineage(edges.join(seeded.withColumnRenamed("cell_id", "dst"), "dst", "left_anti"))
    free = shares(fixed)
    for r in range(2, rounds + 1):
        tested = r % checkpoint_every == 0 and r < rounds
        if tested:
            free = cut_lineage(free)
        new = propagate_step(between, free, fixed)
        if tested:
            new = cut_lineage(new)
            both = new.join(free.withColumnRenamed("p", "_old"), ["cell_id", "label"], "full_outer")
            moved = both.select(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))))).first()[0]
            if (moved or 0.0) <= tol:
                return new.unionByName(seeds)
        free = new
    return free.unionByName(seeds)


def annotate(probs: DataFrame, obs: DataFrame) -> DataFrame:
    """M8 + M9. Every row of ``obs`` with its hard label (ties ->
    alphabetical) and confidence; rows without a class get 'Unknown', 0."""
    hard = argmax_label(probs, cls="label", p="p")
    return obs.select("cell_id").join(hard, "cell_id", "left").select(
        "cell_id", F.coalesce(F.col("pred").cast("string"), F.lit(UNKNOWN)).alias("pred"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def annotate_from_latent(spark, latent_path: str, obs: DataFrame, label: str = "label_seed",
                         space: str = "nb", k: int = 15, rounds: int = ROUNDS) -> DataFrame:
    """M10. Warm start: the second model starts from an embedding stored by
    the first one (S4) instead of refitting it: read the stored latent,
    build its kNN graph and propagate the seed labels over it."""
    from countframe.operators.neighbors import neighbors
    from countframe.sources.io import read_latent

    latent = read_latent(spark, latent_path, space)
    return propagate_labels(neighbors(latent, k), obs, label, rounds=rounds)
