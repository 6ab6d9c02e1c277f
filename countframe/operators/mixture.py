"""Semi-supervised multinomial mixture on long triples (M7).

A model that learns from unlabelled counts: every class draws a cell's counts
from one distribution over genes; labelled cells are clamped to their class,
the others get responsibilities.  Rounds of expectation-maximisation start
from the labelled cells alone.

M step: class shares from summed responsibilities, phi = (counts of the class
in the gene + ALPHA) / (all counts of the class + ALPHA * genes).  E step:
log share + sum of n log phi per cell and class, then the soft-max.  Only
(class, gene) pairs that occur are stored; all others have the class's own
default, which enters through the cell's total.  Responsibilities below
``SPARSE`` are dropped and the rest of the cell's is scaled up, so a cell holds
the classes that matter.

The objective is the log likelihood plus ALPHA * sum log phi (the prior that
the smoothing stands for); with ``SPARSE`` = 0 no round lowers it.

Scale: two joins (by gene and by cell) and aggregations a round, rows about
entries x classes a cell holds; partial aggregation absorbs frequent genes
and large classes.  The parameter table has at most classes x genes rows and
is broadcast only by Spark's own size rule; class totals (one row a class,
at most MAX_CLASSES) are collected.  Responsibilities are written once a round.
Cases: cells without counts get the class shares; an unlabelled or unknown
seed is no seed; without seeds there are no classes and no result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN, CountFrame
from countframe.session import cut_lineage

ALPHA = 1.0
SPARSE = 1e-9
MAX_CLASSES = 10_000


@dataclass
class Mixture:
    probs: DataFrame                                   # (cell_id, label, p), all cells
    shares: dict                                       # class -> share
    phi: DataFrame                                     # (label, gene_id, log_phi), pairs that occur
    objective: list[float] = field(default_factory=list)


def _class_table(spark, rows: list[tuple]) -> DataFrame:
    """Per class: log share and log phi of a gene that it does not have."""
    return F.broadcast(spark.createDataFrame(rows, "label string, log_share double, log_default double"))     # at most MAX_CLASSES rows


def maximise(x: DataFrame, resp: DataFrame, n_genes: int, alpha: float):
    """(classes [(label, log share, log default)], phi) from (cell_id, label, p)."""
    weight = {r["label"]: r["w"] for r in resp.groupBy("label").agg(F.sum("p").alias("w")).limit(MAX_CLASSES + 1).collect()}
    if len(weight) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    counts = cut_lineage(x.join(resp, "cell_id").groupBy("label", "gene_id").agg(F.sum(F.col("p") * F.col("n")).alias("c")))
    total = {r["label"]: r["t"] for r in counts.groupBy("label").agg(F.sum("c").alias("t")).collect()}
    every = sum(weight.values())
    spark = x.sparkSession
    rows = [(k, weight[k] / every, total.get(k, 0.0) + alpha * n_genes) for k in sorted(weight)]
    size = F.broadcast(spark.createDataFrame(rows, "label string, share double, size double"))
    phi = counts.join(size, "label").select("label", "gene_id", F.log((F.col("c") + alpha) / F.col("size")).alias("log_phi"))
    classes = spark.createDataFrame(rows, "label string, share double, size double").select(
        "label", F.log("share").alias("log_share"), F.log(F.lit(alpha) / F.col("size")).alias("log_default"))
    return [tuple(r) for r in classes.collect()], phi


def expect(x: DataFrame, cells: DataFrame, classes: list[tuple], phi: DataFrame, sparse: float) -> DataFrame:
    """(cell_id, label, score, most, p) of every class a cell keeps; the
    log likelihood of a cell is most + log(sum exp(score - most))."""
    spark = x.sparkSession
    table = _class_table(spark, classes)
    gain = phi.join(table, "label").select("gene_id", "label", (F.col("log_phi") - F.col("log_default")).alias("gain"))
    seen = x.join(cells.select("cell_id"), "cell_id").join(gain, "gene_id").groupBy("cell_id", "label").agg(F.sum(F.col("n") * F.col("gain")).alias("s"))
    total = x.groupBy("cell_id").agg(F.sum("n").alias("t"))
    each = spark.createDataFrame([([r[0] for r in classes],)], "every array<string>").select("every").scalar()
    grid = cells.select("cell_id").join(total, "cell_id", "left").select("cell_id", F.coalesce("t", F.lit(0)).alias("t"), F.explode(each).alias("label"))
    score = grid.join(table, "label").join(seen, ["cell_id", "label"], "left").select(
        "cell_id", "label", (F.col("log_share") + F.col("t") * F.col("log_default") + F.coalesce("s", F.lit(0.0))).alias("score"))
    row = score.groupBy("cell_id").agg(F.collect_list(F.struct("label", "score")).alias("e"), F.max("score").alias("most"))
    row = row.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, e: a + F.exp(e["score"] - F.col("most"))))
    p = F.transform("e", lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"), (F.exp(e["score"] - F.col("most")) / F.col("sum")).alias("p")))
    row = row.select("cell_id", "most", "sum", F.filter(p, lambda e: e["p"] >= sparse).alias("e"))
    row = row.withColumn("kept", F.aggregate("e", F.lit(0.0), lambda a, e: a + e["p"]))
    return row.select("cell_id", (F.col("most") + F.log("sum")).alias("likelihood"), "kept", F.explode("e").alias("e")).select(
        "cell_id", "likelihood", F.col("e.label").alias("label"), F.col("e.score").alias("score"), (F.col("e.p") / F.col("kept")).alias("p"))


def em_annotate(cf: CountFrame, seeds: DataFrame, rounds: int = 5, alpha: float = ALPHA, sparse: float = SPARSE) -> Mixture:
    """``seeds`` (cell_id, label).  ``objective`` holds its value before the
    first and after every further round of both steps."""
    spark = cf.x.sparkSession
    x = cut_lineage(cf.x.select("cell_id", "gene_id", F.col(cf.value_col).cast("double").alias("n")))
    seeds = cut_lineage(seeds.where(F.col("label").isNotNull() & (F.col("label") != UNKNOWN)).select("cell_id", F.col("label").cast("string").alias("label")))
    if seeds.isEmpty():
        return Mixture(spark.createDataFrame([], "cell_id long, label string, p double"), {}, spark.createDataFrame([], "label string, gene_id string, log_phi double"))
    n_genes = x.select("gene_id").distinct().count()
    clamped = seeds.select("cell_id", "label", F.lit(1.0).alias("p"))
    free = cut_lineage(cf.obs.select("cell_id").join(seeds, "cell_id", "left_anti"))
    classes, phi = maximise(x, clamped, n_genes, alpha)
    objective = []
    for nth in range(rounds):
        if nth:
            classes, phi = maximise(x, clamped.unionByName(soft.select("cell_id", "label", "p")), n_genes, alpha)
        phi = cut_lineage(phi)
        soft = cut_lineage(expect(x, free, classes, phi, sparse))
        objective.append(_objective(x, seeds, soft, classes, phi, n_genes, alpha))
    probs = clamped.unionByName(soft.select("cell_id", "label", "p"))
    return Mixture(probs, {k: s for k, s, _ in classes}, phi, objective)


def _objective(x: DataFrame, seeds: DataFrame, soft: DataFrame, classes: list[tuple], phi: DataFrame, n_genes: int, alpha: float) -> float:
    """Log likelihood of the cells with their seeds, plus the prior's term."""
    table = _class_table(x.sparkSession, classes)
    unlabelled = soft.groupBy("cell_id").agg(F.first("likelihood").alias("v")).agg(F.sum("v")).first()[0] or 0.0
    given = (x.join(seeds, "cell_id").join(phi, ["label", "gene_id"], "left").join(table, "label")
             .agg(F.sum(F.col("n") * F.coalesce("log_phi", "log_default"))).first()[0] or 0.0)
    share = seeds.join(table, "label").agg(F.sum("log_share")).first()[0] or 0.0
    stored = phi.groupBy("label").agg(F.sum("log_phi").alias("s"), F.count(F.lit(1)).alias("n"))
    prior = table.join(stored, "label", "left").agg(F.sum(F.coalesce("s", F.lit(0.0)) + (n_genes - F.coalesce("n", F.lit(0))) * F.col("log_default"))).first()[0]
    return unlabelled + given + share + alpha * prior
