"""Dispersion per gene of the negative-binomial count model.

Counts y of a cell with total t in batch b have mean mu = t * g_b / T_b (the
gene's and all counts of the batch) and variance mu + mu^2 / theta, with one
theta a gene.  For given means the likelihood depends on the data only through
aggregates: how many cells of a batch have which total, the gene's counts
summed over those, and how often each count occurs.  Spark makes these in a
few aggregations; each gene is then one row, and all genes are fitted at once,
each by Newton steps on log(theta) that are halved until the likelihood rises,
from the method-of-moments start theta = sum mu^2 / (sum (y - mu)^2 - sum mu).

Absent entries are zeros and count through the cells' totals; no dense matrix
is made.  The table of distinct (batch, total) is broadcast; its size is
checked against MAX_TOTALS (a ValueError beyond).  A gene's row has at most
as many entries.  Genes that vary less than Poisson end at MAX_THETA.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.session import cut_lineage, ship_library

MIN_THETA, MAX_THETA = 1e-3, 1e6
MAX_TOTALS = 2_000_000
MAX_STEPS = 60
LOW_COUNTS = 4096        # counts up to here are summed one by one, the rest by an asymptotic series
_FIT = "gene_id string, start double, theta double, gain double, steps int, rising boolean"


class Likelihood:
    """Log likelihood of one gene as a function of theta, and two derivatives.

    ``mu`` and ``cells``: distinct means and their numbers of cells; ``y_mu``
    and ``y_sum``: means of the gene's entries and the counts summed over
    them; ``y`` and ``times``: distinct counts and how often they occur."""

    def __init__(self, mu, cells, y_mu, y_sum, y, times):
        self.mu, self.cells, self.y_mu, self.y_sum = mu, cells, y_mu, y_sum
        low = np.minimum(y, LOW_COUNTS).astype(np.int64)
        # how many entries have more than k counts
        self.over = np.bincount(low, weights=times, minlength=1)[::-1].cumsum()[::-1][1:]
        self.k = np.arange(len(self.over), dtype=float)
        self.high, self.high_times = y[y > LOW_COUNTS].astype(float), times[y > LOW_COUNTS]

    def at(self, theta: float) -> tuple[float, float, float]:
        x, r = theta + self.k, theta + self.mu
        s = theta + self.y_mu
        value = (self.over * np.log(x)).sum() - theta * (self.cells * np.log1p(self.mu / theta)).sum() - (self.y_sum * np.log(s)).sum()
        first = (self.over / x).sum() - (self.cells * (np.log1p(self.mu / theta) - self.mu / r)).sum() - (self.y_sum / s).sum()
        second = -(self.over / x ** 2).sum() + (self.cells * self.mu ** 2 / (theta * r ** 2)).sum() + (self.y_sum / s ** 2).sum()
        if len(self.high):
            a, b = theta + self.high, theta + LOW_COUNTS
            gamma = lambda z: (z - 0.5) * np.log(z) - z + 1 / (12 * z)
            psi = lambda z: np.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2)
            psi1 = lambda z: 1 / z + 1 / (2 * z ** 2) + 1 / (6 * z ** 3)
            value += (self.high_times * (gamma(a) - gamma(b))).sum()
            first += (self.high_times * (psi(a) - psi(b))).sum()
            second += (self.high_times * (psi1(a) - psi1(b))).sum()
        return value, first, second


def newton(likelihood: Likelihood, start: float) -> tuple[float, list[float]]:
    """(theta, log likelihoods of the start and after every step)."""
    theta = min(max(start, MIN_THETA), MAX_THETA)
    value, first, second = likelihood.at(theta)
    values = [value]
    for _ in range(MAX_STEPS):
        slope, bend = theta * first, theta * theta * second + theta * first          # by log(theta)
        move = -slope / bend if bend < 0 else np.sign(slope)
        move = min(max(move, -2.0), 2.0)
        while abs(move) > 1e-9:
            new = min(max(theta * np.exp(move), MIN_THETA), MAX_THETA)
            found = likelihood.at(new)
            if found[0] > value:
                break
            move /= 2
        else:
            break
        theta, (value, first, second) = new, found
        values.append(value)
    return theta, values


def _parts(cf: CountFrame, genes: DataFrame, batch: str):
    """(cells by batch and total, entries with batch, total and n, gene and
    batch sums)."""
    vc = cf.value_col
    totals = cf.x.groupBy("cell_id").agg(F.sum(vc).cast("double").alias("total"))
    cells = cut_lineage(cf.obs.select("cell_id", F.col(batch).alias("batch")).join(totals, "cell_id").where("total > 0"))
    hist = cells.groupBy("batch", "total").agg(F.count(F.lit(1)).alias("cells"))
    entry = cut_lineage(cf.x.join(F.broadcast(genes.select("gene_id")), "gene_id").join(cells, "cell_id")       # the selected axis
                        .select("gene_id", "batch", "total", F.col(vc).cast("bigint").alias("y")).where("y > 0"))
    every = cells.groupBy("batch").agg(F.sum("total").alias("t"))
    share = entry.groupBy("gene_id", "batch").agg(F.sum("y").cast("double").alias("g")).join(F.broadcast(every), "batch").select(
        "gene_id", "batch", (F.col("g") / F.col("t")).alias("p"))
    return hist, entry, cut_lineage(share)


def dispersion_start(cf: CountFrame, genes: DataFrame, batch: str = "batch") -> DataFrame:
    """(gene_id, theta): the method-of-moments start.  The sums over all
    cells, zeros included, follow from the entries and the batches' moments."""
    hist, entry, share = _parts(cf, genes, batch)
    return _start(hist, entry, share, genes)


def _start(hist: DataFrame, entry: DataFrame, share: DataFrame, genes: DataFrame) -> DataFrame:
    moment = hist.groupBy("batch").agg(F.sum(F.col("cells") * F.col("total")).alias("t1"), F.sum(F.col("cells") * F.col("total") * F.col("total")).alias("t2"))
    by_batch = entry.groupBy("gene_id", "batch").agg(F.sum(F.col("y") * F.col("y")).cast("double").alias("yy"), F.sum(F.col("y") * F.col("total")).alias("yt"))
    met = share.join(by_batch, ["gene_id", "batch"]).join(F.broadcast(moment), "batch")             # a row a batch
    sums = met.groupBy("gene_id").agg(
        F.sum(F.col("p") * F.col("p") * F.col("t2")).alias("mm"), F.sum(F.col("p") * F.col("t1")).alias("m"),
        F.sum(F.col("yy") - 2 * F.col("p") * F.col("yt") + F.col("p") * F.col("p") * F.col("t2")).alias("rss"))
    over = F.col("rss") - F.col("m")
    theta = F.when(over > 0, F.greatest(F.least(F.col("mm") / over, F.lit(MAX_THETA)), F.lit(MIN_THETA))).otherwise(MAX_THETA)
    return genes.select("gene_id").join(sums.select("gene_id", theta.alias("theta")), "gene_id", "left").select(
        "gene_id", F.coalesce("theta", F.lit(MAX_THETA)).alias("theta"))


def nb_dispersion(cf: CountFrame, genes: DataFrame, batch: str = "batch") -> DataFrame:
    """(gene_id, start, theta, gain, steps, rising): the maximum-likelihood
    dispersion, what the log likelihood gained over the start, and whether it
    rose with every step.  A gene without counts stays at MAX_THETA."""
    spark = cf.x.sparkSession
    ship_library(spark)
    hist, entry, share = _parts(cf, genes, batch)
    start = _start(hist, entry, share, genes)
    hist = cut_lineage(hist)
    if hist.count() > MAX_TOTALS:
        raise ValueError(f"more than {MAX_TOTALS} different cell totals")
    known = hist.toPandas()
    shared = spark.sparkContext.broadcast({b: (d["total"].to_numpy(), d["cells"].to_numpy(float)) for b, d in known.groupby("batch", dropna=False)})
    # a batch that is null meets nothing in a join: its cells are left out on all sides
    places = entry.groupBy("gene_id", "batch", "total").agg(F.sum("y").alias("s")).groupBy("gene_id", "batch").agg(
        F.collect_list("total").alias("total"), F.collect_list("s").alias("s"))
    by_gene = share.join(places, ["gene_id", "batch"]).groupBy("gene_id").agg(F.collect_list(F.struct("batch", "p", "total", "s")).alias("batches"))
    counts = entry.groupBy("gene_id", "y").count().groupBy("gene_id").agg(F.collect_list("y").alias("y"), F.collect_list("count").alias("times"))

    def fit(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                mu, cells, y_mu, y_sum = [], [], [], []
                for part in r.batches:
                    total, number = shared.value[part["batch"]]
                    mu.append(part["p"] * total)
                    cells.append(number)
                    y_mu.append(part["p"] * np.asarray(part["total"], float))
                    y_sum.append(np.asarray(part["s"], float))
                of = Likelihood(*map(np.concatenate, (mu, cells, y_mu, y_sum)), np.asarray(r.y), np.asarray(r.times, float))
                theta, values = newton(of, r.start)
                rows.append((r.gene_id, r.start, theta, values[-1] - values[0], len(values) - 1, all(np.diff(values) > 0)))
            yield pd.DataFrame(rows, columns=["gene_id", "start", "theta", "gain", "steps", "rising"])

    ready = start.withColumnRenamed("theta", "start").join(by_gene, "gene_id").join(counts, "gene_id")
    found = ready.mapInPandas(fit, _FIT)
    empty = start.join(by_gene, "gene_id", "left_anti").select("gene_id", F.col("theta").alias("start"), "theta", F.lit(0.0).alias("gain"),
                                                               F.lit(0).alias("steps"), F.lit(True).alias("rising"))
    return found.unionByName(empty)
