"""Evaluation: accuracy, weighted F1, confusion, one-vs-rest ROC/AUC, model
comparison (E1-E8, J7), plus argmax/confidence over class scores (P8, P10,
M9).

ROC curves run cumulative sums over a whole class.  A class may hold a
third of all rows, so the curve is computed in two levels: scores are first
pre-aggregated per distinct value, then cut into buckets of about equally
many distinct scores (approximate quantiles); bucket totals get a running sum over at most ``n_buckets`` rows per class,
and rows only cumulate inside their own (class, bucket) window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN
from countframe.functions.hashing import round_half_up, safe_div
from countframe.operators.summary import crosstab
from countframe.session import cut_lineage

N_BUCKETS = 256


def with_truth(preds: DataFrame, obs: DataFrame, truth: str = "label_truth") -> DataFrame:
    """J7. Attach the true label to predictions by key."""
    return preds.join(obs.select("cell_id", F.col(truth).alias("truth")), "cell_id")


def accuracy(df: DataFrame, y: str = "truth", p: str = "pred") -> DataFrame:
    """E1. (n, accuracy)."""
    hit = F.coalesce(F.col(y) == F.col(p), F.lit(False)).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def class_counts(df: DataFrame, y: str = "truth", p: str = "pred") -> DataFrame:
    """(class, support, n_pred, tp) for every class seen as truth or prediction."""
    t = df.groupBy(F.col(y).alias("class")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(y) == F.col(p)).alias("tp"))
    q = df.groupBy(F.col(p).alias("class")).agg(F.count(F.lit(1)).alias("n_pred"))
    j = t.join(q, "class", "full")
    return j.select("class", F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("tp", F.lit(0)).alias("tp"))


def per_class_f1(df: DataFrame, y: str = "truth", p: str = "pred") -> DataFrame:
    """Precision, recall, F1 per class with zero_division = 0."""
    c = class_counts(df, y, p)
    prec = F.coalesce(safe_div(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(safe_div(F.col("tp"), F.col("support")), F.lit(0.0))
    # F1 = 2 tp / (support + n_pred); 0 when both are 0
    f1 = F.coalesce(safe_div(2 * F.col("tp"), F.col("support") + F.col("n_pred")), F.lit(0.0))
    return c.select("class", "support", "n_pred", "tp", prec.alias("precision"), rec.alias("recall"),
                    f1.alias("f1"))


def weighted_f1(df: DataFrame, y: str = "truth", p: str = "pred") -> DataFrame:
    """E2. Support-weighted mean of per-class F1 (zero_division = 0)."""
    pc = per_class_f1(df, y, p)
    return pc.agg(safe_div(F.sum(F.col("support") * F.col("f1")), F.sum("support")).alias("weighted_f1"))


def metrics(df: DataFrame, y: str = "truth", p: str = "pred") -> DataFrame:
    """E1 + E2 in one row: (n, accuracy, weighted_f1)."""
    acc = accuracy(df, y, p)
    f1 = weighted_f1(df, y, p).select(F.col("weighted_f1")).scalar()
    return acc.select("n", "accuracy", f1.alias("weighted_f1"))


def confusion(df: DataFrame, y: str = "truth", p: str = "pred", normalize: bool = True,
              digits: int = 6) -> DataFrame:
    """E3. (truth, pred, n[, frac]) for every true label x predicted label,
    zero-filled; ``frac`` is row-normalised (each true label sums to 1)."""
    ct = crosstab(df.select(F.col(y).alias("truth"), F.col(p).alias("pred")), "truth", "pred")
    if not normalize:
        return ct
    frac = safe_div(F.col("n"), F.sum("n").over(Window.partitionBy("truth")))
    return ct.withColumn("frac", round_half_up(frac, digits))


def binarize(df: DataFrame, classes: list[str], y: str = "truth") -> DataFrame:
    """E4. One-vs-rest indicators (cell_id, class, y_bin) for a short class
    list; every row expands the list locally."""
    cls = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    return df.select("cell_id", y, cls).select(
        "cell_id", "class", (F.col(y) == F.col("class")).cast("int").alias("y_bin"))


def roc_table(scores: DataFrame, cls: str = "class", truth: str = "truth", score: str = "score",
              n_buckets: int = N_BUCKETS) -> DataFrame:
    """E5 core. One row per (class, distinct score), highest score first:
    pos, neg at that score; tps, fps = positives/negatives scoring >= it;
    P, N = class totals.  Classes without positives are dropped."""
    s = scores.select(cls, score, (F.col(truth) == F.col(cls)).cast("long").alias("_pos"))
    agg = s.groupBy(cls, score).agg(F.sum("_pos").alias("pos"),
                                    (F.count(F.lit(1)) - F.sum("_pos")).alias("neg"))
    tot = (agg.groupBy(cls).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                F.min(score).alias("_lo"), F.max(score).alias("_hi"))
           .where(F.col("P") > 0))
    agg = cut_lineage(agg.join(tot, cls).drop("_lo", "_hi"))
    # buckets are ranges of distinct scores of about equal row counts: quantiles
    # of all distinct scores, so scores piled up near 0 and 1 spread out
    cuts = sorted(set(agg.approxQuantile(score, [i / n_buckets for i in range(1, n_buckets)], 0.25 / n_buckets)))
    agg = agg.withColumn("_b", -F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(score))) if cuts else F.lit(0))
    buckets = agg.groupBy(cls, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    before = Window.partitionBy(cls).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(cls, "_b", F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_op"),
                             F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_on"))
    agg = agg.join(buckets, [cls, "_b"])
    within = Window.partitionBy(cls, "_b").orderBy(F.col(score).desc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return agg.select(cls, score, "pos", "neg", "P", "N",
                      (F.col("_op") + F.sum("pos").over(within)).alias("tps"),
                      (F.col("_on") + F.sum("neg").over(within)).alias("fps"))


def roc_points(scores: DataFrame, digits: int = 6, **kw) -> DataFrame:
    """E5. (class, threshold, tps, fps, tpr, fpr) at every distinct score, and
    each curve's origin: threshold +inf, nothing predicted positive."""
    t = roc_table(scores, **kw)
    cls = kw.get("cls", "class")
    score = kw.get("score", "score")
    origin = t.select(cls, "P", "N").distinct().select(
        cls, F.lit(float("inf")).alias(score), "P", "N", F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"))
    t = t.select(cls, score, "P", "N", "tps", "fps").unionByName(origin)
    return t.select(cls, F.col(score).alias("threshold"), "tps", "fps",
                    round_half_up(safe_div(F.col("tps"), F.col("P")), digits).alias("tpr"),
                    round_half_up(safe_div(F.col("fps"), F.col("N")), digits).alias("fpr"))


def roc_auc(scores: DataFrame, digits: int = 6, **kw) -> DataFrame:
    """E6. Per class AUC = P(score_pos > score_neg) + 0.5 P(tie): the
    Mann-Whitney statistic with average ranks, from the same table."""
    t = roc_table(scores, **kw)
    cls = kw.get("cls", "class")
    below = F.col("N") - F.col("fps")  # negatives scoring strictly lower
    contrib = F.col("pos") * (below + 0.5 * F.col("neg"))
    return t.groupBy(cls).agg(
        round_half_up(safe_div(F.sum(contrib), F.first("P") * F.first("N")), digits).alias("auc"))


def argmax_label(probs: DataFrame, cls: str = "class", p: str = "score", key: str = "cell_id",
                 digits: int = 9) -> DataFrame:
    """P10 + M9. Per row the class of highest probability (ties -> first in
    alphabetical order) and that probability as confidence.  An aggregate
    over the (bounded) classes of each row; no sort."""
    pr = round_half_up(p, digits)
    return probs.groupBy(key).agg(
        F.min_by(F.col(cls), F.struct(-pr, F.col(cls))).alias("pred"),
        F.max(p).alias("confidence"))


def attach_predictions(obs: DataFrame, preds: DataFrame, name: str = "pred") -> DataFrame:
    """P8. Every row gets 'Unknown' unless it has a prediction."""
    return obs.join(preds.select("cell_id", F.col("pred").alias("_p")), "cell_id", "left") \
        .withColumn(name, F.coalesce(F.col("_p").cast("string"), F.lit(UNKNOWN))).drop("_p")


def results_table(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """E7. Stack one-row metric frames under a model name."""
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("model"), *df.columns)
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_query(preds: DataFrame, obs: DataFrame, truth: str = "label_truth") -> DataFrame:
    """E8. Metrics when the second dataset has labels, else prediction counts."""
    if truth in obs.columns:
        return metrics(with_truth(preds, obs, truth))
    return preds.groupBy("pred").agg(F.count(F.lit(1)).alias("n"))

