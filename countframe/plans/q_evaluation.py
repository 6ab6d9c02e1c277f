"""Evaluation queries on rule-made predictions and scores over the masked
rows of the documents matrix (E1-E6, P8, P10, M9, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from countframe.functions.hashing import round_half_up
from countframe.operators import evaluate, sampling, summary
from countframe.plans.catalog import query
from countframe.plans.sqlbits import F5, rnd, with_
from countframe.sources import fixtures


def _masked_preds(spark, sf):
    f4 = fixtures.document_tokens(spark, sf)
    mobs = sampling.mask_labels(f4.obs)
    preds = fixtures.rule_predictions(f4.obs)
    masked = mobs.where("masked").select("cell_id")
    return preds.join(masked, "cell_id", "left_semi"), mobs, f4.obs


def _masked_scores(spark, sf):
    preds, mobs, obs = _masked_preds(spark, sf)
    return fixtures.rule_scores(preds, fixtures.class_list(obs))


EV = with_(F5) + """,
ev AS (SELECT p.cell_id, p.truth, p.pred FROM f5_preds p JOIN f4_mobs m ON p.cell_id = m.cell_id WHERE m.masked),
sc AS (SELECT s.* FROM f5_scores s JOIN f4_mobs m ON s.cell_id = m.cell_id WHERE m.masked),
cls AS (
  SELECT coalesce(t.class, q.class) AS class, coalesce(t.support, 0) AS support,
         coalesce(q.n_pred, 0) AS n_pred, coalesce(t.tp, 0) AS tp
  FROM (SELECT truth AS class, count(*) AS support, CAST(count_if(truth = pred) AS BIGINT) AS tp FROM ev GROUP BY 1) t
  FULL JOIN (SELECT pred AS class, count(*) AS n_pred FROM ev GROUP BY 1) q ON t.class = q.class),
roc_agg AS (
  SELECT class, score, CAST(sum(CASE WHEN truth = class THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(count(*) - sum(CASE WHEN truth = class THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM sc GROUP BY 1, 2),
roc_tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM roc_agg GROUP BY 1 HAVING sum(pos) > 0),
roc AS (
  SELECT a.*, t.P, t.N, sum(a.pos) OVER w AS tps, sum(a.neg) OVER w AS fps
  FROM roc_agg a JOIN roc_tot t ON a.class = t.class
  WINDOW w AS (PARTITION BY a.class ORDER BY a.score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


# E1 ---------------------------------------------------------------------------
@query("accuracy", EV + f"""
SELECT count(*) AS n, {rnd('avg(CAST(coalesce(truth = pred, false) AS DOUBLE))')} AS accuracy FROM ev""")
def accuracy_q(spark, sf):
    preds, _, _ = _masked_preds(spark, sf)
    a = evaluate.accuracy(preds)
    return a.select("n", round_half_up("accuracy").alias("accuracy"))


# E2 ---------------------------------------------------------------------------
_F1 = "coalesce(CAST(2 * tp AS DOUBLE) / nullif(CAST(support + n_pred AS DOUBLE), 0), 0.0)"


@query("weighted_f1", EV + f"""
SELECT {rnd(f'sum(support * {_F1}) / CAST(sum(support) AS DOUBLE)')} AS weighted_f1 FROM cls""")
def weighted_f1_q(spark, sf):
    preds, _, _ = _masked_preds(spark, sf)
    return evaluate.weighted_f1(preds).select(round_half_up("weighted_f1").alias("weighted_f1"))


@query("class_f1", EV + f"""
SELECT class, support, n_pred, tp, {rnd(_F1)} AS f1 FROM cls""")
def class_f1_q(spark, sf):
    preds, _, _ = _masked_preds(spark, sf)
    pc = evaluate.per_class_f1(preds)
    return pc.select("class", "support", "n_pred", "tp", round_half_up("f1").alias("f1"))


# E3 ---------------------------------------------------------------------------
@query("confusion_matrix", EV + f""",
cm AS (
  SELECT t.truth, p.pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT DISTINCT truth FROM ev) t CROSS JOIN (SELECT DISTINCT pred FROM ev) p
  LEFT JOIN (SELECT truth, pred, count(*) AS n FROM ev GROUP BY 1, 2) c ON c.truth = t.truth AND c.pred = p.pred)
SELECT truth, pred, n, {rnd('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY truth)')} AS frac FROM cm""")
def confusion_matrix_q(spark, sf):
    preds, _, _ = _masked_preds(spark, sf)
    return evaluate.confusion(preds)


# E4 ---------------------------------------------------------------------------
@query("label_binarize", EV + """
SELECT e.cell_id, l.label AS class, CAST(e.truth = l.label AS INTEGER) AS y_bin FROM ev e, f5_labels l""")
def label_binarize_q(spark, sf):
    preds, _, obs = _masked_preds(spark, sf)
    return evaluate.binarize(preds, fixtures.class_list(obs))


# E5 ---------------------------------------------------------------------------
@query("roc_points", EV + f"""
SELECT class, score AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps,
       {rnd('CAST(tps AS DOUBLE) / P')} AS tpr, {rnd('CAST(fps AS DOUBLE) / nullif(CAST(N AS DOUBLE), 0)')} AS fpr
FROM (SELECT class, score, tps, fps, P, N FROM roc
      UNION ALL SELECT DISTINCT class, CAST('Infinity' AS DOUBLE), 0, 0, P, N FROM roc)""")
def roc_points_q(spark, sf):
    return evaluate.roc_points(_masked_scores(spark, sf))


# E6 ---------------------------------------------------------------------------
@query("roc_auc", EV + f"""
SELECT class, {rnd('sum(pos * (N - fps + 0.5 * neg)) / CAST(max(P) * max(N) AS DOUBLE)')} AS auc
FROM roc GROUP BY class""")
def roc_auc_q(spark, sf):
    return evaluate.roc_auc(_masked_scores(spark, sf))


# P10 / M9 ---------------------------------------------------------------------
_CONF = EV + f""",
conf AS (
  SELECT cell_id, class AS pred, {rnd('score')} AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {rnd('score', 9)} DESC, class) AS r
    FROM f5_scores) WHERE r = 1)"""


def _confidence(spark, sf):
    f4 = fixtures.document_tokens(spark, sf)
    scores = fixtures.rule_scores(fixtures.rule_predictions(f4.obs), fixtures.class_list(f4.obs))
    am = evaluate.argmax_label(scores)
    return am.select("cell_id", "pred", round_half_up("confidence").alias("confidence"))


@query("predict_confidence", _CONF + " SELECT * FROM conf")
def predict_confidence_q(spark, sf):
    return _confidence(spark, sf)


# A8 ---------------------------------------------------------------------------
_QS = ", ".join(f"{rnd(f'quantile_cont(confidence, {q})')} AS q{int(q * 100)}" for q in summary.QUANTILES)


@query("confidence_by_label", _CONF + f"""
SELECT pred, 'confidence' AS metric, count(confidence) AS n, {rnd('avg(confidence)')} AS mean, {_QS}
FROM conf GROUP BY pred""")
def confidence_by_label_q(spark, sf):
    return summary.distribution(_confidence(spark, sf), "confidence", by="pred")


# P8 ---------------------------------------------------------------------------
@query("attach_predictions", EV + """
SELECT m.cell_id, m.label_masked, coalesce(e.pred, 'Unknown') AS knn_predictions
FROM f4_mobs m LEFT JOIN ev e ON e.cell_id = m.cell_id""")
def attach_predictions_q(spark, sf):
    preds, mobs, _ = _masked_preds(spark, sf)
    out = evaluate.attach_predictions(mobs.select("cell_id", "label_masked"), preds, "knn_predictions")
    return out.select("cell_id", "label_masked", "knn_predictions")
