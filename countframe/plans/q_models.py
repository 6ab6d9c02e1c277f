"""Model queries: label encoding, MLP / soft-max classifiers on the
documents matrix, label propagation on the vectors' kNN graph
(M1-M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from countframe.functions.hashing import hash16, round_half_up
from countframe.operators import mixture, models, neighbors, sampling, semisup
from countframe.plans.catalog import query
from countframe.plans.q_embedding import f4_dense, f4_entries
from countframe.plans.sqlbits import F1, F3, F4, exact_k, h, rnd, with_
from countframe.session import cut_lineage
from countframe.sources import fixtures

PROP_ROUNDS = 3


# M1 ---------------------------------------------------------------------------
@query("label_encode", with_(F4) + """
SELECT cell_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM f4_obs""")
def label_encode_q(spark, sf):
    obs = fixtures.document_tokens(spark, sf).obs
    _, enc = models.encode_labels(obs, "label")
    return enc.select("cell_id", "label", "label_idx")


def f4_training_sets(spark, sf, feats=None):
    """(train, val, masked, labels): labelled rows split 80/20 per class,
    masked rows to predict; each (cell_id, vec, label_idx[, truth]).

    ``feats`` is what ``f4_entries`` returns.  The split is computed on the
    small (id, label) table and materialised; the sets are the documents'
    entries joined with it, made dense after the join (no dense vector is
    shuffled).  The models keep their own training input for the iterations."""
    rows, axis, scaling, mobs = feats if feats is not None else f4_entries(spark, sf)
    labels = fixtures.class_list(mobs, "label_truth")
    idx = fixtures.label_index(mobs.select(F.col("label_truth").alias("label")))
    meta = mobs.select("cell_id", "masked", F.col("label_truth").alias("label")).join(F.broadcast(idx), "label")
    split = cut_lineage(sampling.stratified_split(meta.where(~F.col("masked")), "label", 0.20)
                        .select("cell_id", "label_idx", "is_val"))
    train = rows.join(split.where(~F.col("is_val")).select("cell_id", "label_idx"), "cell_id")
    val = rows.join(split.where(F.col("is_val")).select("cell_id", "label_idx"), "cell_id")
    masked = rows.join(meta.where(F.col("masked")).select("cell_id", "label_idx", F.col("label").alias("truth")),
                       "cell_id")
    return *[f4_dense(cut_lineage(x), axis, scaling) for x in (train, val, masked)], labels


def fit_f4_mlp(spark, sf):
    train, val, masked, labels = f4_training_sets(spark, sf)
    return models.fit_mlp(train, labels, val=val), masked


# M2 / M3 / M5 -----------------------------------------------------------------
@query("mlp_predict")
def mlp_predict_q(spark, sf):
    fit, masked = fit_f4_mlp(spark, sf)
    hard, _ = models.predict(fit, masked)
    return hard.withColumn("confidence", round_half_up("confidence"))


# M4 ---------------------------------------------------------------------------
@query("training_history")
def training_history_q(spark, sf):
    fit, _ = fit_f4_mlp(spark, sf)
    return models.history_frame(spark, fit)


# M6 ---------------------------------------------------------------------------
@query("softmax_predict")
def softmax_predict_q(spark, sf):
    train, _, masked, labels = f4_training_sets(spark, sf)
    fit = models.fit_softmax(train, labels)
    hard, _ = models.predict(fit, masked)
    return hard.withColumn("confidence", round_half_up("confidence"))


# M7 / M8 ----------------------------------------------------------------------
def f3_propagation(spark, sf, rounds=PROP_ROUNDS):
    lat = fixtures.embedding_latent(spark, sf)
    mobs = sampling.mask_labels(lat.select("cell_id", "label"))
    seeds = mobs.select("cell_id", F.when(~F.col("masked"), F.col("label")).alias("label_seed"))
    graph = neighbors.neighbors(lat, 15)
    return semisup.propagate_labels(graph, seeds, "label_seed", rounds=rounds), seeds


def _prop_sql(rounds: int) -> str:
    parts = [with_(F3) + f""",
f3m AS ({exact_k('f3', 'floor(0.3 * N)', flag='masked')}),
seeds AS (SELECT cell_id, label, 1.0 AS p FROM f3m WHERE NOT masked),
d AS (SELECT a.cell_id AS src, b.cell_id AS dst, {rnd('list_distance(a.vec, b.vec)')} AS dist
      FROM f3 a, f3 b WHERE a.cell_id <> b.cell_id),
g AS (SELECT src, dst, 1.0 / (1.0 + dist) AS w FROM (
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM d) WHERE rank <= 15),
p0 AS (SELECT * FROM seeds)"""]
    for r in range(1, rounds + 1):
        parts.append(f""",
s{r} AS (SELECT g.src AS cell_id, p.label, sum(g.w * p.p) AS s FROM g JOIN p{r - 1} p ON g.dst = p.cell_id
        WHERE g.src NOT IN (SELECT cell_id FROM seeds) GROUP BY 1, 2),
p{r} AS (SELECT cell_id, label, s / sum(s) OVER (PARTITION BY cell_id) AS p FROM s{r}
        UNION ALL SELECT * FROM seeds)""")
    return "".join(parts)


@query("label_propagation", _prop_sql(PROP_ROUNDS) + f" SELECT cell_id, label, {rnd('p')} AS p FROM p{PROP_ROUNDS}")
def label_propagation_q(spark, sf):
    return f3_propagation(spark, sf)[0].withColumn("p", round_half_up("p"))


@query("annotate_hard", _prop_sql(PROP_ROUNDS) + f"""
SELECT f3.cell_id, coalesce(b.label, 'Unknown') AS pred, coalesce({rnd('b.p')}, 0.0) AS confidence
FROM f3 LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {rnd('p', 9)} DESC, label) AS r FROM p{PROP_ROUNDS}) b
ON b.cell_id = f3.cell_id AND b.r = 1""")
def annotate_hard_q(spark, sf):
    ann = semisup.annotate(*f3_propagation(spark, sf))
    return ann.withColumn("confidence", round_half_up("confidence"))


# M7: semi-supervised mixture ---------------------------------------------------------
SEED_SALT, SEED_CUT = 17, 45_875         # about 70 % of the cells keep their label


def _seeds(cf):
    return cf.obs.where(hash16(F.col("cell_id"), SEED_SALT) < SEED_CUT).select("cell_id", "label")


@query("em_annotate", with_(F1) + f""",
seed AS (SELECT cell_id, label FROM f1_obs WHERE {h('cell_id', SEED_SALT)} < {SEED_CUT} AND label IS NOT NULL),
g AS (SELECT count(DISTINCT gene_id) AS n FROM f1_x),
cls AS (SELECT label, count(*) AS w FROM seed GROUP BY 1),
cnt AS (SELECT s.label, x.gene_id, CAST(sum(x.n) AS DOUBLE) AS c FROM f1_x x JOIN seed s ON x.cell_id = s.cell_id GROUP BY 1, 2),
sz AS (SELECT cls.label, w / (SELECT sum(w) FROM cls) AS share, coalesce(t, 0.0) + (SELECT n FROM g) AS size
       FROM cls LEFT JOIN (SELECT label, sum(c) AS t FROM cnt GROUP BY 1) t ON cls.label = t.label),
free AS (SELECT o.cell_id, coalesce(t, 0.0) AS t FROM f1_obs o LEFT JOIN (SELECT cell_id, CAST(sum(n) AS DOUBLE) AS t FROM f1_x GROUP BY 1) q ON o.cell_id = q.cell_id
         WHERE o.cell_id NOT IN (SELECT cell_id FROM seed)),
seen AS (SELECT x.cell_id, c.label, sum(x.n * ln(c.c + 1.0)) AS s FROM f1_x x JOIN cnt c ON x.gene_id = c.gene_id GROUP BY 1, 2),
score AS (SELECT f.cell_id, sz.label, ln(share) - f.t * ln(size) + coalesce(s, 0.0) AS v
          FROM free f CROSS JOIN sz LEFT JOIN seen ON seen.cell_id = f.cell_id AND seen.label = sz.label),
soft AS (SELECT cell_id, label, exp(v - max(v) OVER (PARTITION BY cell_id)) AS e FROM score),
p AS (SELECT cell_id, label, e / sum(e) OVER (PARTITION BY cell_id) AS p FROM soft)
SELECT cell_id, label, {rnd('p')} AS p FROM p WHERE p >= 1e-6 UNION ALL SELECT cell_id, label, 1.0 FROM seed""")
def em_annotate_q(spark, sf):
    """One round from the labelled cells (responsibilities of 1e-6 and more)."""
    cf = fixtures.materialize(fixtures.customer_products(spark, sf))
    found = mixture.em_annotate(cf, _seeds(cf), 1, sparse=0.0).probs
    return found.where("p >= 1e-6").withColumn("p", round_half_up("p"))


@query("em_objective", """
SELECT unnest(range(1, 5)) AS round, TRUE AS not_lower""")
def em_objective_q(spark, sf):
    """No round of expectation-maximisation lowers the objective."""
    cf = fixtures.materialize(fixtures.customer_products(spark, sf))
    values = mixture.em_annotate(cf, _seeds(cf), 4, sparse=0.0).objective
    steps = [(i + 1, i == 0 or v >= values[i - 1] - 1e-6) for i, v in enumerate(values)]
    return spark.createDataFrame(steps, "round long, not_lower boolean")
