"""Second-dataset mapping (T1-T4), attributions (X1-X3) and the model
comparison table (E7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.functions.hashing import round_half_up
from countframe.operators import (
    embed, evaluate, explain, features, models, neighbors, normalize, project, sampling, semisup, summary,
)
from countframe.plans.catalog import query
from countframe.plans.q_embedding import f4_dense, f4_entries
from countframe.plans.q_models import f4_training_sets, fit_f4_mlp
from countframe.plans.q_preprocess import F1_LOG, N_TOP_KNN, f1_log, f2_dispersions, f2_pair, f2_train_axis
from countframe.plans.sqlbits import h, rnd
from countframe.session import cut_lineage
from countframe.sources import fixtures


def f2_masked(spark, sf, pair=None):
    """Reference side with 30 % of its labels hidden, and the query side."""
    ref, qry = pair if pair is not None else fixtures.reference_query_pair(spark, sf)
    mobs = cut_lineage(sampling.mask_labels(ref.obs))      # read by every later step
    return CountFrame(ref.x, mobs), qry


@dataclass
class Mapping:
    """What every way of mapping starts from, made once: the masked reference,
    the query side and the dispersions behind the training axes."""
    ref: CountFrame
    qry: CountFrame
    dispersions: DataFrame

    def _axis(self, **n_top) -> DataFrame:
        return f2_train_axis(self.ref.x.sparkSession, None, (self.ref, self.qry), dispersions=self.dispersions, **n_top)

    @cached_property
    def axis(self) -> DataFrame:
        return self._axis()

    @cached_property
    def knn_axis(self) -> DataFrame:
        """Longer than the list of components, or the PCA would only turn the rows."""
        return self._axis(n_top=N_TOP_KNN)


def f2_mapping(spark, sf, pair=None) -> Mapping:
    pair = pair if pair is not None else f2_pair(spark, sf, materialize=True)
    ref, qry = f2_masked(spark, sf, pair)
    return Mapping(ref, qry, f2_dispersions(pair[0]))


def _out(df, cols=("cell_id", "pred")):
    return df.select(*cols)


# T1 ---------------------------------------------------------------------------
@query("map_query_knn")
def map_query_knn_q(spark, sf):
    return mapped_knn(spark, sf, f2_mapping(spark, sf))


def mapped_knn(spark, sf, m: Mapping):
    # the shared part of the training HVG list
    axis = features.freeze_axis(features.index_genes(features.genes_present(m.knn_axis, m.qry.genes()).select("gene_id")))
    space = project.fit_knn_space(m.ref, axis, "label_masked", n_pcs=50)
    return _out(project.map_query_knn(space, m.qry))


def f2_ref_training(spark, sf, pair, m: Mapping | None = None):
    """Labelled reference rows on the training axis: (cell_id, vec, label_idx)."""
    if m is None:
        m = f2_mapping(spark, sf, pair)
    rlog = normalize.log1p(normalize.normalize_total(m.ref))
    stats = cut_lineage(normalize.gene_stats(features.select_genes(rlog.x, m.axis), normalize.n_cells_of(rlog.obs)))
    vecs = cut_lineage(normalize.scale(rlog, m.axis, stats))
    labels = fixtures.class_list(m.ref.obs, "label_truth")
    idx = fixtures.label_index(m.ref.obs.select(F.col("label_truth").alias("label")))
    lab = sampling.labeled(m.ref.obs).select("cell_id", F.col("label_truth").alias("label"))
    train = vecs.join(lab, "cell_id").join(F.broadcast(idx), "label")
    return m.ref, m.axis, vecs, train, labels, stats


# T2 ---------------------------------------------------------------------------
@query("map_query_classifier")
def map_query_classifier_q(spark, sf):
    m = f2_mapping(spark, sf)
    _, _, _, train, labels, stats = f2_ref_training(spark, sf, None, m)
    fit = models.fit_softmax(train.select("cell_id", "vec", "label_idx"), labels)
    hard = project.map_query_classifier(fit, m.axis, m.qry, stats)
    return hard.select("cell_id", "pred", round_half_up("confidence").alias("confidence"))


# T3 ---------------------------------------------------------------------------
@query("map_query_latent")
def map_query_latent_q(spark, sf):
    return mapped_latent(spark, sf, f2_mapping(spark, sf))


def mapped_latent(spark, sf, m: Mapping):
    _, _, vecs, train, _, stats = f2_ref_training(spark, sf, None, m)
    ae, _ = embed.linear_autoencoder(vecs, 20)
    train_lat = ae.latent.join(train.select("cell_id", "label"), "cell_id")
    return _out(project.map_query_latent(ae, train_lat, m.axis, m.qry, stats))


# T4 ---------------------------------------------------------------------------
@query("map_query_semisup")
def map_query_semisup_q(spark, sf):
    return mapped_semisup(spark, sf, f2_mapping(spark, sf))


def mapped_semisup(spark, sf, m: Mapping):
    ref, qry = m.ref, m.qry
    space = project.fit_nb_space(ref, m.axis, "batch", 20)
    graph = neighbors.neighbors(space.pca.latent, 15)
    seeds = ref.obs.select("cell_id", F.when(~F.col("masked"), F.col("label_truth")).alias("label_seed"))
    probs = cut_lineage(semisup.propagate_labels(graph, seeds, "label_seed", rounds=30))
    qry_nobatch = CountFrame(qry.x, qry.obs.drop("batch"))  # the second dataset has no batch
    out = project.map_query_semisup(space, probs, qry_nobatch, m.axis, "batch")
    return out.select("cell_id", "pred", round_half_up("confidence").alias("confidence"))


# X1 ---------------------------------------------------------------------------
def f4_softmax(spark, sf, feats=None):
    train, _, masked, labels = f4_training_sets(spark, sf, feats)
    return models.fit_softmax(train, labels), masked, labels


@query("ig_softmax")
def ig_softmax_q(spark, sf):
    fit, masked, _ = f4_softmax(spark, sf)
    return _attributed(fit, masked)


@query("ig_mlp")
def ig_mlp_q(spark, sf):
    """The same for the multilayer perceptron."""
    return _attributed(*fit_f4_mlp(spark, sf))


def _attributed(fit, masked):
    """Per masked row: the predicted class, the sum of its attributions and
    how far that is from the difference of the logits (completeness)."""
    rows = models.scored(fit.model, masked).select("cell_id", "vec", F.col("pred_idx").alias("target"))
    ig = explain.integrated_gradients(fit.model, rows)
    return ig.select("cell_id", "target", round_half_up(F.aggregate("attr", F.lit(0.0), lambda a, b: a + b))
                     .alias("sum_attr"), round_half_up("gap", 9).alias("gap"))


# X2 ---------------------------------------------------------------------------
@query("top_features", F1_LOG + f""",
w0 AS (SELECT gene_id, CAST({h("gene_id || ':0'", 11)} AS DOUBLE) / 65536.0 - 0.5 AS w
       FROM (SELECT DISTINCT gene_id FROM f1_x)),
m AS (SELECT l.gene_id, sum(l.value * w0.w) / CAST((SELECT count(*) FROM f1_obs) AS DOUBLE) AS mean_attr
      FROM f1_log l JOIN w0 ON l.gene_id = w0.gene_id GROUP BY 1)
SELECT gene_id, {rnd('mean_attr')} AS mean_attr, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs(floor(mean_attr * 1000000000.0 + 0.5)) DESC, gene_id) AS r FROM m)
WHERE r <= 10""")
def top_features_q(spark, sf):
    """Attributions of a rule-made linear model: attr = x * w (zero baseline,
    exact), averaged over all rows (implicit zeros add 0)."""
    cf = f1_log(spark, sf)
    w = fixtures.rule_loadings(cf.genes(), 1).select("gene_id", "w")
    n = normalize.n_cells_of(cf.obs)
    means = (cf.x.join(F.broadcast(w), "gene_id").groupBy("gene_id")
             .agg((F.sum(F.col("value") * F.col("w")) / n).alias("mean_attr")))
    top = explain.top_features(means, 10)
    return top.select("gene_id", round_half_up("mean_attr").alias("mean_attr"), F.col("rank").cast("int"))


# X3 ---------------------------------------------------------------------------
@query("explain_labels")
def explain_labels_q(spark, sf):
    feats = f4_entries(spark, sf)
    axis = feats[1]
    fit, masked, labels = f4_softmax(spark, sf, feats)
    # the first three true labels, 50 rows of each by key
    first3 = [r[0] for r in summary.distinct_labels(masked, "truth", 3).collect()]
    idx = {l: i for i, l in enumerate(labels)}
    rows = sampling.limit_per_label(masked.where(F.col("truth").isin(first3)).select("cell_id", "vec", "truth"), 50, label="truth")
    target = F.element_at(F.create_map(*[x for l in first3 for x in (F.lit(l), F.lit(idx[l]))]), F.col("truth"))
    ig = explain.integrated_gradients(fit.model, rows.withColumn("target", target.cast("int")))
    means = explain.mean_attribution(ig, by=["target"]).join(F.broadcast(axis), "gene_idx")
    top = explain.top_features(means, 10, by=["target"])
    names = F.lit(labels)
    return top.select(F.element_at(names, F.col("target") + 1).alias("label"), "gene_id",
                      round_half_up("mean_attr").alias("mean_attr"), F.col("rank").cast("int"))


# E7 ---------------------------------------------------------------------------
def _metrics_row(preds, truth):
    j = preds.select("cell_id", "pred").join(truth, "cell_id")
    m = evaluate.metrics(j)
    return m.select("n", round_half_up("accuracy", 4).alias("masked_acc"),
                    round_half_up("weighted_f1", 4).alias("masked_f1"))


@query("model_comparison")
def model_comparison_q(spark, sf):
    """The reference's results table on the documents matrix (language as
    the label, 30 % masked): PCA+kNN, MLP, linear AE+kNN, NB latent +
    label propagation."""
    f4 = fixtures.materialize(fixtures.document_tokens(spark, sf))
    feats = f4_entries(spark, sf, f4=f4)
    rows_, axis, scaling, mobs = feats
    vecs = f4_dense(rows_, axis, scaling)
    moments = embed.mean_covariance(vecs)                  # of the PCA and the autoencoder
    truth = mobs.where("masked").select("cell_id", F.col("label_truth").alias("truth"))
    lab = sampling.labeled(mobs).select("cell_id", F.col("label_truth").alias("label"))
    rows = []
    # PCA + kNN
    pcs = embed.pca(vecs, 50, moments=moments)
    lat = cut_lineage(pcs.latent)
    q = lat.join(truth.select("cell_id"), "cell_id")
    t = lat.join(lab, "cell_id")
    knn = neighbors.knn_predict(neighbors.knn_predict_proba(neighbors.knn_join(q, t, 15), t))
    rows.append(("pca_knn", _metrics_row(knn.withColumnRenamed("query_id", "cell_id"), truth)))
    # MLP
    train, val, masked, labels = f4_training_sets(spark, sf, feats)
    fit = models.fit_mlp(train, labels, val=val)
    hard, _ = models.predict(fit, masked)
    rows.append(("mlp", _metrics_row(hard, truth)))
    # linear autoencoder + kNN
    ae, _ = embed.linear_autoencoder(vecs, 64, moments=moments)
    alat = cut_lineage(ae.latent)
    aq = alat.join(truth.select("cell_id"), "cell_id")
    at = alat.join(lab, "cell_id")
    aknn = neighbors.knn_predict(neighbors.knn_predict_proba(neighbors.knn_join(aq, at, 15), at))
    rows.append(("ae_knn", _metrics_row(aknn.withColumnRenamed("query_id", "cell_id"), truth)))
    # NB latent + propagation
    nb = embed.nb_latent(f4, axis, 20, "batch")
    graph = neighbors.neighbors(cut_lineage(nb.latent), 15)
    seeds = mobs.select("cell_id", F.when(~F.col("masked"), F.col("label_truth")).alias("label_seed"))
    ann = semisup.annotate(semisup.propagate_labels(graph, seeds, "label_seed"), seeds)
    rows.append(("nb_propagation", _metrics_row(ann, truth)))
    return evaluate.results_table(rows)

