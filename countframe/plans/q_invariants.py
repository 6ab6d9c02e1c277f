"""Invariants of the model queries that SQL can state: which rows come out,
and what must hold for each whatever the fit found."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from countframe.operators import embed, explain, models, project, steps
from countframe.plans.catalog import query
from countframe.plans.q_embedding import f4_features
from countframe.plans.q_mapping import f2_mapping, f2_ref_training, f4_softmax, mapped_knn, mapped_latent, mapped_semisup
from countframe.plans.q_models import fit_f4_mlp
from countframe.plans.sqlbits import F2, F4, F4_MASKED, with_
from countframe.session import cut_lineage, scratch_dir

_MASKED = with_(F4_MASKED) + " SELECT cell_id, TRUE AS sums_to_one, TRUE AS top_is_pred, TRUE AS complete FROM f4_mobs WHERE masked AND label_truth IS NOT NULL"


def _classified(fit, masked):
    """Per masked row: chances sum to 1, the predicted class is the likeliest,
    and its attributions sum to the difference of the logits (X1)."""
    scored = models.scored(fit.model, masked.select("cell_id", "vec"))
    hard, long = models.predicted(cut_lineage(scored.select("cell_id", "pred_idx", "_p")), fit.labels)
    chances = long.groupBy("cell_id").agg(F.sum("p").alias("sum"), F.max("p").alias("top"))
    rows = scored.select("cell_id", "vec", F.col("pred_idx").alias("target"))
    whole = explain.integrated_gradients(fit.model, rows).select("cell_id", "gap")
    met = hard.join(chances, "cell_id").join(whole, "cell_id")
    return met.select("cell_id", (F.abs(F.col("sum") - 1) < 1e-9).alias("sums_to_one"), (F.abs(F.col("top") - F.col("confidence")) < 1e-12).alias("top_is_pred"),
                      (F.abs("gap") < 1e-2).alias("complete"))


# M5, M6, X1 ---------------------------------------------------------------------
@query("softmax_check", _MASKED)
def softmax_check_q(spark, sf):
    fit, masked, _ = f4_softmax(spark, sf)
    return _classified(fit, masked)


# M2, M5, X1 ---------------------------------------------------------------------
@query("mlp_check", _MASKED)
def mlp_check_q(spark, sf):
    return _classified(*fit_f4_mlp(spark, sf))


# D4 -------------------------------------------------------------------------------
@query("reconstruction_check", with_(F4) + """
SELECT count(*) AS cells, TRUE AS none_negative, TRUE AS equals_unexplained FROM f4_obs""")
def reconstruction_check_q(spark, sf):
    """The mean error of the linear code is the variance that it does not explain."""
    vecs, _, _ = f4_features(spark, sf)
    res, mse = embed.linear_autoencoder(vecs, 64)
    got = mse.agg(F.count(F.lit(1)).alias("n"), F.min("mse").alias("least"), F.avg("mse").alias("mean")).first()
    centred = vecs.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v")).agg(F.avg("v")).first()[0]
    want = centred * (1 - float(res.explained_ratio.sum()))
    return spark.createDataFrame([(got["n"], got["least"] >= 0, abs(got["mean"] - want) < 1e-6)],
                                 "cells long, none_negative boolean, equals_unexplained boolean")


# T1, T3, T4 -----------------------------------------------------------------------
@query("map_query_check", with_(F2) + """
SELECT way, cell_id, TRUE AS known_label FROM f2_qry_obs, (SELECT unnest(['knn', 'latent', 'semisup']) AS way)""")
def map_query_check_q(spark, sf):
    """Every query cell gets a label of the training cells, whichever way it is mapped."""
    m = f2_mapping(spark, sf)
    labels = m.ref.obs.select(F.collect_set("label")).scalar()
    ways = {"knn": mapped_knn, "latent": mapped_latent, "semisup": mapped_semisup}
    found = [f(spark, sf, m).select(F.lit(way).alias("way"), "cell_id", "pred") for way, f in ways.items()]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.select("way", "cell_id", F.array_contains(labels, F.col("pred")).alias("known_label"))


# S3, T2 -----------------------------------------------------------------------------
@query("saved_pipeline_check", with_(F2) + """
SELECT cell_id, TRUE AS same_label, TRUE AS same_confidence FROM f2_qry_obs""")
def saved_pipeline_check_q(spark, sf):
    """A pipeline that was saved and loaded scores like the operators that it is made of."""
    m = f2_mapping(spark, sf)
    qry, axis = m.qry, m.axis
    _, _, _, train, labels, stats = f2_ref_training(spark, sf, None, m)
    fit = models.fit_softmax(train.select("cell_id", "vec", "label_idx"), labels)
    path = f"{scratch_dir(spark)}/saved_pipeline"
    steps.classifier_pipeline(fit, axis, stats).write().overwrite().save(path)
    loaded = PipelineModel.load(path).transform(steps.triples(qry)).select("cell_id", F.col("pred").alias("p"), F.col("confidence").alias("c"))
    both = project.map_query_classifier(fit, axis, qry, stats).join(loaded, "cell_id")
    return both.select("cell_id", (F.col("pred") == F.col("p")).alias("same_label"), (F.abs(F.col("confidence") - F.col("c")) < 1e-9).alias("same_confidence"))
