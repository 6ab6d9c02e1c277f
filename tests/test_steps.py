"""Saved pipelines score like the operators they are made of."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.operators import embed, models, project, steps
from countframe.plans import q_mapping as qm

SF = "/root/testdata/sf0.001"


def test_saved_pipelines_equal_the_mapping_queries(spark, tmpdir_path):
    pair = qm.f2_pair(spark, SF, materialize=True)
    _, qry = qm.f2_masked(spark, SF, pair)
    _, axis, vecs, train, labels, stats = qm.f2_ref_training(spark, SF, pair)
    fit = models.fit_softmax(train.select("cell_id", "vec", "label_idx"), labels)
    steps.classifier_pipeline(fit, axis, stats).write().overwrite().save(f"{tmpdir_path}/t2")
    extra = qry.obs.select("cell_id").union(spark.createDataFrame([(-1,)], "cell_id long"))          # a cell without counts
    cf = CountFrame(qry.x, extra)
    loaded = PipelineModel.load(f"{tmpdir_path}/t2")
    got = {r.cell_id: (r.pred, round(r.confidence, 9)) for r in loaded.transform(steps.triples(cf)).collect()}
    want = {r.cell_id: (r.pred, round(r.confidence, 9)) for r in project.map_query_classifier(fit, axis, cf, stats).collect()}
    assert got == want and -1 in got and len(got) == extra.count()

    pca = embed.pca(vecs, 5)
    steps.embedding_pipeline(pca, axis, stats).write().overwrite().save(f"{tmpdir_path}/t3")
    again = PipelineModel.load(f"{tmpdir_path}/t3").transform(steps.triples(cf))
    same = embed.project_vectors(project.query_vectors_on_axis(cf, axis, stats), pca.components, pca.mean)
    rows = again.join(same, "cell_id").select("latent", "vec").collect()
    assert len(rows) == extra.count() and all(np.allclose(r.latent, r.vec) for r in rows)
    assert again.select(F.size("latent")).distinct().collect() == [(5,)]
