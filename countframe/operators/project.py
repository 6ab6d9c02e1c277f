"""Mapping a second dataset into a trained space.

Every step is an operator of its own (gene-set joins, normalisation,
training statistics, projection, kNN vote, propagation); the functions
below only compose them.  Query rows are matched to training rows by key
and distance, never by position.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countframe.frame import UNKNOWN, CountFrame
from countframe.operators import embed, features, models, neighbors, normalize, semisup
from countframe.session import cut_lineage, discard


@dataclass
class KnnSpace:
    """A fitted classical space: training genes, statistics, PCA, labelled latent."""
    axis: DataFrame
    stats: DataFrame
    pca: embed.PcaResult
    train_latent: DataFrame   # (cell_id, vec, label) of labelled training rows


def fit_knn_space(ref: CountFrame, axis: DataFrame, label: str, n_pcs: int = 50) -> KnnSpace:
    """Training side of T1: log-normalise, restrict to ``axis``, scale with
    its own statistics, PCA on all training rows (transductive, like the
    reference); the labelled rows form the kNN training set."""
    rlog = normalize.log1p(normalize.normalize_total(ref))
    sel = features.select_genes(rlog.x, axis)
    stats = cut_lineage(normalize.gene_stats(sel, normalize.n_cells_of(rlog.obs)))
    vecs = cut_lineage(normalize.scale_vectors(sel, axis, rlog.obs, stats))
    res = embed.pca(vecs, min(n_pcs, axis.count()))
    lab = ref.obs.where(F.col(label).isNotNull() & (F.col(label) != UNKNOWN)).select("cell_id", F.col(label).alias("label"))
    # written once: the kNN join counts, measures and reads it
    train_latent = cut_lineage(res.latent.join(lab, "cell_id"))
    return KnnSpace(axis, stats, res, train_latent)


def map_query_knn(space: KnnSpace, qry: CountFrame, k: int = 15) -> DataFrame:
    """T1. Query: normalise, log, training statistics, training PCA
    (centred with the training mean), k-NN vote.  (cell_id, pred, p)."""
    qlog = normalize.log1p(normalize.normalize_total(qry))
    qsel = features.select_genes(qlog.x, space.axis)
    qvec = normalize.scale_vectors(qsel, space.axis, qlog.obs, space.stats)
    qlat = embed.project_vectors(qvec, space.pca.components, space.pca.mean)
    nn = neighbors.knn_join(qlat, space.train_latent, k)
    pr = neighbors.knn_predict(neighbors.knn_predict_proba(nn, space.train_latent))
    return pr.select(F.col("query_id").alias("cell_id"), "pred", "p")


def query_vectors_on_axis(qry: CountFrame, axis: DataFrame, stats: DataFrame | str) -> DataFrame:
    """T2/T3 input: normalise, log, scale with the training statistics
    ``stats`` (``"self"``: with the query's own, so that a row's vector
    depends on the rows it is scored with), then align to the training
    feature list; genes the query lacks are 0."""
    qlog = normalize.log1p(normalize.normalize_total(qry))
    present = features.genes_present(axis, qlog.genes())
    sel = features.select_genes(qlog.x, present)
    if isinstance(stats, str):
        stats = normalize.gene_stats(sel, normalize.n_cells_of(qlog.obs))
    else:
        stats = stats.join(present.select("gene_id"), "gene_id", "left_semi")
    return normalize.scale_vectors(sel, axis, qlog.obs, stats)


def map_query_classifier(fit: models.FitResult, axis: DataFrame, qry: CountFrame,
                         stats: DataFrame | str) -> DataFrame:
    """T2. Score the aligned query rows with a trained classifier."""
    hard, _ = models.predict(fit, query_vectors_on_axis(qry, axis, stats))
    return hard


def map_query_latent(ae: embed.PcaResult, train_latent: DataFrame, axis: DataFrame, qry: CountFrame,
                     stats: DataFrame | str, k: int = 15) -> DataFrame:
    """T3. Aligned query rows through the (linear) encoder, then kNN on the
    training embedding."""
    qlat = embed.project_vectors(query_vectors_on_axis(qry, axis, stats), ae.components, ae.mean)
    train_latent = cut_lineage(train_latent.select("cell_id", "vec", "label"))
    nn = neighbors.knn_join(qlat, train_latent, k)
    pr = neighbors.knn_predict(neighbors.knn_predict_proba(nn, train_latent))
    return pr.select(F.col("query_id").alias("cell_id"), "pred", "p")


@dataclass
class NbSpace:
    """A fitted count-model space: frozen per-batch totals and the PCA of the
    training residuals."""
    totals: DataFrame
    n_train: int
    pca: embed.PcaResult


def fit_nb_space(ref: CountFrame, axis: DataFrame, batch: str = "batch", n_latent: int = 20) -> NbSpace:
    """D5 training side, kept for mapping: totals and residual PCA."""
    totals = cut_lineage(embed.nb_batch_totals(ref, axis, batch))
    n_train = ref.obs.count()
    rvec = cut_lineage(embed.nb_residual_vectors(ref, axis, batch, batch_totals=totals, n_train=n_train))
    res = embed.pca(rvec, n_latent)
    latent = cut_lineage(res.latent)
    discard(rvec)                              # axis numbers a cell: only the latent is read from here
    return NbSpace(totals, n_train, replace(res, latent=latent))


def map_query_semisup(space: NbSpace, ref_probs: DataFrame, qry: CountFrame, axis: DataFrame,
                      batch: str = "batch", k: int = 15) -> DataFrame:
    """T4. Frozen model, possibly unseen batch: a second dataset without
    batches is one unseen batch ("test"); NB residuals use the *training*
    totals (an unseen batch falls back to the pooled training totals); the
    training PCA maps the residuals; each query row takes one propagation
    step from its k nearest training rows.  (cell_id, pred, confidence)."""
    qcf = qry if batch in qry.obs.columns else CountFrame(qry.x, qry.obs.select("cell_id"))
    qvec = embed.nb_residual_vectors(qcf, axis, batch, batch_totals=space.totals, n_train=space.n_train)
    qlat = embed.project_vectors(qvec, space.pca.components, space.pca.mean)
    nn = neighbors.knn_join(qlat, space.pca.latent, k)
    edges = nn.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), "dist")
    step = semisup.edge_weights(edges).join(ref_probs.withColumnRenamed("cell_id", "dst"), "dst") \
        .groupBy(F.col("src").alias("cell_id"), "label").agg(F.sum(F.col("w") * F.col("p")).alias("_s"))
    probs = step.select("cell_id", "label",
                        (F.col("_s") / F.sum("_s").over(Window.partitionBy("cell_id"))).alias("p"))
    return semisup.annotate(probs, qry.obs).select("cell_id", "pred", "confidence")
