"""The mapping path as ``pyspark.ml`` transformers with persistence.

A whole path from counts to predictions or embeddings is one
``PipelineModel``: ``NormalizeLog`` -> ``ScaleOnAxis`` -> a fitted MLlib
classifier -> ``NameLabels``, or ``NormalizeLog`` -> ``ScaleOnAxis`` ->
``Project``.  Everything a step was fitted with (genes, statistics, loadings,
label names) is a parameter, bounded by the selected axis, so ``save`` and
``PipelineModel.load`` carry it, and a loaded pipeline scores a second dataset
without the first one.

Input is a table of triples (cell_id, gene_id, n); ``triples`` makes it from a
``CountFrame`` and keeps cells without counts as rows without gene.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countframe.frame import CountFrame
from countframe.operators import embed, features, models, normalize


def triples(cf: CountFrame) -> DataFrame:
    """(cell_id, gene_id, n) of all cells; one row without gene for a cell without counts."""
    x = cf.x.select("cell_id", "gene_id", F.col(cf.value_col).alias("n"))
    none = cf.obs.select("cell_id").join(x.select("cell_id").distinct(), "cell_id", "left_anti")
    return x.unionByName(none, allowMissingColumns=True)


class _Step(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose keyword arguments are its parameters."""

    def __init__(self, **params):
        super().__init__()
        self._set(**params)

    def _get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class NormalizeLog(_Step):
    """N -> value, the log of counts scaled to ``target`` a cell."""

    target = Param(Params._dummy(), "target", "counts a cell is scaled to", TypeConverters.toFloat)

    def __init__(self, target: float = normalize.TARGET_SUM):
        super().__init__(target=target)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return normalize.log1p(normalize.normalize_total(CountFrame(dataset, dataset), self._get("target"))).x


class ScaleOnAxis(_Step):
    """Value -> vec (and features, the same as a vector) on
    the training genes, scaled with the training statistics.  Genes that the
    data lack as a whole are 0."""

    genes = Param(Params._dummy(), "genes", "genes in order", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "their means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "their standard deviations", TypeConverters.toListFloat)
    maxValue = Param(Params._dummy(), "maxValue", "clip", TypeConverters.toFloat)

    def __init__(self, genes=(), means=(), stds=(), maxValue: float = normalize.MAX_VALUE):
        super().__init__(genes=list(genes), means=list(means), stds=list(stds), maxValue=maxValue)

    @classmethod
    def fitted(cls, axis: DataFrame, stats: DataFrame, max_value: float = normalize.MAX_VALUE) -> "ScaleOnAxis":
        """``axis`` (gene_id, gene_idx), ``stats`` (gene_id, mean, std); a gene without statistics is constant 0."""
        if features.axis_size(axis) > features.MAX_FEATURES:
            raise ValueError("feature axis too wide")
        rows = axis.join(stats, "gene_id", "left").orderBy("gene_idx").collect()
        return cls([r["gene_id"] for r in rows], [r["mean"] or 0.0 for r in rows], [r["std"] or 1.0 for r in rows], max_value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        rows = list(zip(self._get("genes"), range(len(self._get("genes"))), self._get("means"), self._get("stds")))
        known = spark.createDataFrame(rows, "gene_id string, gene_idx int, mean double, std double")
        x = dataset.where("gene_id IS NOT NULL")
        present = features.genes_present(known.select("gene_id", "gene_idx"), x.select("gene_id").distinct())
        entries = features.select_genes(x, present)
        stats = known.join(present.select("gene_id"), "gene_id", "left_semi").select("gene_id", "mean", "std")
        vec = normalize.scale_vectors(entries, known.select("gene_id", "gene_idx"), dataset.select("cell_id").distinct(), stats, self._get("maxValue"))
        return vec.withColumn("features", array_to_vector("vec"))


class Project(_Step):
    """Vec -> latent, the scores on fitted components."""

    components = Param(Params._dummy(), "components", "row by row", TypeConverters.toListFloat)
    mean = Param(Params._dummy(), "mean", "subtracted before", TypeConverters.toListFloat)

    def __init__(self, components=(), mean=()):
        super().__init__(components=list(components), mean=list(mean))

    @classmethod
    def fitted(cls, pca: embed.PcaResult) -> "Project":
        return cls(pca.components.ravel().tolist(), pca.mean.tolist())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean = np.array(self._get("mean"))
        found = embed.project_vectors(dataset, np.array(self._get("components")).reshape(len(mean), -1), mean)
        return found.withColumnRenamed("vec", "latent")


class NameLabels(_Step):
    """prediction and probability of an MLlib classifier -> pred and confidence."""

    labels = Param(Params._dummy(), "labels", "names by index", TypeConverters.toListString)

    def __init__(self, labels=()):
        super().__init__(labels=list(labels))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(x) for x in self._get("labels")])
        return dataset.withColumn("pred", F.get(names, F.col("prediction").cast("int"))).withColumn("confidence", F.array_max(vector_to_array("probability")))


def classifier_pipeline(fit: models.FitResult, axis: DataFrame, stats: DataFrame) -> PipelineModel:
    """T2 as one model: triples -> pred, confidence."""
    return PipelineModel([NormalizeLog(), ScaleOnAxis.fitted(axis, stats), fit.model, NameLabels(fit.labels)])


def embedding_pipeline(pca: embed.PcaResult, axis: DataFrame, stats: DataFrame) -> PipelineModel:
    """The first part of T3 as one model: triples -> latent, for a kNN on the training embedding."""
    return PipelineModel([NormalizeLog(), ScaleOnAxis.fitted(axis, stats), Project.fitted(pca)])
