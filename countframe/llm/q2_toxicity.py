"""op2: toxicity of all documents, learned from four of five folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import toxicity
from countframe.llm.language import remainder
from countframe.sources.tables import table

ORACLE_SQL = None        # learned model: tested by held-out accuracy and a brute-force kernel


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
