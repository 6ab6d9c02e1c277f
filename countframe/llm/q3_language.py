"""op3: the language of all documents, learned from three of four folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import language
from countframe.sources.tables import table

ORACLE_SQL = None        # learned model: tested by held-out accuracy and a brute-force scorer


def fit(docs: DataFrame) -> language.NaiveBayes:
    return language.train(docs.where(language.remainder("doc_id", 4) != 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language.remainder("doc_id", 4) == 2, F.lit(False))
    return (language.predict(docs.select("doc_id", "text"), fit(docs))
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
