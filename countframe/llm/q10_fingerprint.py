"""op10: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countframe.llm import fingerprint
from countframe.sources.tables import table

ORACLE_SQL = None        # sketches: tested against a brute-force version and exact Jaccard values


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.compare_with_next(docs).withColumnRenamed("id", "doc_id")
