"""op5: repeated runs of lines in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import linededup
from countframe.sources.tables import table

ORACLE_SQL = None        # every run against every earlier one: tested against a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup(docs)
    return done.select("doc_id", "n_deleted", "deleted_chars", "emptied",
                       F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))
