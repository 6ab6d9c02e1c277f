"""A corpus pipeline over ``documents``: five stages, each one operator of
``countframe.llm``, each working on all rows its predecessor kept.

language_id     documents without letters, or without a likely language, go
line_dedup      later repeats of line runs are cut out; documents that lose
                their whole text go; n_chars follows the text
jaccard_join    of every group of near copies (75 % of 5-word shingles) the
                row with the smallest id stays; texts without words stay
decontaminate   documents with a benchmark passage go
mix             documents repeat or drop out, so that sources meet the target
                weights; one row per taken copy, numbered by ``copy``

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of its input.  Between stages the rows are written as
Parquet into the shared checkpoint folder and read again.  Nulls, empty and
repeated rows, and columns that clash with an operator's are handled by
carrying the input row as one struct beside what the operator needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countframe.llm import decontaminate, jaccard, language, linededup, mixing
from countframe.session import cut_lineage, ship_library
from countframe.sources.tables import table

MIN_LANGUAGE_SCORE = 0.5
_ROW = "__cf_row"


def _packed(docs: DataFrame, *columns: str, without: str | None = None) -> DataFrame:
    """The input row as one struct (``without`` a column that the operator
    replaces), beside the columns an operator reads."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without])
    return docs.select(row.alias(_ROW), *[F.col(f"`{c}`") for c in columns])


def _unpacked(rows: DataFrame, columns: list[str], **changed) -> DataFrame:
    return rows.select(*[changed.get(c, F.col(f"{_ROW}.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(language.remainder("doc_id", 4) != 2))
    found = language.predict(_packed(docs, "text"), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _unpacked(kept, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.dedup(_packed(docs, "doc_id", "text", without="text")).where(~F.col("emptied"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = (F.when(F.size("runs") > 0, F.length("text")).otherwise(F.col(f"{_ROW}.n_chars"))
                              .cast(docs.schema["n_chars"].dataType))
    return _unpacked(done, docs.columns, **changed)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_library(spark)
    groups = jaccard.cluster(docs.select("doc_id", "text"))
    # per group: the node and id of the row that stays
    first = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    stay = (groups.where("node IS NOT NULL").groupBy("component").agg(F.min(first).alias("f"))
            .select(F.col("f.node").alias("node"), F.coalesce(F.col("f.id").cast("string"), F.lit("")).alias("kid")))
    rows = _packed(docs, "doc_id", "text").select(
        _ROW, jaccard.document_nodes(F.col("text").cast("string")).alias("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("kid"),
        F.xxhash64("text").alias("th"))
    rows = rows.select(_ROW, F.col("d.node").alias("node"), "kid", "th")
    # rows equal in id and set: one of them
    one = F.row_number().over(Window.partitionBy("node", "kid").orderBy("th"))
    chosen = rows.join(stay, ["node", "kid"]).withColumn("nth", one).where("nth = 1")
    return _unpacked(chosen.select(_ROW).unionByName(rows.where("node IS NULL").select(_ROW)), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.emit(mixing.mix(_packed(docs, "doc_id", "source", "text")), "__cf_copy")
    copy = "copy" if "copy" not in docs.columns else "__cf_copy"
    return taken.select(*[F.col(f"{_ROW}.`{c}`").alias(c) for c in docs.columns], F.col("__cf_copy").alias(copy))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminated),
    ("mix", mix),
]

#: language ID is learned, and hash order decides fingerprints: tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
