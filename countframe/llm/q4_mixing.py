"""op4: all documents mixed to the weights 5, 2, 1 of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countframe.llm import mixing
from countframe.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('5:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS w, source_size * 3 AS cap FROM p),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, place
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w),
t AS (SELECT skey, source_size, least(CAST(cap AS DOUBLE), CAST(w AS DOUBLE) * max(level) OVER ()) AS target FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY skey ORDER BY
             length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER) DESC,
             CAST('0x' || substr(draw, 1, 4) AS BIGINT) // 64, draw, size) AS rank FROM d),
c AS (SELECT doc_id, size, source_size, target, rank,
             CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('6:' || skey), 1, 4) AS BIGINT) / 65536.0 AS start
      FROM r JOIN t USING (skey)),
k AS (SELECT *, CAST(floor(rate * rank + start) - floor(rate * (rank - 1) + start) AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM k
"""
