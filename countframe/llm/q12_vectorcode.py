"""op12: codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import vectorcode
from countframe.session import cut_lineage
from countframe.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcode.learn(vectors)
    coded = cut_lineage(vectorcode.encode(vectors, books).drop("embedding"))
    return vectorcode.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vectorcode.codebooks_sha256(books)).alias("codebooks_sha256"))


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT id, label, part, v, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT p.id, p.label, p.part, p.v, c.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.v, c.v)]) AS d
        FROM p JOIN c{i} c ON p.part = c.part)
  GROUP BY id, label, part, v),"""


def _moved(i: int) -> str:
    return f"""
m{i} AS (
  SELECT part, e, list(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END ORDER BY pos) AS v
  FROM (SELECT part, e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{i}) GROUP BY part, e, pos)
  GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.part = m.part AND c.e = m.e),"""


ORACLE_SQL = """
WITH k AS (
  SELECT vec_id AS id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, label, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS v FROM k, range(4) r(part)),
start AS (SELECT id FROM k ORDER BY id LIMIT 256),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS e, v FROM p WHERE id IN (SELECT id FROM start)),""" + "".join(
    _round(i) + (_moved(i) if i < 4 else "") for i in range(5)) + """
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c4),
code AS (SELECT id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY id)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM code, book
"""
