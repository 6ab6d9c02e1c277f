"""op7: licence notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import licenses
from countframe.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    return found.select("doc_id", "n_matches", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"))


_NAMES = ", ".join(f"('{n}', '{t}')" for n, t in sorted(licenses.TEMPLATES.items()))
_W = (f"regexp_extract_all(translate(u, '{licenses._UPPER}', '{licenses._LOWER}'), "
      r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE_SQL = f"""
WITH unit AS (
  SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS u
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, u, {_W} AS w FROM unit),
b AS (SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM w WHERE len(w) >= 2),
t AS (SELECT name, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS tb
      FROM (SELECT name, {_W} AS w FROM (VALUES {_NAMES}) v(name, u))),
m AS (SELECT doc_id, name, len(list_intersect(b, tb)) * 2.0::DOUBLE / (len(b) + len(tb)) AS dice FROM b JOIN t
      ON len(tb) * 0.75 <= len(b) * 1.25 AND len(b) * 0.75 <= len(tb) * 1.25),
g AS (SELECT doc_id, count(*) AS n_matches, arg_min(name, (-dice, name)) AS license, max(dice) AS dice FROM m WHERE dice >= 0.75 GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, license, CAST(coalesce(dice, 0.0) AS DOUBLE) AS dice
FROM documents LEFT JOIN g USING (doc_id)
"""
