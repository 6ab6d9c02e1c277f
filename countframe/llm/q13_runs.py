"""op13: periodic runs of words in all documents, of which a tenth is made periodic."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import runs
from countframe.sources.tables import table

EVERY = 10               # documents with crc32(id) divisible by this are made periodic


def periodic(text: str | None, h: int) -> str | None:
    """The text with its words from h' % n on repeating a shorter stretch."""
    words = (text or "").encode().split()
    n, g = len(words), h // EVERY
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()


def edited(text: Column, row_id: Column) -> Column:
    """``text``, made periodic where crc32 of the id as text is divisible by ``EVERY``."""

    @F.arrow_udf("string")
    def edit(column: pa.Array, h: pa.Array) -> pa.Array:
        marked = [x is not None and x % EVERY == 0 for x in h.to_pylist()]
        changed = [periodic(column[i].as_py(), h[i].as_py()) for i, m in enumerate(marked) if m]
        return pc.replace_with_mask(column, pa.array(marked, pa.bool_()), pa.array(changed, column.type))

    return edit(text, F.crc32(row_id.cast("string").cast("binary")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", edited(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.detect(docs)
    # greatest length, then smallest start, then smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# crc32 of a decimal id, bit by bit; equal stretches of 6 words pair up at a
# distance p; consecutive pairs of one distance form one maximal pair
ORACLE_SQL = r"""
WITH ids AS (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc AS (
  SELECT doc_id, text, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len(s) + 1)]),
         lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h
  FROM ids),
w0 AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM crc),
w1 AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) ELSE 0 END AS a FROM w0),
w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
doc AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN w[1:a] || [w[1 + a + (i - a) % p] FOR i IN range(a, n)] ELSE w END AS w FROM w2),
gram AS (SELECT doc_id, unnest(range(0, n - 5)) AS i, unnest([array_to_string(w[i + 1:i + 6], ' ') FOR i IN range(0, n - 5)]) AS six FROM doc WHERE n >= 6),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
isle AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pair),
stretch AS (SELECT doc_id, p, min(i) AS start, count(*) + 5 AS l FROM isle GROUP BY doc_id, p, island),
run AS (SELECT doc_id, start, l + p AS length, min(p) AS period FROM stretch WHERE l >= p AND l + p >= 12 GROUP BY doc_id, start, l + p),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, arg_min(length, (-length, start, period)) AS length,
         arg_min(period, (-length, start, period)) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.i) AS t
  FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS x FROM doc WHERE n > 0) word
  LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT doc.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
