"""op11: words of repeated 35-word windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countframe.llm import substrings
from countframe.sources.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, unnest(range(0, len(w) - 34)) AS i, unnest([md5(array_to_string(w[j + 1:j + 35], ' ')) FOR j IN range(0, len(w) - 34)]) AS x FROM doc WHERE len(w) >= 35),
often AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM win WHERE x IN (SELECT x FROM often)),
word AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM doc WHERE len(w) > 0),
kept AS (SELECT word.r, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t
         FROM word LEFT JOIN gone ON word.r = gone.r AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
"""
