"""op2: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .lm import score_documents


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_backed_off: words whose pair with the word before occurs in no other document."""
    return score_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.col("n_longest").alias("n_seen_pairs"), F.round("log10_score", 4).alias("log10_score"),
        F.round(F.try_divide("log10_score", "n_words"), 6).alias("mean_log10"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
p AS (SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM t),
total AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), d1 AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY doc_id, w),
c2 AS (SELECT prev, w, count(*) AS c FROM p WHERE pos > 1 GROUP BY prev, w),
d2 AS (SELECT doc_id, prev, w, count(*) AS c FROM p WHERE pos > 1 GROUP BY doc_id, prev, w),
o1 AS (SELECT d1.doc_id, d1.w, c1.c - d1.c AS c FROM d1 JOIN c1 ON d1.w = c1.w),
o2 AS (SELECT d2.doc_id, d2.prev, d2.w, c2.c - d2.c AS c FROM d2 JOIN c2 ON d2.prev = c2.prev AND d2.w = c2.w),
s AS (
  SELECT p.doc_id, coalesce(o2.c, 0) > 0 AS seen, CASE WHEN o2.c > 0 THEN log10(o2.c / b.c)
    ELSE log10(greatest(a.c, 1)) - log10(total.n) + CASE WHEN pos > 1 THEN log10(0.4) ELSE 0 END END AS x
  FROM p CROSS JOIN total JOIN o1 a ON a.doc_id = p.doc_id AND a.w = p.w
  LEFT JOIN o1 b ON b.doc_id = p.doc_id AND b.w = p.prev
  LEFT JOIN o2 ON o2.doc_id = p.doc_id AND o2.prev = p.prev AND o2.w = p.w),
g AS (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS k, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(k, 0) AS n_seen_pairs, round(coalesce(x, 0), 4) AS log10_score,
  round(x / n, 6) AS mean_log10 FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
