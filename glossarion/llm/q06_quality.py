"""op6: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .quality import judge


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("lang", "source")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT rid, unnest(range(len(words) - 7)) AS i, words FROM d WHERE len(words) >= 8
), g AS (
  SELECT rid, i, array_to_string(words[i + 1 : i + 8], ' ') AS gram FROM w
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), covered AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, lang, source, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.rid = covered.rid
), v AS (
  SELECT *, ((100 * word_chars) // greatest(n_words, 1)) AS word_length,
    ((1000 * n_symbols) // greatest(n_words, 1)) AS symbols,
    ((1000 * least(8 * n_dup_lines, greatest(n_words, 1))) // greatest(n_words, 1)) AS dup_lines,
    ((1000 * n_repeat_words) // greatest(n_words, 1)) AS repeats,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m
), by_source AS (
  SELECT lang, source, count(*) AS n, quantile_disc(word_length, [0.25, 0.5, 0.75]) AS a, quantile_disc(symbols, [0.5, 0.75]) AS b,
    quantile_disc(dup_lines, [0.5, 0.75]) AS c, quantile_disc(repeats, [0.5, 0.75]) AS e
  FROM v WHERE n_words > 0 GROUP BY lang, source
), by_lang AS (
  SELECT lang, count(*) AS n, quantile_disc(word_length, [0.25, 0.5, 0.75]) AS a, quantile_disc(symbols, [0.5, 0.75]) AS b,
    quantile_disc(dup_lines, [0.5, 0.75]) AS c, quantile_disc(repeats, [0.5, 0.75]) AS e
  FROM v WHERE n_words > 0 GROUP BY lang
), overall AS (
  SELECT quantile_disc(word_length, [0.25, 0.5, 0.75]) AS a, quantile_disc(symbols, [0.5, 0.75]) AS b,
    quantile_disc(dup_lines, [0.5, 0.75]) AS c, quantile_disc(repeats, [0.5, 0.75]) AS e
  FROM v WHERE n_words > 0
), t AS (
  SELECT s.lang, s.source, CASE WHEN s.n >= 50 THEN s.a WHEN l.n >= 50 THEN l.a ELSE o.a END AS a,
    CASE WHEN s.n >= 50 THEN s.b WHEN l.n >= 50 THEN l.b ELSE o.b END AS b,
    CASE WHEN s.n >= 50 THEN s.c WHEN l.n >= 50 THEN l.c ELSE o.c END AS c,
    CASE WHEN s.n >= 50 THEN s.e WHEN l.n >= 50 THEN l.e ELSE o.e END AS e
  FROM by_source s LEFT JOIN by_lang l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN overall o
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    word_length >= a[2] - 4 * (a[2] - a[1]) - 150 AND word_length <= a[2] + 4 * (a[3] - a[2]) + 150
    AND symbols <= b[1] + 4 * (b[2] - b[1]) + 600 AND dup_lines <= c[1] + 4 * (c[2] - c[1]) + 250
    AND repeats <= e[1] + 4 * (e[2] - e[1]) + 200, true) AS kept
FROM v LEFT JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source
"""
