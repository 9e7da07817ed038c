"""SQL for DuckDB that says the same as the queries of the catalogue, built from common table expressions."""

from __future__ import annotations

from ..functions.langs import LANGS

ORDER = "(VALUES " + ", ".join(f"('{x}', {k})" for k, x in enumerate(LANGS)) + ") AS o(lang, ord)"


def fill(sql: str, **parts: str) -> str:
    for name, part in parts.items():
        sql = sql.replace("{" + name + "}", part)
    return sql


def toks(column: str) -> str:
    runs = rf"regexp_extract_all({column}, '[\p{{L}}\p{{M}}\p{{N}}'']+')"
    return rf"list_filter(list_transform({runs}, lambda t: lower(trim(t, ''''))), lambda t: regexp_matches(t, '\p{{L}}'))"


def grams(source: str, columns: str) -> str:
    """A select of columns and tri, a row for each trigram of the tokens of source."""
    return (
        f"SELECT {columns}, substr('^^' || token || '$$', i, 3) AS tri FROM "
        f"(SELECT *, unnest(range(1, length(token) + 3)) AS i FROM {source})"
    )


MODEL = f"""
freq AS (SELECT lang, token, count(*) AS freq FROM (SELECT lang, unnest({toks("text")}) AS token FROM documents WHERE {{train}})
  WHERE lang IN {LANGS} GROUP BY lang, token),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, token) - 1 AS rnk FROM freq) WHERE rnk < 10000),
dict_all AS (SELECT token, lang, rnk FROM ranked WHERE rnk < 3000),
cnt AS (SELECT lang, tri, sum(freq) AS c FROM ({grams("ranked", "lang, freq")}) GROUP BY lang, tri),
tot AS (SELECT lang, count(*) AS vocab, sum(c) + 0.5 * count(*) AS denom, ln(0.5 / (sum(c) + 0.5 * count(*))) AS floor FROM cnt GROUP BY lang),
tri_all AS (SELECT t.lang, tri, ln((c + 0.5) / denom) AS lp FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, tri) AS k FROM cnt) t JOIN tot ON t.lang = tot.lang WHERE k <= 3000)"""

SCORES = f"""
langs AS (SELECT tot.lang, ord, floor FROM tot JOIN {ORDER} ON tot.lang = o.lang WHERE {{only}}),
dict AS (SELECT * FROM dict_all WHERE lang IN (SELECT lang FROM langs)),
vocab AS (SELECT DISTINCT token FROM tf),
priors AS (SELECT token, lang, (1.0 / (rnk + 10.0)) / sum(1.0 / (rnk + 10.0)) OVER (PARTITION BY token) AS s FROM dict),
miss AS (SELECT token FROM vocab WHERE token NOT IN (SELECT token FROM dict)),
raw AS (SELECT token, l.lang, sum(coalesce(lp, floor)) AS r FROM ({grams("miss", "token")}) g CROSS JOIN langs l
  LEFT JOIN tri_all t ON t.lang = l.lang AND t.tri = g.tri GROUP BY token, l.lang),
shifted AS (SELECT token, lang, exp(r - max(r) OVER (PARTITION BY token)) AS e FROM raw),
soft AS (SELECT token, lang, e / sum(e) OVER (PARTITION BY token) AS s FROM shifted),
ws AS (SELECT *, max(s) OVER (PARTITION BY token) AS conf FROM (
  SELECT p.token, p.lang, p.s, 'dict' AS source FROM priors p JOIN vocab ON p.token = vocab.token
  UNION ALL SELECT token, lang, s, 'ngram' AS source FROM soft))"""

TF = f"tf AS (SELECT {{keys}}, token, count(*) AS n FROM (SELECT {{keys}}, unnest({toks('text')}) AS token FROM {{table}}) GROUP BY {{keys}}, token)"

RANKED = """
num AS (SELECT {keys}, lang, sum(n * conf * s) AS w FROM tf JOIN ws ON tf.token = ws.token GROUP BY {keys}, lang),
share AS (SELECT {keys}, lang, w / sum(w) OVER (PARTITION BY {keys}) AS score FROM num),
spread AS (SELECT {pkeys}, l.lang, l.ord, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT {keys} FROM num) p CROSS JOIN langs l
  LEFT JOIN share s ON {same} AND s.lang = l.lang),
listed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS k FROM spread),
best AS (SELECT {keys}, score AS top FROM listed WHERE k = 1)"""


def chain(keys: str = "doc_id", table: str = "documents", train: str = "true", only: str = "true") -> str:
    return "WITH " + ",".join([fill(TF, keys=keys, table=table), fill(MODEL, train=train), fill(SCORES, only=only)])


def detection(keys: str = "doc_id", table: str = "documents", train: str = "true", only: str = "true") -> str:
    names = keys.split(", ")
    same = " AND ".join(f"s.{k} = p.{k}" for k in names)
    return chain(keys, table, train, only) + "," + fill(RANKED, keys=keys, pkeys=", ".join(f"p.{k}" for k in names), same=same)


def top(keys: str = "doc_id", table: str = "documents", train: str = "true", only: str = "true", threshold: float = 0.2) -> str:
    """A whole statement: keys, lang, score; documents without tokens are unknown."""
    names = keys.split(", ")
    same = " AND ".join(f"d.{k} = b.{k}" for k in names)
    return detection(keys, table, train, only) + (
        f" SELECT {', '.join(f'd.{k}' for k in names)}, CASE WHEN b.score >= {threshold} THEN b.lang ELSE '?' END AS lang, "
        f"CASE WHEN b.score >= {threshold} THEN round(b.score, 6) ELSE 1.0 END AS score "
        f"FROM (SELECT {keys} FROM {table}) d LEFT JOIN (SELECT * FROM listed WHERE k = 1) b ON {same}"
    )


PREDICTED = "judged AS (SELECT d.lang AS expected, p.lang AS predicted, p.doc_id FROM ({top}) p JOIN documents d ON d.doc_id = p.doc_id)"
HELD_OUT = "(SELECT * FROM documents WHERE doc_id % 5 = 0)"


def evaluated(rest: str, threshold: float = 0.2) -> str:
    inner = top("doc_id", HELD_OUT, "doc_id % 5 <> 0", threshold=threshold)
    return f"WITH {fill(PREDICTED, top=inner)} {rest}"
