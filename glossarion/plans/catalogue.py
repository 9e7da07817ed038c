"""The engine's queries over the driver's tables, each with the SQL that checks it.

The model is trained from ``documents`` of the same folder. Doubles are rounded to six
places in both."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import langs_table, supported_languages
from ..functions.text import clean_tsv, space_words, trigrams, truncated
from ..operators import evaluate, sample
from ..operators.detect import LanguageDetector
from ..operators.score import dict_miss as missing_words
from ..operators.score import dict_priors as word_priors
from ..operators.score import ngram_scores, word_scores
from ..operators.tokenize import spread, term_frequencies
from ..operators.train import Model, rank_dictionary, train_model, trigram_counts, trigram_model, trigram_totals, word_frequencies
from ..sources import readers, writers
from ..streaming.scorer import detect_stream, register
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_trained: dict[tuple[str, str], Model] = {}
_detectors: dict[int, LanguageDetector] = {}


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the folder's documents: trained and saved once for each application, read wherever it is used."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = train_model(table(spark, sf_dir)).stored(f"{scratch(spark)}/model-{uuid.uuid4().hex}")
    return _trained[key]


def detector(spark: SparkSession, sf_dir: str) -> LanguageDetector:
    """The detector of that model, one for each model, so that its tables are brought to the driver once."""
    model = trained(spark, sf_dir)
    return _detectors.setdefault(id(model), LanguageDetector(model))


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set, as in tests, one of this machine."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shared-")


def _words(docs: DataFrame) -> DataFrame:
    return rank_dictionary(word_frequencies(docs))


def _vocab(docs: DataFrame) -> DataFrame:
    return term_frequencies(docs).select("token")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def _top(found: DataFrame, *keys: str) -> DataFrame:
    return _rounded(found.select(*keys, "lang", "score"), "score")


MODEL_ONLY = "WITH " + o.fill(o.MODEL, train="true")


@query(f"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({o.toks('text')}) AS token FROM documents) GROUP BY doc_id, token")
def tokenize_words(spark, sf_dir):
    return term_frequencies(table(spark, sf_dir), "doc_id")


WORDS = r"len(regexp_extract_all(text, '\S+'))"


@query(f"SELECT source, count(*) AS docs, CAST(sum({WORDS}) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def ws_word_stats(spark, sf_dir):
    return sample.word_stats(table(spark, sf_dir), "source")


@query(
    f"SELECT source, count(*) AS docs, CAST(sum({WORDS}) AS BIGINT) AS words, count(*) >= 2 AND sum({WORDS}) >= 50 AS parallel_ok FROM documents GROUP BY source"
)
def batch_gate(spark, sf_dir):
    return sample.batch_gate(table(spark, sf_dir), "source")


@query(MODEL_ONLY + " SELECT lang, token, freq FROM freq")
def word_freq(spark, sf_dir):
    return word_frequencies(table(spark, sf_dir))


@query(MODEL_ONLY + " SELECT lang, token, rnk FROM ranked",
    name="rank_dictionary",
)
def rank_dictionary_words(spark, sf_dir):
    return _words(table(spark, sf_dir)).select("lang", "token", F.col("rnk").cast("long").alias("rnk"))


@query(
    MODEL_ONLY + " SELECT lang, CAST(tier AS INTEGER) AS tier, count(*) AS words FROM ranked JOIN (VALUES (1000), (3000), (5000), (10000)) t(tier) "
    "ON rnk < tier GROUP BY lang, tier"
)
def dict_tiers(spark, sf_dir):
    tiers = F.explode(F.array(*map(F.lit, (1000, 3000, 5000, 10000)))).alias("tier")
    return _words(table(spark, sf_dir)).select("lang", "rnk", tiers).where("rnk < tier").groupBy("lang", "tier").agg(F.count("*").alias("words"))


@query(
    f"WITH v AS (SELECT DISTINCT unnest({o.toks('text')}) AS token FROM documents) "
    f"SELECT token, tri, count(*) AS n FROM ({o.grams('v', 'token')}) GROUP BY token, tri"
)
def trigrams_of_words(spark, sf_dir):
    exploded = _vocab(table(spark, sf_dir)).select("token", F.explode(trigrams(F.col("token"))).alias("tri"))
    return exploded.groupBy("token", "tri").agg(F.count("*").alias("n"))


@query(MODEL_ONLY + " SELECT lang, tri, CAST(c AS BIGINT) AS c FROM cnt",
    name="trigram_counts",
)
def trigram_frequencies(spark, sf_dir):
    return trigram_counts(_words(table(spark, sf_dir)))


@query(MODEL_ONLY + " SELECT lang, tri, round(lp, 6) AS lp FROM tri_all",
    name="trigram_model",
)
def trigram_log_probs(spark, sf_dir):
    return _rounded(trigram_model(trigram_counts(_words(table(spark, sf_dir)))), "lp")


@query(MODEL_ONLY + " SELECT lang, vocab, round(floor, 6) AS floor FROM tot")
def trigram_floor(spark, sf_dir):
    return _rounded(trigram_totals(trigram_counts(_words(table(spark, sf_dir)))).select("lang", "vocab", "floor"), "floor")


@query(o.chain() + " SELECT d.token, d.lang, d.rnk FROM dict d JOIN vocab ON d.token = vocab.token")
def dict_lookup(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = trained(spark, sf_dir)
    found = _vocab(docs).join(model.sent(model.dictionary), "token")
    return found.select("token", "lang", F.col("rnk").cast("long").alias("rnk"))


@query(o.chain() + " SELECT token, lang, round(s, 6) AS s FROM priors")
def dict_priors(spark, sf_dir):
    return _rounded(word_priors(trained(spark, sf_dir)), "s")


@query(o.chain() + " SELECT token FROM miss")
def dict_miss(spark, sf_dir):
    docs = table(spark, sf_dir)
    return missing_words(_vocab(docs), trained(spark, sf_dir))


def _long(scores: DataFrame, langs: list[str], *columns: str) -> DataFrame:
    """A row for each language from an array of scores."""
    pairs = F.arrays_zip(F.array(*map(F.lit, langs)).alias("lang"), F.col("s").alias("s"))
    return scores.select(*columns, F.explode(pairs).alias("p")).select(*columns, F.col("p.lang").alias("lang"), F.round("p.s", 6).alias("s"))


@query(o.chain() + " SELECT token, lang, round(s, 6) AS s FROM soft")
def ngram_softmax(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = trained(spark, sf_dir)
    return _long(ngram_scores(missing_words(_vocab(docs), model), model), model.order(), "token")


@query(o.chain() + " SELECT token, lang, round(s, 6) AS s, round(conf, 6) AS conf, source FROM ws",
    name="word_scores",
)
def word_score_table(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = trained(spark, sf_dir)
    scores = word_scores(_vocab(docs), model).withColumn("conf", F.round("conf", 6))
    long = _long(scores, model.order(), "token", "conf", "source")
    listed = model.dictionary.select(F.col("token").alias("t"), F.col("lang").alias("l"))
    kept = long.join(model.sent(listed), (F.col("token") == F.col("t")) & (F.col("lang") == F.col("l")), "left")
    return kept.where("source = 'ngram' OR t IS NOT NULL").select("token", "lang", "s", "conf", "source")


@query(
    o.chain() + ", one AS (SELECT DISTINCT token, source FROM ws) SELECT doc_id, source, CAST(sum(n) AS BIGINT) AS n FROM tf JOIN one ON tf.token = one.token GROUP BY doc_id, source"
)
def source_mix(spark, sf_dir):
    docs = table(spark, sf_dir)
    model = trained(spark, sf_dir)
    known = model.dictionary.select(F.col("token").alias("known")).distinct()
    tagged = term_frequencies(docs, "doc_id").join(model.sent(known), F.col("token") == F.col("known"), "left")
    source = F.when(F.col("known").isNotNull(), "dict").otherwise("ngram").alias("source")
    return tagged.groupBy("doc_id", source).agg(F.sum("n").alias("n"))


@query(o.top())
def detect_top(spark, sf_dir):
    docs = table(spark, sf_dir)
    return _top(detector(spark, sf_dir).detect(docs, "doc_id"), "doc_id")


@query(o.top())
def detect_top_relational(spark, sf_dir):
    """detect_top from joins and aggregations alone."""
    return _top(detector(spark, sf_dir).detect_relational(table(spark, sf_dir), "doc_id"), "doc_id")


@query(
    o.detection() + " SELECT l.doc_id, k, CASE WHEN top < 0.2 THEN '?' ELSE lang END AS lang, CASE WHEN top < 0.2 THEN 1.0 ELSE round(score, 6) END AS score "
    "FROM listed l JOIN best b ON l.doc_id = b.doc_id WHERE top >= 0.2 OR k = 1 "
    "UNION ALL SELECT doc_id, 1, '?', 1.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tf)"
)
def detect_distribution(spark, sf_dir):
    docs = table(spark, sf_dir)
    found = detector(spark, sf_dir).detect(docs, "doc_id")
    rows = found.select("doc_id", F.posexplode("distribution").alias("pos", "d"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("k"), F.col("d.lang").alias("lang"), F.round("d.score", 6).alias("score"))


@query(o.top(only="tot.lang IN ('en', 'de')").replace("ord, floor", "CASE tot.lang WHEN 'en' THEN 0 ELSE 1 END AS ord, floor"))
def detect_only_en_de(spark, sf_dir):
    docs = table(spark, sf_dir)
    return _top(detector(spark, sf_dir).only(["en", "de"]).detect(docs, "doc_id"), "doc_id")


@query(o.top(threshold=0.6))
def detect_unknown_gate(spark, sf_dir):
    docs = table(spark, sf_dir)
    return _top(detector(spark, sf_dir).unknown_threshold(0.6).detect(docs, "doc_id"), "doc_id")


@query(o.top("conv_id, turn", "conversations"))
def detect_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return _top(detector(spark, sf_dir).detect(rows, "conv_id", "turn"), "conv_id", "turn")


@query(o.top("item_id", "benchmark"))
def detect_benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return _top(detector(spark, sf_dir).detect(rows, "item_id"), "item_id")


@query(
    o.chain("item_id", "benchmark")
    + f", placed AS (SELECT item_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token FROM (SELECT item_id, {o.toks('text')} AS ts FROM benchmark)) "
    "SELECT item_id, CAST(pos AS INTEGER) AS pos, p.token, source, lang, round(s, 6) AS s FROM placed p JOIN ws ON p.token = ws.token"
)
def detect_words(spark, sf_dir):
    found = detector(spark, sf_dir).detect_words(table(spark, sf_dir, "benchmark"), "item_id")
    rows = found.select("item_id", "pos", "token", "source", F.explode("scores").alias("x"))
    return rows.select("item_id", "pos", "token", "source", F.col("x.lang").alias("lang"), F.round("x.score", 6).alias("s"))


@query(
    o.chain("item_id", "benchmark")
    + f", c AS (SELECT item_id, len({o.toks('text')}) AS n_words FROM benchmark) SELECT item_id, CAST(n_words AS INTEGER) AS n_words FROM c"
)
def detect_detailed(spark, sf_dir):
    found = detector(spark, sf_dir).detect_detailed(table(spark, sf_dir, "benchmark"), "item_id")
    return found.select("item_id", F.size("words").alias("n_words"))


PLACED = (
    f", placed AS (SELECT doc_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token FROM (SELECT doc_id, {o.toks('text')} AS ts FROM documents))"
)


@query(
    o.chain() + PLACED
    + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, p.token, source, lang, round(s, 6) AS s FROM placed p JOIN ws ON p.token = ws.token"
)
def detect_words_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    found = detector(spark, sf_dir).detect_words(docs, "doc_id")
    rows = found.select("doc_id", "pos", "token", "source", F.explode("scores").alias("x"))
    return rows.select("doc_id", "pos", "token", "source", F.col("x.lang").alias("lang"), F.round("x.score", 6).alias("s"))


def _listed(scores: Column) -> Column:
    """Languages with their scores in millionths, in order."""
    return F.array_join(F.transform(scores, lambda x: F.concat(x["lang"], F.lit("="), F.floor(x["score"] * 1e6 + 0.5).cast("string"))), ",")


@query(
    o.detection() + PLACED
    + ", shown AS (SELECT token, any_value(source) AS source, string_agg(ws.lang || '=' || CAST(floor(s * 1e6 + 0.5) AS BIGINT), ',' ORDER BY ord) AS scores "
    "FROM ws JOIN langs ON ws.lang = langs.lang GROUP BY token), "
    "digests AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (source = 'dict') AS n_dict, "
    "md5(string_agg(p.token || ':' || source || ':' || scores, ' ' ORDER BY pos)) AS words_md5 FROM placed p JOIN shown w ON p.token = w.token GROUP BY doc_id), "
    "sums AS (SELECT doc_id, CASE WHEN max(score) < 0.2 THEN '?=1000000' ELSE "
    "string_agg(lang || '=' || CAST(floor(score * 1e6 + 0.5) AS BIGINT), ',' ORDER BY k) END AS aggregate FROM listed GROUP BY doc_id) "
    "SELECT d.doc_id, CAST(coalesce(n_words, 0) AS INTEGER) AS n_words, CAST(coalesce(n_dict, 0) AS INTEGER) AS n_dict, coalesce(words_md5, md5('')) AS words_md5, "
    "CASE WHEN d.text IS NOT NULL THEN coalesce(aggregate, '?=1000000') END AS aggregate "
    "FROM documents d LEFT JOIN digests g ON d.doc_id = g.doc_id LEFT JOIN sums t ON d.doc_id = t.doc_id"
)
def detect_detailed_documents(spark, sf_dir):
    """Tokens, sources and scores of all words as a digest in text order, and the aggregate."""
    docs = table(spark, sf_dir)
    found = detector(spark, sf_dir).detect_detailed(docs, "doc_id")
    shown = F.transform("words", lambda w: F.concat_ws(":", w["token"], w["source"], _listed(w["scores"])))
    n_dict = F.size(F.filter("words", lambda w: w["source"] == "dict"))
    return found.select(
        "doc_id", F.size("words").alias("n_words"), n_dict.alias("n_dict"), F.md5(F.array_join(shown, " ")).alias("words_md5"), _listed(F.col("aggregate")).alias("aggregate")
    )


@query(
    o.detection() + " SELECT a.doc_id, a.lang AS lang1, b.lang AS lang2 FROM listed a JOIN listed b ON a.doc_id = b.doc_id "
    "WHERE a.k = 1 AND b.k = 2 AND round(b.score, 6) > 0.1 AND a.score >= 0.2"
)
def mixed_language_docs(spark, sf_dir):
    docs = table(spark, sf_dir)
    d = F.col("distribution")
    found = detector(spark, sf_dir).detect(docs, "doc_id").where(F.size(d) > 1)
    second = F.get(d, F.lit(1))
    return found.where(F.round(second["score"], 6) > 0.1).select("doc_id", F.get(d, F.lit(0))["lang"].alias("lang1"), second["lang"].alias("lang2"))


@query("SELECT id, '?' AS lang, 1.0::DOUBLE AS score FROM (VALUES (0), (1), (2)) t(id)")
def empty_input(spark, sf_dir):
    rows = spark.createDataFrame([(0, ""), (1, " \t\n "), (2, "123 45.6 --")], "id int, text string")
    return _top(detector(spark, sf_dir).detect(rows, "id"), "id")


_judges: dict[tuple[str, str], LanguageDetector] = {}


def judge(spark: SparkSession, sf_dir: str) -> LanguageDetector:
    """A detector that has not seen the held-out fifth of the documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _judges:
        model = train_model(table(spark, sf_dir).where("doc_id % 5 <> 0")).stored(f"{scratch(spark)}/model-{uuid.uuid4().hex}")
        _judges[key] = LanguageDetector(model)
    return _judges[key]


def judged(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    """doc_id, expected, predicted of the held-out fifth."""
    held = table(spark, sf_dir).where("doc_id % 5 = 0").withColumnRenamed("lang", "expected")
    own = judge(spark, sf_dir)
    found = (own if threshold is None else own.unknown_threshold(threshold)).detect(held, "doc_id", "expected")
    return found.select("doc_id", "expected", F.col("lang").alias("predicted"))


#: A threshold at which some documents count as unknown, so that there are misses to report.
STRICT = 0.9


RIGHT = "CAST(sum(CASE WHEN expected = predicted THEN 1 ELSE 0 END) AS BIGINT)"


@query(o.evaluated(f"SELECT count(*) AS n, {RIGHT} AS correct, round(100.0 * {RIGHT} / count(*), 6) AS pct FROM judged"))
def accuracy_overall(spark, sf_dir):
    return _rounded(evaluate.overall_accuracy(judged(spark, sf_dir)), "pct")


@query(o.evaluated(f"SELECT expected AS lang, count(*) AS n, {RIGHT} AS correct, round(100.0 * {RIGHT} / count(*), 6) AS pct FROM judged GROUP BY expected"))
def accuracy_by_lang(spark, sf_dir):
    return _rounded(evaluate.accuracy_by_language(judged(spark, sf_dir)), "pct")


@query(
    o.evaluated(
        ", sides AS (SELECT expected AS lang, CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END AS tp, 0.0 AS fp, CASE WHEN expected = predicted THEN 0.0 ELSE 1.0 END AS fn FROM judged "
        "UNION ALL SELECT predicted, 0.0, CASE WHEN expected = predicted THEN 0.0 ELSE 1.0 END, 0.0 FROM judged), "
        "s AS (SELECT lang, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM sides GROUP BY lang), "
        "pr AS (SELECT lang, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM s) "
        "SELECT lang, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr"
    )
)
def precision_recall_f1(spark, sf_dir):
    return _rounded(evaluate.precision_recall_f1(judged(spark, sf_dir)), "p", "r", "f1")


PIVOT = ", ".join(f"count(*) FILTER (predicted = '{x}') AS \"{x}\"" for x in ("de", "en", "es", "fr", "?"))


@query(o.evaluated(f"SELECT expected, {PIVOT} FROM judged GROUP BY expected", threshold=STRICT))
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(judged(spark, sf_dir, STRICT), ["de", "en", "es", "fr", "?"])


@query(o.evaluated("SELECT expected, predicted, count(*) AS n FROM judged GROUP BY expected, predicted"))
def confusion(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir))


@query(
    o.evaluated(
        ", m AS (SELECT expected AS lang, predicted, count(*) AS n FROM judged WHERE expected <> predicted GROUP BY expected, predicted) "
        "SELECT lang, CAST(k AS INTEGER) AS k, predicted, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, predicted) AS k FROM m) WHERE k <= 2",
        threshold=STRICT,
    )
)
def common_miss(spark, sf_dir):
    return evaluate.common_misses(judged(spark, sf_dir, STRICT))


MISSED = (
    f", counted AS (SELECT j.doc_id, j.expected, j.predicted, len({o.toks('d.text')}) AS n_words FROM judged j JOIN documents d ON d.doc_id = j.doc_id "
    "WHERE j.expected <> j.predicted) SELECT doc_id, expected, predicted, CAST(coalesce(n_words, 0) AS INTEGER) AS n_words FROM counted"
)


@query(o.evaluated(MISSED, threshold=STRICT))
def misclassified(spark, sf_dir):
    """The misclassified documents with their words, of which the number is shown."""
    rows = judged(spark, sf_dir, STRICT)
    texts = table(spark, sf_dir).join(evaluate.misses(rows).select("doc_id"), "doc_id", "left_semi")
    words = judge(spark, sf_dir).detect_words(texts, "doc_id")
    found = evaluate.misses_with_words(rows, words)
    return found.select("doc_id", "expected", "predicted", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"))


@query(MODEL_ONLY + " SELECT lang, token, CAST(rnk AS INTEGER) AS rnk FROM dict_all")
def words_round_trip(spark, sf_dir):
    """The dictionary written as word lists and read back."""
    model, folder = trained(spark, sf_dir), f"{scratch(spark)}/lists-{uuid.uuid4().hex}"
    writers.words(model.dictionary, folder)
    lists = [readers.word_list(spark, f"{folder}/lang={x}", x) for x in model.order()]
    return reduce(DataFrame.unionByName, lists).select("lang", "token", "rnk")


@query(MODEL_ONLY + " SELECT lang, tri, round(lp, 6) AS lp FROM tri_all UNION ALL SELECT lang, 'FLOOR', round(floor, 6) FROM tot")
def trigrams_round_trip(spark, sf_dir):
    """The trigrams and floors written as lists and read back."""
    model, folder = trained(spark, sf_dir), f"{scratch(spark)}/lists-{uuid.uuid4().hex}"
    writers.trigrams(model.trigrams, model.floors, folder)
    lists = [x for lang in model.order() for x in readers.trigram_list(spark, f"{folder}/lang={lang}", lang)]
    whole = [x if "tri" in x.columns else x.withColumn("tri", F.lit("FLOOR")) for x in lists]
    return _rounded(reduce(DataFrame.unionByName, [x.select("lang", "tri", "lp") for x in whole]), "lp")


@query(r"SELECT lang, trim(regexp_replace(text, '[\t\r\n]', ' ', 'g')) AS text, count(*) AS n FROM documents "
       r"WHERE trim(regexp_replace(text, '[\t\r\n]', ' ', 'g')) <> '' GROUP BY ALL")
def evaluation_round_trip(spark, sf_dir):
    """The documents written as an evaluation file and read back."""
    folder = f"{scratch(spark)}/evaluation-{uuid.uuid4().hex}"
    writers.evaluation_tsv(table(spark, sf_dir), folder)
    rows = readers.labelled_tsv(spark, folder).select("lang", F.trim("text").alias("text")).where("text <> ''")
    return rows.groupBy("lang", "text").agg(F.count("*").alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS pos, text FROM benchmark")
def json_round_trip(spark, sf_dir):
    """The benchmark's texts written as one JSON array and read back."""
    folder = f"{scratch(spark)}/json-{uuid.uuid4().hex}"
    writers.json_array(table(spark, sf_dir, "benchmark"), folder, "item_id")
    return readers.json_strings(spark, folder)


@query(
    f"SELECT source, round(CAST(sum({WORDS}) AS DOUBLE) / count(*), 6) AS mean_words, round(CAST(sum(strlen(text)) AS DOUBLE) / count(*), 6) AS mean_bytes "
    "FROM documents GROUP BY source"
)
def length_means(spark, sf_dir):
    return _rounded(sample.length_means(table(spark, sf_dir), "source"), "mean_words", "mean_bytes")


@query("SELECT lang, median(length(text)) AS median_length FROM documents GROUP BY lang")
def length_medians(spark, sf_dir):
    return table(spark, sf_dir).withColumn("n", F.length("text")).groupBy("lang").agg(sample.true_median("n").alias("median_length"))


@query(
    "SELECT DISTINCT label FROM (SELECT lang AS label FROM documents UNION ALL SELECT '?') WHERE label IS NOT NULL"
)
def label_union(spark, sf_dir):
    """The labels of two tables of expected and predicted together."""
    docs = table(spark, sf_dir).select(F.col("lang").alias("expected"), F.lit("?").alias("predicted"))
    return spark.createDataFrame([(x,) for x in evaluate.labels_of(docs, docs.limit(1))], "label string")


@query("SELECT item_id, text FROM benchmark WHERE item_id = (SELECT coalesce(min(item_id) FILTER (" + WORDS + " BETWEEN 60 AND 119), min(item_id)) FROM benchmark)")
def representative_paragraph(spark, sf_dir):
    return sample.representative_paragraph(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "text")


@query("SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) BETWEEN 20 AND 200")
def length_filter(spark, sf_dir):
    return sample.length_between(table(spark, sf_dir), 20, 200).select("doc_id", F.length(F.trim("text")).cast("long").alias("n"))


@query(
    "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS k FROM documents) WHERE k <= 20"
)
def sample_per_lang(spark, sf_dir):
    return sample.sample_per_language(table(spark, sf_dir), 20)


@query(
    "WITH s AS (SELECT doc_id, trim(line) AS sentence, pos FROM (SELECT doc_id, unnest(string_split(text, '.')) AS line, "
    "generate_subscripts(string_split(text, '.'), 1) AS pos FROM documents) WHERE trim(line) <> ''), "
    "r AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM s) "
    "SELECT doc_id, CAST(k // 5 AS INTEGER) AS chunk, string_agg(sentence, ' ' ORDER BY k) AS text FROM r GROUP BY doc_id, k // 5 HAVING count(*) = 5"
)
def paragraph_chunks(spark, sf_dir):
    lines = table(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("pos", "line"))
    sentences = lines.select("doc_id", "pos", F.trim("line").alias("sentence")).where("sentence <> ''")
    return sample.chunks(sentences, 5, "doc_id")


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+')[1:10], ' ') AS text FROM documents WHERE {WORDS} >= 10")
def truncate_words(spark, sf_dir):
    return table(spark, sf_dir).select("doc_id", truncated(F.col("text"), 10).alias("text")).where("text IS NOT NULL")


@query(r"SELECT doc_id, regexp_replace(text, '[\t\r\n]', ' ', 'g') AS text FROM documents",
    name="clean_tsv",
)
def clean_tsv_texts(spark, sf_dir):
    return table(spark, sf_dir).select("doc_id", clean_tsv(F.col("text")).alias("text"))


@query("SELECT min(doc_id) AS first_doc_id, count(*) AS n FROM documents GROUP BY text")
def unique_texts(spark, sf_dir):
    return sample.unique_texts(table(spark, sf_dir))


@query(
    "WITH r AS (SELECT lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text)) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) "
    "SELECT lang, CAST(max(CASE WHEN k = n * 50 // 100 THEN len END) AS INTEGER) AS p50, CAST(max(CASE WHEN k = n * 95 // 100 THEN len END) AS INTEGER) AS p95, CAST(max(CASE WHEN k = n * 99 // 100 THEN len END) AS INTEGER) AS p99, "
    "CAST(max(len) AS INTEGER) AS max_n FROM r GROUP BY lang"
)
def length_percentiles(spark, sf_dir):
    return sample.length_percentiles(table(spark, sf_dir), "lang")


@query(f"SELECT lang, CAST(ord AS INTEGER) AS ord FROM {o.ORDER}",
    name="supported_languages",
)
def supported(spark, sf_dir):
    return langs_table(spark, supported_languages())


@query(f"SELECT doc_id, CAST({WORDS} AS INTEGER) AS n FROM documents")
def space_word_counts(spark, sf_dir):
    return table(spark, sf_dir).select("doc_id", F.size(space_words(F.col("text"))).alias("n"))


@query()
def detect_udf(spark, sf_dir):
    register(spark, detector(spark, sf_dir).scorer)
    rows = table(spark, sf_dir).selectExpr("doc_id", "detect_lang(text) AS found")
    return rows.select("doc_id", "found.lang", F.round("found.score", 6).alias("score"))


@query()
def detect_arrow(spark, sf_dir):
    docs = table(spark, sf_dir).select("doc_id", "text")
    return detect_stream(docs, detector(spark, sf_dir).scorer).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(name="detect_stream")
def detect_stream_query(spark, sf_dir):
    """The documents as a stream, scored without state and written to the shared folder."""
    model = detector(spark, sf_dir).scorer
    docs = spark.readStream.schema(table(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*")
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    found = detect_stream(docs.select("doc_id", "text"), model).select("doc_id", "lang", F.round("score", 6).alias("score"))
    writer = found.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    writer.format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


ORACLE["detect_stream"] = ORACLE["detect_udf"] = ORACLE["detect_arrow"] = ORACLE["detect_top"]
