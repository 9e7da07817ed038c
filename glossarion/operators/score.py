"""Scores of words: the dictionary first, character trigrams for words it does not have.

Everything depends on the distinct vocabulary alone, so words are scored once and
joined to term frequencies afterwards. A word's scores are kept in one row as
array<double> in the order of the model's languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .train import Model

# Fixed value: the dampener of the rank prior.
PRIOR_K = 10.0
#: For a language without any trigram, which so never wins a word.
NO_FLOOR = -1e6


def dict_lookup(vocab: DataFrame, model: Model) -> DataFrame:
    """token, lang, rnk: a row for each language that has the word."""
    return vocab.join(model.sent(model.dictionary), "token").select("token", "lang", "rnk")


def dict_miss(vocab: DataFrame, model: Model) -> DataFrame:
    known = model.dictionary.select("token").distinct()
    return vocab.join(model.sent(known), "token", "left_anti").select("token")


def dict_priors(model: Model) -> DataFrame:
    """token, lang, s: of the model's whole dictionary; the scores of a word sum to 1."""
    w = 1.0 / (F.col("rnk") + F.lit(PRIOR_K))
    return model.dictionary.select("token", "lang", (w / F.sum(w).over(Window.partitionBy("token"))).alias("s"))


def wide_trigrams(model: Model, langs: list[str]) -> DataFrame:
    """tri, lps: a row for each trigram, its log-probabilities in the order of langs; null where a floor applies."""
    lps = [F.max(F.when(F.col("lang") == x, F.col("lp"))) for x in langs]
    return model.trigrams.groupBy("tri").agg(F.array(*lps).alias("lps"))


def ngram_scores(words: DataFrame, model: Model, langs: list[str] | None = None) -> DataFrame:
    """token, s: array<double>, the softmax of summed trigram log-probabilities."""
    langs = langs if langs is not None else model.order()
    floors = model.floors.groupBy().agg(*[F.max(F.when(F.col("lang") == x, F.col("lp"))).alias(f"floor{k}") for k, x in enumerate(langs)])
    exploded = words.select("token", F.explode(trigrams(F.col("token"))).alias("tri"))
    hits = exploded.join(model.sent(wide_trigrams(model, langs)), "tri", "left")
    sums = hits.groupBy("token").agg(
        *[F.sum(F.get("lps", F.lit(k))).alias(f"sum{k}") for k in range(len(langs))],
        *[F.count(F.get("lps", F.lit(k))).alias(f"hit{k}") for k in range(len(langs))],
        F.count("*").alias("n"),
    )
    # One row.
    raw = sums.join(F.broadcast(floors)).select(
        "token",
        F.array(*[
            F.coalesce(F.col(f"sum{k}"), F.lit(0.0)) + (F.col("n") - F.col(f"hit{k}")) * F.coalesce(F.col(f"floor{k}"), F.lit(NO_FLOOR)) for k in range(len(langs))
        ]).alias("r"),
    )
    shifted = raw.select("token", F.transform("r", lambda x: F.exp(x - F.array_max("r"))).alias("e"))
    return shifted.select("token", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("s"))


def word_scores(vocab: DataFrame, model: Model) -> DataFrame:
    """token, source (dict or ngram), s: array<double> by language, conf: its largest."""
    langs = model.order()
    wide = dict_priors(model).groupBy("token").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("s"))), F.lit(0.0)) for x in langs]).alias("s")
    )
    hits = vocab.select("token").join(model.sent(wide), "token").select("token", F.lit("dict").alias("source"), "s")
    misses = ngram_scores(dict_miss(vocab, model), model, langs).select("token", F.lit("ngram").alias("source"), "s")
    return hits.unionByName(misses).select("token", "source", "s", F.array_max("s").alias("conf"))
