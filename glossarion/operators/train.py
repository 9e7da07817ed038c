"""Training: a rank dictionary and a smoothed trigram model from labelled text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.langs import LANGS, langs_table
from ..functions.text import tokens, trigrams

# Fixed values.
TOP_N, DICT_SIZE, TRIGRAM_K, ALPHA = 10_000, 3_000, 3_000, 0.5
#: Rows of a model's table that are sent to every executor.
MOST_SENT = 200_000


def word_frequencies(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, token, freq"""
    exploded = docs.where(F.col(lang).isin(*LANGS)).select(F.col(lang).alias("lang"), F.explode(tokens(F.col(text))).alias("token"))
    return exploded.groupBy("lang", "token").agg(F.count("*").alias("freq"))


#: Parts that a language's rows are ranked in before the best of all parts are.
PARTS = 64


def ranked(rows: DataFrame, n: int, by: str, name: str) -> DataFrame:
    """The rows with their place (from 1, as ``place__``) among those of their language, for the first n: most of ``by`` first, then by name.

    A language may hold most of the rows, so its rows are ranked in PARTS parts first; no task sorts more than
    its part, and the last one PARTS times n rows."""
    order = (F.desc(by), F.asc(name))
    part = F.pmod(F.xxhash64(name), F.lit(PARTS))
    best = rows.withColumn("part__", part).withColumn("place__", F.row_number().over(Window.partitionBy("lang", "part__").orderBy(*order)))
    last = best.where(F.col("place__") <= n).withColumn("place__", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return last.where(F.col("place__") <= n).drop("part__")


def rank_dictionary(freq: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """lang, token, freq, rnk: the top_n words of each language, from rank 0."""
    return ranked(freq.select("lang", "token", "freq"), top_n, "freq", "token").select("lang", "token", "freq", (F.col("place__") - 1).alias("rnk"))


def first_occurrences(words: DataFrame) -> DataFrame:
    """lang, token, freq of a raw list (lang, line, token, freq): of equal tokens the first line counts."""
    firsts = words.groupBy("lang", "token").agg(F.min_by("freq", "line").alias("freq"), F.min("line").alias("line"))
    return firsts.select("lang", "token", "freq")


def trigram_counts(words: DataFrame) -> DataFrame:
    """lang, tri, c: each occurrence of a trigram in a word counts the word's frequency."""
    exploded = words.select("lang", "freq", F.explode(trigrams(F.col("token"))).alias("tri"))
    return exploded.groupBy("lang", "tri").agg(F.sum("freq").alias("c"))


def trigram_totals(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """lang, vocab, denom, floor"""
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count("*").alias("vocab"))
    denom = F.col("total") + F.lit(alpha) * F.col("vocab")
    return totals.select("lang", "vocab", denom.alias("denom"), F.log(F.lit(alpha) / denom).alias("floor"))


def trigram_model(counts: DataFrame, k: int = TRIGRAM_K, alpha: float = ALPHA) -> DataFrame:
    """lang, tri, lp: the k most frequent trigrams of each language, ties by trigram."""
    top = ranked(counts, k, "c", "tri")
    denoms = trigram_totals(counts, alpha).select("lang", "denom")
    return top.join(denoms, "lang").select("lang", "tri", F.log((F.col("c") + F.lit(alpha)) / F.col("denom")).alias("lp"))


@dataclass(frozen=True)
class Model:
    """langs (lang, ord), dictionary (token, lang, rnk), trigrams (lang, tri, lp), floors (lang, lp).

    The tables are bounded by the languages and the sizes asked for, never by the
    corpus: at most DICT_SIZE and TRIGRAM_K rows a language. ``most_rows`` is what no
    table exceeds, None where that is not known."""

    langs: DataFrame
    dictionary: DataFrame
    trigrams: DataFrame
    floors: DataFrame
    most_rows: int | None = None

    def order(self) -> list[str]:
        """The languages, at most ten, in the order that settles ties."""
        return [r["lang"] for r in self.langs.orderBy("ord").collect()]

    def sent(self, table: DataFrame) -> DataFrame:
        """A table of at most ``most_rows`` rows, broadcast if these are few enough; else joins shuffle."""
        return F.broadcast(table) if self.most_rows is not None and self.most_rows <= MOST_SENT else table

    def save(self, path: str) -> None:
        for name in ("langs", "dictionary", "trigrams", "floors"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("langs", "dictionary", "trigrams", "floors")]
        return cls(*tables, max(x.count() for x in tables))

    def only(self, langs: tuple[str, ...]) -> Model:
        """Of the given languages alone, in that order. Filters reach the model's scans."""
        known = set(self.order())
        keep = F.col("lang").isin(*langs)
        table = langs_table(self.langs.sparkSession, [x for x in langs if x in known])
        return Model(table, self.dictionary.where(keep), self.trigrams.where(keep), self.floors.where(keep), self.most_rows)

    def tier(self, dict_size: int) -> Model:
        return replace(self, dictionary=self.dictionary.where(F.col("rnk") < dict_size))

    def cached(self) -> Model:
        """The same with its small tables kept in memory, for several detections."""
        return Model(self.langs.cache(), self.dictionary.cache(), self.trigrams.cache(), self.floors.cache(), self.most_rows)

    def stored(self, path: str) -> Model:
        """The same, saved and read back, so that it is trained once."""
        self.save(path)
        return Model.load(self.langs.sparkSession, path)


def train_model(
    docs: DataFrame, lang: str = "lang", text: str = "text", *, top_n: int = TOP_N, dict_size: int = DICT_SIZE,
    trigram_k: int = TRIGRAM_K, alpha: float = ALPHA,
) -> Model:
    """Every language of a labelled table at once."""
    # The labels' column alone is read for this; what comes back is at most ten codes.
    found = {r[0] for r in docs.where(F.col(lang).isin(*LANGS)).select(lang).distinct().collect()}
    freq = word_frequencies(docs, lang, text)
    return model_of(freq, found, top_n=top_n, dict_size=dict_size, trigram_k=trigram_k, alpha=alpha)


def model_of(
    freq: DataFrame, langs: Iterable[str], *, top_n: int = TOP_N, dict_size: int = DICT_SIZE, trigram_k: int = TRIGRAM_K,
    alpha: float = ALPHA,
) -> Model:
    """From word frequencies (lang, token, freq) of the given languages, such as read lists."""
    words = rank_dictionary(freq, top_n)
    counts = trigram_counts(words)
    totals = trigram_totals(counts, alpha)
    return Model(
        langs_table(freq.sparkSession, [x for x in LANGS if x in langs]),
        words.where(F.col("rnk") < dict_size).select("token", "lang", "rnk"),
        trigram_model(counts, trigram_k, alpha),
        totals.select("lang", F.col("floor").alias("lp")),
        len(LANGS) * max(dict_size, trigram_k, 1),
    )
