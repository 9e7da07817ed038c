"""Sampling, chunking, and statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import space_words

SEED = 42


def seeded(key: str, seed: int = SEED) -> Column:
    """An order that depends on key and seed alone."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_per_language(docs: DataFrame, n: int, key: str = "doc_id", lang: str = "lang", seed: int = SEED) -> DataFrame:
    """lang, key: exactly n rows of each language, or all it has."""
    order = Window.partitionBy(lang).orderBy(seeded(key, seed), key)
    return docs.select(lang, key, F.row_number().over(order).alias("k")).where(F.col("k") <= n).select(lang, key)


def keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """With a key made of the row itself, so that it is the same in a rerun."""
    return docs.withColumn(key, F.xxhash64(*docs.columns))


def shuffled(docs: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    return docs.orderBy(seeded(key, seed), key)


def length_between(docs: DataFrame, low: int, high: int, text: str = "text") -> DataFrame:
    """Texts of low to high code points without outer white space."""
    return docs.where(F.length(F.trim(text)).between(low, high))


def chunks(sentences: DataFrame, size: int, key: str, pos: str = "pos", text: str = "sentence") -> DataFrame:
    """key, chunk, text: every ``size`` sentences in a row joined by blanks; a short tail is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1
    grouped = sentences.select(key, text, place.alias("k")).groupBy(key, F.floor(F.col("k") / size).cast("int").alias("chunk"))
    whole = grouped.agg(F.sort_array(F.collect_list(F.struct("k", text))).alias("xs")).where(F.size("xs") == size)
    return whole.select(key, "chunk", F.array_join(F.transform("xs", lambda x: x[text]), " ").alias("text"))


def unique_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """first_<key>, n: distinct texts by their first key."""
    by = docs.groupBy(text).agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("n"))
    return by.select(f"first_{key}", "n")


def word_stats(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """by, docs, words, bytes"""
    words = F.size(space_words(F.col(text)))
    return docs.groupBy(*by).agg(
        F.count("*").alias("docs"), F.sum(words).alias("words"), F.sum(F.octet_length(text)).alias("bytes")
    )


def batch_gate(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """by, docs, words, parallel_ok: whether a batch has two inputs and fifty words. For information."""
    stats = word_stats(docs, *by, text=text)
    return stats.select(*by, "docs", "words", ((F.col("docs") >= 2) & (F.col("words") >= 50)).alias("parallel_ok"))


def upper_median(column: str) -> Column:
    """Element n / 2 of the sorted values; of bounded groups, such as timings."""
    return F.get(F.sort_array(F.collect_list(column)), F.floor(F.count(column) / 2).cast("int"))


def true_median(column: str) -> Column:
    """The mean of the two middle values where their number is even."""
    return F.expr(f"percentile({column}, 0.5)")


def length_means(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """by, mean_words, mean_bytes"""
    stats = word_stats(docs, *by, text=text)
    return stats.select(*by, F.try_divide("words", "docs").alias("mean_words"), F.try_divide("bytes", "docs").alias("mean_bytes"))


def by_work(docs: DataFrame, text: str = "text") -> DataFrame:
    """From the fewest words to the most, with their number as ``work``."""
    return docs.withColumn("work", F.coalesce(F.size(space_words(F.col(text))), F.lit(0))).orderBy("work")


def length_percentiles(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, p50, p95, p99, max_n of code points: element floor(n p) of the sorted lengths, from counts of lengths."""
    counts = docs.where(F.col(text).isNotNull()).groupBy(by, F.length(text).alias("len")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(by)
    upto = F.sum("c").over(group.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(by, "len", upto.alias("upto"), F.sum("c").over(group).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("len")))
    return ranked.groupBy(by).agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.max("len").alias("max_n"))


def representative(docs: DataFrame, pos: str, text: str = "text", low: int = 20, high: int = 60) -> DataFrame:
    """The first text of more than low and fewer than high bytes, or else the first row."""
    fits = (F.octet_length(text) > low) & (F.octet_length(text) < high)
    return docs.orderBy(F.when(fits, 0).otherwise(1), pos).limit(1)


def representative_paragraph(docs: DataFrame, pos: str, text: str = "text", low: int = 60, high: int = 120) -> DataFrame:
    """The first text of at least low and fewer than high words, or else the first row."""
    fits = F.coalesce(F.size(space_words(F.col(text))).between(low, high - 1), F.lit(False))
    return docs.orderBy(F.when(fits, 0).otherwise(1), pos).limit(1)
