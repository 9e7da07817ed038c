"""Evaluation of predictions (expected, predicted) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_div


def overall_accuracy(rows: DataFrame) -> DataFrame:
    """n, correct, pct"""
    right = F.sum(F.when(F.col("expected") == F.col("predicted"), 1).otherwise(0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(right, F.lit(0)).alias("correct")).select(
        "n", "correct", (safe_div(F.col("correct"), F.col("n")) * 100).alias("pct")
    )


def accuracy_by_language(rows: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("expected") == F.col("predicted"), 1).otherwise(0)).alias("correct")
    by = rows.groupBy(F.col("expected").alias("lang")).agg(F.count("*").alias("n"), right)
    return by.select("lang", "n", "correct", (safe_div(F.col("correct"), F.col("n")) * 100).alias("pct"))


def label_counts(rows: DataFrame) -> DataFrame:
    """lang, support, tp, fp, fn"""
    right = F.col("expected") == F.col("predicted")
    sides = rows.select(F.explode(F.array(
        F.struct(F.col("expected").alias("lang"), F.lit(1).alias("support"), right.cast("int").alias("tp"), F.lit(0).alias("fp"), (~right).cast("int").alias("fn")),
        F.struct(F.col("predicted").alias("lang"), F.lit(0).alias("support"), F.lit(0).alias("tp"), (~right).cast("int").alias("fp"), F.lit(0).alias("fn")),
    )).alias("x")).select("x.*")
    return sides.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "fp", "fn")])


def precision_recall_f1(rows: DataFrame) -> DataFrame:
    """lang, p, r, f1; 0 where nothing is to be divided by."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    pr = label_counts(rows).select("lang", safe_div(tp, tp + fp).alias("p"), safe_div(tp, tp + fn).alias("r"))
    return pr.select("lang", "p", "r", safe_div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")).alias("f1"))


def confusion(rows: DataFrame) -> DataFrame:
    """expected, predicted, n"""
    return rows.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def labels_of(*tables: DataFrame) -> list[str]:
    """The sorted labels of tables of expected and predicted; languages, so a few codes."""
    each = [t.select(F.col(c).alias("label")) for t in tables for c in ("expected", "predicted")]
    every = each[0]
    for x in each[1:]:
        every = every.unionByName(x)
    return [r["label"] for r in every.where("label IS NOT NULL").distinct().orderBy("label").collect()]


def confusion_matrix(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """expected and a column for each label, by default all that occur."""
    labels = labels_of(rows) if labels is None else labels
    return rows.groupBy("expected").pivot("predicted", labels).count().na.fill(0)


def common_misses(rows: DataFrame, k: int = 2) -> DataFrame:
    """lang, k, predicted, n: the k most frequent wrong predictions of each language, ties by name."""
    missed = rows.where("expected <> predicted").groupBy(F.col("expected").alias("lang"), "predicted").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "predicted")
    return missed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("lang", "k", "predicted", "n")


def merged_misses(k: int = 2, **fixtures: DataFrame) -> DataFrame:
    """lang, k, predicted, n, fixtures: common misses over several fixtures together, and the fixtures that show them."""
    every = None
    for name, rows in fixtures.items():
        one = rows.where("expected <> predicted").select(F.col("expected").alias("lang"), "predicted", F.lit(name).alias("fixture"))
        every = one if every is None else every.unionByName(one)
    counted = every.groupBy("lang", "predicted").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("fixture")).alias("fixtures"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "predicted")
    return counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("lang", "k", "predicted", "n", "fixtures")


def misses_with_words(rows: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, expected, predicted, words: array<struct<token, source, scores>> of the misclassified texts, in text order.

    words: what ``LanguageDetector.detect_words`` gives for them."""
    wrong = misses(rows)
    nested = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "source", "scores"))).alias("ws"))
    dropped = F.transform("ws", lambda w: F.struct(w["token"].alias("token"), w["source"].alias("source"), w["scores"].alias("scores")))
    return wrong.join(nested.select(key, dropped.alias("words")), key, "left")


def misses(rows: DataFrame, lang: str | None = None) -> DataFrame:
    wrong = rows.where("expected <> predicted")
    return wrong.where(F.col("expected") == lang) if lang else wrong


def compare_fixtures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Accuracy by language of two fixtures side by side; null where one lacks the language."""
    side = lambda x, s: accuracy_by_language(x).select("lang", F.col("pct").alias(f"pct_{s}"))
    return side(a, "a").join(side(b, "b"), "lang", "full_outer")


def markdown(rows: DataFrame) -> str:
    """A report's table; for results that are a few rows by nature."""
    cells = [rows.columns, ["---"] * len(rows.columns), *([str(v) for v in r] for r in rows.collect())]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)


def report(rows: DataFrame) -> str:
    """Overall accuracy, languages, precision and recall, and the confusion matrix, as Markdown."""
    overall = overall_accuracy(rows).first()
    parts = {
        "By language": accuracy_by_language(rows).orderBy("lang"),
        "Precision, recall, F1": precision_recall_f1(rows).orderBy("lang"),
        "Confusion": confusion_matrix(rows).orderBy("expected"),
    }
    head = f"# Accuracy\n\n{overall['correct']} / {overall['n']} = {overall['pct']:.2f} %"
    return "\n\n".join([head, *(f"## {title}\n\n{markdown(part)}" for title, part in parts.items())]) + "\n"
