"""Quality rules whose cutoffs come from mergeable quantile sketches.

Each rule measures an integer per document. A KLL sketch of each rule's values is built
per (lang, source): Spark builds partial sketches where the rows are read and merges
them after the shuffle, so a hot source costs no more than a small one, and a sketch holds
about ``3 * K`` values however many rows there are. Sketches of a language are the merged
ones of its sources, and that of all documents is merged from the languages'. A group of
fewer than ``MIN_GROUP`` documents takes the fences of its language, or, where that is
as small, those of all documents. Quantiles set the fences that replace fixed cutoffs::

    upper = median + SPREAD * (q75 - median) + slack
    lower = median - SPREAD * (median - q25) - slack      (mean word length only)

The quartile is used since a few per cent of junk move higher quantiles at will; the slack is what a
document may exceed a source that has no spread at all. Up to ``K`` documents a sketch is exact; beyond,
its ranks are within about 2 / K of the true ones, and a rerun may differ by as much.

Defined results: a null text has no words and fails the base rules; null lang or
source form groups of their own; equal rows are judged alike, each in its own row;
an empty table gives no rows; other columns of the input are ignored.

Windows of eight words are compared by their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, cut, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
K = 2048
MIN_GROUP = 50
SPREAD = 4
#: rule: (slack, whether it has a lower fence)
RULES = {"word_length": (150, True), "symbols": (600, False), "dup_lines": (250, False), "repeats": (200, False)}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
        words_of(text).alias("words"),
        _without(text, SPACE_CHARS).alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).alias("n_symbols"),
        lines.alias("lines"),
    )
    # Words, and later hashes, are used more than once, so Spark computes each of these projections once a row.
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
    )
    hashed = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    ordered = hashed.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    rest = F.slice("ordered", F.lit(2), F.greatest(F.size("ordered"), F.lit(1)))
    twins = F.filter(
        F.zip_with("ordered", rest, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: F.coalesce(p["a"]["h"] == p["b"]["h"], F.lit(False)),
    )
    starts = ordered.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_words", "n_dup_lines",
        F.sort_array(F.array_distinct(F.flatten(F.transform(twins, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))).alias("starts"),
    )
    after = F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1)))
    covered = F.aggregate(
        F.zip_with("starts", after, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    return starts.select(
        "doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in whole],
        F.when(F.size("starts") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    """Each rule's integer: hundredths of a character, or thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    of = {
        "word_length": 100 * F.col("word_chars"),
        "symbols": 1000 * F.col("n_symbols"),
        "dup_lines": 1000 * F.least(8 * F.col("n_dup_lines"), n),
        "repeats": 1000 * F.col("n_repeat_words"),
    }
    return {k: F.floor(v / n).cast("long") for k, v in of.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, n and a sketch of each rule's values."""
    worded = measured.where(F.col("n_words") > 0).select("lang", "source", *[v.alias(k) for k, v in _values().items()])
    return worded.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_bigint(k, F.lit(K)).alias(k) for k in RULES])


def _merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_bigint(k, F.lit(K)).alias(k) for k in RULES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and the fences of each rule, a row for each group."""
    by_lang = _merged(sketch, "lang")
    everything = _merged(by_lang)
    named = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    joined = sketch.join(named(by_lang, "l"), F.col("lang").eqNullSafe(F.col("lang_l")), "left").join(F.broadcast(named(everything, "e")))
    quantiles = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    picked = lambda k: F.when(F.col("n") >= MIN_GROUP, F.col(k)).when(F.col("n_l") >= MIN_GROUP, F.col(f"{k}_l")).otherwise(F.col(f"{k}_e"))
    found = joined.select("lang", "source", *[F.kll_sketch_get_quantile_bigint(picked(k), quantiles).alias(k) for k in RULES])
    out = []
    for rule, (slack, two_sided) in RULES.items():
        low, mid, high = (F.get(rule, F.lit(i)) for i in range(3))
        out.append((mid + SPREAD * (high - mid) + slack).alias(f"{rule}_max"))
        if two_sided:
            out.append((mid - SPREAD * (mid - low) - slack).alias(f"{rule}_min"))
    return found.select("lang", "source", *out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of each document with ``base_failed`` and ``kept``."""
    measured = cut(measure(docs, id_col, text_col))
    fences = thresholds(cut(sketches(measured))).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"{r}_max" for r in RULES], "word_length_min"
    )
    values = _values()
    inside = F.coalesce(values["word_length"] >= F.col("word_length_min"), F.lit(True))
    for rule in RULES:
        inside = inside & F.coalesce(values[rule] <= F.col(f"{rule}_max"), F.lit(True))
    joined = measured.join(
        fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    )
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"),
    )
