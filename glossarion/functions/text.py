"""Column expressions over text: tokens, trigrams, words, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, marks, digits and apostrophes. On ASCII text this is [A-Za-z0-9']+.
TOKEN = r"[\p{L}\p{M}\p{N}']+"
PAD_LEFT, PAD_RIGHT = "^^", "$$"


def tokens(text: Column) -> Column:
    """array<string>: runs of word characters without outer apostrophes, lower case;
    those without a letter are dropped. Null for a null text."""
    stripped = F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})")), lambda t: F.lower(F.btrim(t, F.lit("'"))))
    return F.filter(stripped, lambda t: F.rlike(t, F.lit(r"\p{L}")))


def normalise(text: Column) -> Column:
    """NFKC, then lower case without a locale. Spark takes the call for non-deterministic, so project it first."""
    icu = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNotNull(), F.lower(icu))


def padded(token: Column) -> Column:
    return F.concat(F.lit(PAD_LEFT), token, F.lit(PAD_RIGHT))


def trigrams(token: Column) -> Column:
    """array<string>: the windows of three code points over ^^token$$, length + 2 of them."""
    return F.transform(F.sequence(F.lit(1), F.length(token) + 2), lambda i: F.substring(padded(token), i, F.lit(3)))


def space_words(text: Column) -> Column:
    """array<string>: what white space separates."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"))


def truncated(text: Column, n: int) -> Column:
    """The first n white-space words; null for texts with fewer."""
    words = space_words(text)
    return F.when(F.size(words) >= n, F.array_join(F.slice(words, 1, n), " "))


def clean_tsv(text: Column) -> Column:
    return F.regexp_replace(text, r"[\t\r\n]", " ")


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def outcome(ratio: Column) -> Column:
    """win, tie or loss of a ratio of times."""
    return F.when(ratio < 0.95, "win").when(ratio > 1.05, "loss").otherwise("tie")


def thousands(n: Column) -> Column:
    """Rounded to thousands, halves up."""
    return F.floor((n + 500) / 1000)


def ns_per_token(ms: Column, n: Column) -> Column:
    return F.try_divide(ms * 1e6, n)


def throughput_k(n: Column, seconds: Column) -> Column:
    return F.try_divide(n, seconds * 1000)
