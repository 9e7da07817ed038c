"""The languages, in the order that settles ties, and their names elsewhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
LANGS = ("de", "en", "tr", "ru", "fr", "es", "it", "nl", "pt", "pl")
UNKNOWN = "?"
ISO3 = {
    "de": "deu", "en": "eng", "tr": "tur", "ru": "rus", "fr": "fra", "es": "spa", "it": "ita", "nl": "nld", "pt": "por", "pl": "pol",
}
FLORES = {k: f"{v}_{'Cyrl' if k == 'ru' else 'Latn'}" for k, v in ISO3.items()}

#: The year of the news corpus of a language; of those not listed, 2023.
NEWS_YEAR = {"en": 2024, "de": 2024}


def news_corpus(lang: str, size: str) -> str:
    """The name of a language's news corpus of a size such as 100K."""
    return f"{ISO3[checked([lang])[0]]}_news_{NEWS_YEAR.get(lang, 2023)}_{size}"


def supported_languages() -> tuple[str, ...]:
    return LANGS


def checked(langs: Iterable[str]) -> tuple[str, ...]:
    """In the caller's order without repeats. Unknown codes, and "?", are refused."""
    out = tuple(dict.fromkeys(langs))
    if bad := [x for x in out if x not in LANGS]:
        raise ValueError(f"unsupported language {bad[0]!r}; supported: {', '.join(LANGS)}")
    return out


def langs_table(spark: SparkSession, langs: Iterable[str] = LANGS) -> DataFrame:
    """lang, ord"""
    return spark.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, ord int")
