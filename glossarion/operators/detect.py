"""Language detection over tables of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.langs import UNKNOWN, checked
from ..functions.pytext import TOKENIZERS
from ..functions.ship import ship
from ..functions.text import tokens
from .score import word_scores
from .scorer import UNKNOWN_THRESHOLD, Scorer
from .tokenize import strict_tokens, term_frequencies, word_tokens
from .train import Model


def _unknown() -> Column:
    return F.array(F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("score")))


#: Characters of texts whose words are listed at once.
CHUNK_CHARS = 1 << 20
ENTRY = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def _listed(share: np.ndarray, some: np.ndarray, null: np.ndarray, langs: list[str], threshold: float) -> tuple:
    """The distributions as lists, best first; then the names, their order, the ordered shares and which texts are sure."""
    names = np.array([*langs, UNKNOWN], dtype=object)
    order = np.argsort(-share, axis=1, kind="stable")
    sorted_ = np.take_along_axis(share, order, 1)
    sure = some & (sorted_[:, 0] >= threshold) if langs else some
    size = np.where(null, 0, np.where(sure, len(langs), 1))
    first = np.cumsum(size) - size
    flat_names, flat = np.full(size.sum(), UNKNOWN, dtype=object), np.ones(size.sum())
    at = (first[sure, None] + np.arange(len(langs))).ravel()
    flat_names[at], flat[at] = names[order[sure]].ravel(), sorted_[sure].ravel()
    values = pa.StructArray.from_arrays([pa.array(flat_names, pa.string()), pa.array(flat)], fields=list(ENTRY))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, size.sum()), pa.int32()), values, mask=pa.array(null))
    return lists, names, order, sorted_, sure


def _words(live: Scorer, rows: list[list[int]]) -> pa.ListArray:
    """For each text its words with their scores and sources. A word's entry is made once and taken wherever it occurs."""
    used = [[r for r in at if r] for at in rows]
    size = np.array([len(at) for at in used], int)
    distinct, where = np.unique(np.fromiter((r for at in used for r in at), np.int64, size.sum()), return_inverse=True)
    tokens = [live.found[r] for r in distinct]
    known = np.array([t in live.ranks for t in tokens], bool)
    scores = live.plain[distinct]
    shown = ~known[:, None] | (scores > 0)
    langs = pa.array(np.array(live.langs, dtype=object)[np.nonzero(shown)[1]] if live.langs else [], pa.string())
    flat = pa.StructArray.from_arrays([langs, pa.array(scores[shown], pa.float64())], fields=list(ENTRY))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(shown.sum(1))), pa.int32()), flat)
    made = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), lists, pa.array(np.where(known, "dict", "ngram"), pa.string())], ["token", "scores", "source"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), made.take(pa.array(where.ravel())))


@dataclass(frozen=True)
class LanguageDetector:
    """An immutable detector; ``only`` and the thresholds return new ones.

    ``detect`` reads each text once and shuffles nothing; ``detect_relational`` gives the same from joins and
    aggregations alone. ``tokenizer`` is "plain" (runs of word characters) or "strict" (Unicode word boundaries, NFKC).
    ``parallel_threshold`` is accepted and has no effect, as Spark decides on parallelism."""

    model: Model
    threshold: float = UNKNOWN_THRESHOLD
    parallel_threshold: int | None = None
    tokenizer: str = "plain"

    def __post_init__(self) -> None:
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}; there are {', '.join(TOKENIZERS)}")

    @classmethod
    def supporting(
        cls, model: Model, *, only: Iterable[str] | None = None, unknown_threshold: float = UNKNOWN_THRESHOLD,
        parallel_threshold: int | None = None, tokenizer: str = "plain",
    ) -> LanguageDetector:
        """A detector from keywords, in one call."""
        made = cls(model, unknown_threshold, parallel_threshold, tokenizer)
        return made if only is None else made.only(only)

    def with_tokenizer(self, tokenizer: str) -> LanguageDetector:
        return replace(self, tokenizer=tokenizer)

    @cached_property
    def scorer(self) -> Scorer:
        """The model in memory, read once for each detector."""
        return Scorer.of(self.model, self.threshold, self.tokenizer)

    def only(self, langs: Iterable[str]) -> LanguageDetector:
        return replace(self, model=self.model.only(checked(langs)))

    def unknown_threshold(self, threshold: float) -> LanguageDetector:
        return replace(self, threshold=threshold)

    def with_parallel_threshold(self, words: int) -> LanguageDetector:
        return replace(self, parallel_threshold=words)

    def _distributions(self, docs: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
        """keys, aggregate: array<struct<lang, score>>, best first, one entry for each language."""
        langs = self.model.order()
        if self.tokenizer == "strict":
            frequencies = strict_tokens(docs, *keys, text=text).groupBy(*keys, "token").agg(F.count("*").alias("n"))
        else:
            frequencies = term_frequencies(docs, *keys, text=text)
        scores = word_scores(frequencies.select("token").distinct(), self.model)
        joined = frequencies.join(scores, "token")
        weight = F.col("n") * F.col("conf")
        sums = joined.groupBy(*keys).agg(*[F.sum(weight * F.get("s", F.lit(k))).alias(f"w{k}") for k in range(len(langs))])
        total = sum((F.col(f"w{k}") for k in range(len(langs))), F.lit(0.0))
        entries = F.array(*[
            F.struct((-(F.col(f"w{k}") / total)).alias("down"), F.lit(k).alias("ord"), F.lit(x).alias("lang")) for k, x in enumerate(langs)
        ])
        ordered = F.transform(F.sort_array(entries), lambda e: F.struct(e["lang"].alias("lang"), (-e["down"]).alias("score")))
        gate = F.get(ordered, F.lit(0))["score"] < self.threshold
        return sums.select(*keys, F.when(gate | (total <= 0), _unknown()).otherwise(ordered).alias("aggregate"))

    def _whole(self, docs: DataFrame, found: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
        """Documents without tokens come back as unknown; null texts as null."""
        if self.tokenizer == "strict":
            none = docs.join(found.select(*[F.col(k).alias(f"{k}__") for k in keys]), self._same(docs, keys), "left_anti")
        else:
            none = docs.where(F.coalesce(F.size(tokens(F.col(text))), F.lit(-1)) <= 0)
        return found.unionByName(none.select(*keys, F.when(F.col(text).isNotNull(), _unknown()).alias("aggregate")))

    @staticmethod
    def _same(docs: DataFrame, keys: tuple[str, ...]) -> Column:
        same = F.lit(True)
        for k in keys:
            same = same & docs[k].eqNullSafe(F.col(f"{k}__"))
        return same

    def detect(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """keys, lang, score, distribution: a row for each row, null for a null text."""
        ship(docs.sparkSession)
        scorer, langs, threshold = self.scorer, self.scorer.langs, self.threshold
        picked = docs.select(F.col(text).cast("string").alias("text__"), *keys)
        fields = picked.schema.fields[1:]
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            live = scorer.live()
            for batch in batches:
                texts = batch.column(0).to_pylist()
                share, some = live.shares(texts)
                null = np.array([t is None for t in texts], bool)
                lists, names, order, sorted_, sure = _listed(share, some, null, langs, threshold)
                tops = np.where(sure, names[order[:, 0]], UNKNOWN) if langs else np.full(len(texts), UNKNOWN, dtype=object)
                best = np.where(sure, sorted_[:, 0], 1.0) if langs else np.ones(len(texts))
                yield pa.RecordBatch.from_pydict({
                    **{f.name: batch.column(i + 1) for i, f in enumerate(fields)},
                    "lang": pa.array(tops, pa.string(), mask=null), "score": pa.array(best, pa.float64(), mask=null), "distribution": lists,
                })

        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
        return picked.mapInArrow(run, schema + "lang string, score double, distribution array<struct<lang: string, score: double>>")

    def detect_relational(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """As detect, from joins and aggregations. Keys tell documents apart."""
        if not self.model.order():
            return docs.select(*keys, F.lit(UNKNOWN).alias("lang"), F.lit(1.0).alias("score"), _unknown().alias("distribution"))
        found = self._whole(docs, self._distributions(docs, keys, text), keys, text)
        top = F.get("aggregate", F.lit(0))
        return found.select(*keys, top["lang"].alias("lang"), top["score"].alias("score"), F.col("aggregate").alias("distribution"))

    detect_batch = detect

    def detect_words(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """keys, pos, token, source, scores: array<struct<lang, score>> in the order of the languages.
        Words of the dictionary list the languages that have them, others every language."""
        langs = self.model.order()
        words = (strict_tokens if self.tokenizer == "strict" else word_tokens)(docs, *keys, text=text)
        scores = word_scores(words.select("token").distinct(), self.model)
        pairs = F.zip_with(F.array(*map(F.lit, langs)), F.col("s"), lambda x, y: F.struct(x.alias("lang"), y.alias("score")))
        shown = F.when(F.col("source") == "dict", F.filter(pairs, lambda p: p["score"] > 0)).otherwise(pairs)
        return words.join(scores, "token").select(*keys, "pos", "token", "source", shown.alias("scores"))

    def detect_detailed(self, docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
        """keys, words: array<struct<token, scores, source>> in text order, aggregate: a row for each row, in one pass and
        without a shuffle. A null text has no words and a null aggregate."""
        ship(docs.sparkSession)
        scorer, threshold = self.scorer, self.threshold
        picked = docs.select(F.col(text).cast("string").alias("text__"), *keys)
        fields = picked.schema.fields[1:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            live = scorer.live()
            for batch in batches:
                whole = batch.column(0).to_pylist()
                ends = np.cumsum([len(t or "") for t in whole]) // CHUNK_CHARS
                for start, stop in pairwise([0, *(np.nonzero(np.diff(ends))[0] + 1).tolist(), len(whole)]):
                    texts = whole[start:stop]
                    rows = live.rows(texts)
                    null = np.array([t is None for t in texts], bool)
                    yield pa.RecordBatch.from_pydict({
                        **{f.name: batch.column(i + 1).slice(start, stop - start) for i, f in enumerate(fields)},
                        "words": _words(live, rows), "aggregate": _listed(*live.shares(texts, rows), null, live.langs, threshold)[0],
                    })

        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
        entries = "array<struct<lang: string, score: double>>"
        return picked.mapInArrow(run, f"{schema}words array<struct<token: string, scores: {entries}, source: string>>, aggregate {entries}")

    detect_detailed_batch = detect_detailed
