"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct words, word pairs and pairs with one word
skipped, hashed into ``2 ** BITS`` coordinates. FTRL-proximal keeps a learning rate per
coordinate and drives the weights of uninformative coordinates to exactly zero, so
what is left is a short list of weights, at most ``2 ** BITS`` of them, that every
task can hold.

The model is fitted on a bounded sample: of the labelled rows, the ``max_labelled``
first by hash of their id (all of them when there are fewer). Their ids, never more
than that, are what is broadcast to pick their texts. Every document is then scored,
over its whole text; nothing but the text enters a score.

Defined results: null and empty texts have no features and get the score of the bias;
null labels are left out; several labels of one document count as toxic if any does;
equal texts get equal scores; with fewer than MIN_SEEN labels of either kind (or none)
every score is 0.5 less a hair, so nothing is rejected; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 20
MAX_LABELLED = 12_000
EPOCHS = 6
#: Coordinates that fewer of the sampled documents have are left out, as they would only be memorised.
MIN_SEEN = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 1.0
#: Words whose hashes a task remembers.
CACHE = 300_000
_WORD = re.compile(r"\w+")


class Features:
    """Hashed features; remembers the hashes of words it has seen, up to CACHE."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        known = self.known
        try:
            return np.array([known[w] for w in found], np.uint64)
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = crc32(w.encode("utf-8", "replace"))
            return np.array([known[w] for w in found], np.uint64)

    @staticmethod
    def coordinates(words: np.ndarray) -> list[np.ndarray]:
        """Of the words, the pairs and the skip pairs; the k-th of each starts at word k."""

        def mixed(x: np.ndarray) -> np.ndarray:
            x = x * np.uint64(0x9E3779B97F4A7C15)
            return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)

        shift = np.uint64(32)
        return [
            mixed(words),
            mixed((words[:-1] << shift | words[1:]) ^ np.uint64(0x51ED270B)),
            mixed((words[:-2] << shift | words[2:]) ^ np.uint64(0x2545F491)),
        ]

    def document(self, text: str | None) -> np.ndarray:
        return np.unique(np.concatenate(self.coordinates(self.words(text)))).astype(np.int64)


def fit_ftrl(examples: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with weights, the weights, and the bias."""
    seen = np.zeros(1 << BITS, np.int32)
    for at in examples:
        seen[at] += 1
    examples = [at[seen[at] >= MIN_SEEN] for at in examples]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    for _ in range(EPOCHS):
        for at, y in zip(examples, labels, strict=True):
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            b = -z0 / ((BETA + n0**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * b
            n0 += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    zi = z[used]
    weights = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[used])) / ALPHA + L2)
    return used, weights, float(-z0 / ((BETA + n0**0.5) / ALPHA))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> tuple[np.ndarray, np.ndarray, float]:
    """The weights from the rows of ``labels``; see the module for the bound."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("y"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("id"), docs[text_col].cast("string").alias("text"))
    labelled = texts.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select(
        F.xxhash64("id").alias("h"), "id", "text", "y"
    )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, rows = Features(), []
        for batch in batches:
            rows += [
                (h, i, crc32((t or "").encode()), y, features.document(t).astype(np.int32))
                for h, i, t, y in zip(batch["h"], batch["id"], batch["text"], batch["y"], strict=True)
            ]
        rows.sort(key=lambda r: r[:4])
        toxic = sum(r[3] for r in rows)
        enough = min(toxic, len(rows) - toxic) >= MIN_SEEN
        used, weights, bias = fit_ftrl([r[4] for r in rows], [r[3] for r in rows]) if enough else ([], [], -1e-3)
        yield pd.DataFrame({"at": np.append(used, -1), "w": np.append(weights, bias)})

    small_batches(docs.sparkSession)
    rows = labelled.repartition(1).mapInPandas(train, "at long, w double").toPandas()
    return rows["at"].to_numpy()[:-1], rows["w"].to_numpy()[:-1], float(rows["w"].iloc[-1]) if len(rows) else -1e-3


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), name: str = "score",
) -> DataFrame:
    """id, the score (0 to 1) under that name, and the columns to keep, for every document."""
    used, weights, bias = model
    source = docs.select(docs[text_col].cast("string").alias("text__scored"), id_col, *[c for c in keep if c != id_col])
    fields = source.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[used] = weights
        features = Features()
        for batch in batches:
            words = [features.words(t) for t in batch.column(0).to_pylist()]
            size = np.array([len(w) for w in words], np.int64)
            row = np.repeat(np.arange(len(words)), size)
            joined = np.concatenate([*words, np.zeros(0, np.uint64)])
            keys = []
            for gap, at in enumerate(features.coordinates(joined)):
                hit = np.flatnonzero(dense[at.astype(np.int64)])
                hit = hit[row[hit] == row[hit + gap]]
                keys.append(row[hit] << BITS | at[hit].astype(np.int64))
            key = np.unique(np.concatenate(keys))
            total = np.bincount(key >> BITS, dense[key & (1 << BITS) - 1], len(words)) + bias
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            columns = {f.name: batch.column(k + 1) for k, f in enumerate(fields)}
            yield pa.RecordBatch.from_pydict({**columns, name: pa.array(scores)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(run, f"{schema}, `{name}` double")
