"""Language-model scores by stupid backoff, leaving each document's own counts out.

The score of a word is c(context, word) / c(context) where that n-gram occurs in some
other document, else ``BACKOFF`` times the score with a context shorter by one word,
down to max(c(word), 1) / all words. Counts cover all documents; from each a
document's own counts are subtracted, or else its every n-gram would be seen.

Documents are dealt into blocks by hash. A block counts its distinct n-grams (so a
frequent n-gram is one entry a block, not one a token) and sends hash and count to the
partition of the count table that the hash belongs to. There the block's entries meet
those of all other blocks; the totals go back in the order in which the block sent its
hashes, so no hash travels twice. The block, exploded again into the same n-grams,
joins the totals to them and sums the scores of each document. Both sides' sizes follow
the input (a block and a part share a row only where they share an n-gram), and no partition
holds more than its share of distinct n-grams.

Hashes have 64 bits. Defined results: null and blank texts have no words and the
score 0; each row is a document, repeated rows see each other; equal texts in an
equal number of copies get equal scores; an empty table gives no rows; other input
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, partitions, small_batches

ORDER = 2
BACKOFF = 0.4
BLOCK_DOCS = 800
#: Distinct n-grams that one task of the count table holds, about.
PER_PART = 3_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) ^ x >> np.uint64(31)


class Block:
    """The n-grams of some texts: for each order their hashes, end positions in the block, and documents."""

    def __init__(self, texts: list[str | None], order: int):
        known: dict[bytes, int] = {}
        flat: list[int] = []
        self.size = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = text.encode("utf-8", "replace").split() if text else []
            for w in found:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh3_64_intdigest(w)
                flat.append(h)
            self.size[k] = len(found)
        words = np.array(flat, np.uint64)
        self.document = np.repeat(np.arange(len(texts)), self.size)
        place = np.arange(len(words)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = place
        self.ends, self.hashes = [], []
        gram = _mix(words)
        for n in range(1, order + 1):
            if n > 1:
                gram = _mix(gram[:-1] * _STEP + words[n - 1 :] + np.uint64(n))
            end = np.arange(n - 1, len(words))
            inside = place[end] >= n - 1
            self.ends.append(end[inside])
            self.hashes.append(gram[inside] if len(end) else np.zeros(0, np.uint64))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all orders and their counts in the block."""
        return np.unique(np.concatenate(self.hashes), return_counts=True)

    def scores(self, distinct: np.ndarray, totals: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: the sum of log10 scores without the words' total, how many words took
        the shortest context, and how many took the longest."""
        n_words = len(self.place)
        others = []
        for n in range(order):
            at = np.searchsorted(distinct, self.hashes[n])
            key = np.stack([self.document[self.ends[n]], at])
            pair = key[0] * max(1, len(distinct)) + key[1]
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            count = np.zeros(n_words)
            count[self.ends[n]] = totals[at] - own[back]
            others.append(count)
        # Every shorter n-gram that ends at a word, down to the word alone, is tried in turn.
        score = np.log10(np.maximum(others[0], 1))
        level = np.zeros(n_words, np.int64)
        longest = np.minimum(self.place, order - 1)
        for n in range(1, order):
            before = np.zeros(n_words)
            before[1:] = others[n - 1][:-1]
            seen = others[n] > 0
            score[seen] = np.log10(others[n][seen] / before[seen])
            level[seen] = n
        score += (longest - level) * math.log10(BACKOFF)
        sums = lambda x: np.bincount(self.document, x, len(self.size))
        return sums(score), sums(level == 0).astype(np.int64), sums(level == order - 1).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype(np.uint64).tobytes(), 1)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), np.uint64)


def _deal(order: int, n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        distinct, counts = Block(table["text"].to_pylist(), order).distinct()
        # Parts are ranges of the hash, so a part's entries are a slice of the sorted ones. A part for
        # which the block has none gets no row, so there are never more rows than entries.
        part = ((distinct >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
        pieces = list(zip(first, [*first[1:], len(distinct)], strict=True)) if len(part) else []
        return pa.table(
            {
                "block": pa.array([table["block"][0].as_py()] * len(pieces), pa.int64()),
                "part": pa.array(part[first], pa.int64()),
                "hashes": pa.array([distinct[a:b].tobytes() for a, b in pieces], pa.binary()),
                "counts": pa.array([_pack(counts[a:b]) for a, b in pieces], pa.binary()),
            }
        )

    return run


def _total(table: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    counts = np.concatenate([_unpack(x) for x in table["counts"].to_pylist()])
    ends = np.cumsum([len(x) for x in hashes])
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(back, counts.astype(float)).astype(np.uint64)[back]
    packed = [_pack(totals[b - len(h) : b]) for h, b in zip(hashes, ends, strict=True)]
    return pa.table({"block": table["block"], "part": table["part"], "totals": pa.array(packed, pa.binary())})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log10_score (of the whole text), n_shortest, n_longest: words by context length."""
    spark = docs.sparkSession
    small_batches(spark)
    text = docs[text_col].cast("string")
    sizes = docs.agg(
        F.count("*").alias("rows"), F.sum(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")).alias("words")
    ).first()
    n_words, n_blocks = max(sizes["words"] or 0, 1), sizes["rows"] // BLOCK_DOCS + 1
    n_parts = max(partitions(spark), order * n_words // PER_PART + 1)
    block = F.pmod(F.xxhash64(docs[id_col].cast("string"), text), F.lit(n_blocks)).alias("block")
    dealt = docs.select(block, docs[id_col].alias("id"), text.alias("text"))
    entries = dealt.groupBy("block").applyInArrow(_deal(order, n_parts), "block long, part long, hashes binary, counts binary")
    totals = entries.groupBy("part").applyInArrow(_total, "block long, part long, totals binary")

    def finish(own: pa.Table, counted: pa.Table) -> pa.Table:
        made = Block(own["text"].to_pylist(), order)
        distinct, _ = made.distinct()
        parts = sorted(zip(counted["part"].to_pylist(), counted["totals"].to_pylist(), strict=True))
        joined = np.concatenate([_unpack(x) for _, x in parts] or [np.zeros(0)]).astype(np.int64)
        score, shortest, longest = made.scores(distinct, joined, order)
        return pa.table(
            {"id": own["id"], "n_words": made.size, "score": score, "n_shortest": shortest, "n_longest": longest}
        )

    kind = dealt.schema["id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        finish, f"id {kind}, n_words long, score double, n_shortest long, n_longest long"
    )
    whole = F.col("score") - F.col("n_shortest") * F.lit(math.log10(n_words))
    return scored.select(F.col("id").alias("doc_id"), "n_words", whole.alias("log10_score"), "n_shortest", "n_longest")
