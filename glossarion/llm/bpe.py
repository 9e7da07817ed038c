"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves of ``LEAF`` characters, each leaf is encoded, and
neighbours are joined up the tree. A join re-encodes a window around the seam that
grows until it ends, on either side, at a place where a non-space character is
followed by a blank. No match of the pattern spans such a place (each match is blanks
only, or one leading blank and then non-blanks), whatever stands before or after, so
tokens outside the window cannot change: the join is exact and associative. Texts
without such a place grow the window up to the whole span. Decoding concatenates the
tokens' bytes up the tree.

Defined results: null and empty texts have no tokens; every row, repeated ones too,
has its own result; an empty table gives no rows; other input columns are ignored.
The vocabulary file's path is a parameter; executors read it from there.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

LEAF = 2048
SEAM = 32
_SAFE = re.compile(r"(?<=\S)[ \n]")


class TreeBpe:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._span(text, lo, mid), self._span(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, end, width = None, None, SEAM
        while start is None or end is None:
            if start is None:
                a = max(lo, mid - width)
                found = [m.start() for m in _SAFE.finditer(text, a, mid) if m.start() > lo]
                start = found[-1] if found else lo if a == lo else None
            if end is None:
                b = min(hi, mid + width)
                found_right = _SAFE.search(text, mid + 1, b)
                end = found_right.start() if found_right else hi if b == hi else None
            width *= 2
        cut_left = self._count(left, len(text[start:mid].encode()), from_end=True)
        cut_right = self._count(right, len(text[mid:end].encode()), from_end=False)
        return left[: len(left) - cut_left] + self.encoding.encode_ordinary(text[start:end]) + right[cut_right:]

    def _count(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """How many tokens at that end make up so many bytes."""
        size_of, n = self.size_of, 0
        while n_bytes > 0:
            n_bytes -= size_of[ids[-1 - n] if from_end else ids[n]]
            n += 1
        if n_bytes:
            raise AssertionError("a token spans a stable place")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > LEAF:
            mid = len(ids) // 2
            return self.decode(ids[:mid]) + self.decode(ids[mid:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def tree_bpe(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(path, pattern)


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.empty(int(offsets[-1]), np.int32)
    for v, a, b in zip(values, offsets, offsets[1:], strict=False):
        flat[a:b] = v
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True
) -> DataFrame:
    """id, ids array<int>, and with ``decode`` decoded binary: the ids' bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = {id_col: batch.column(0), "ids": _lists(ids)}
            if decode:
                columns["decoded"] = pa.array([bpe.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    picked = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", decoded binary" * decode)


def decode_documents(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded binary, from a column of ids; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern)
        for batch in batches:
            decoded = pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "decoded": decoded})

    picked = tokens.select(id_col, ids_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[id_col].dataType.simpleString()}, decoded binary")
