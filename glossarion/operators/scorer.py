"""Scores of whole Arrow batches in one pass over the texts, without a shuffle.

The model's tables, bounded by its languages and sizes, become dictionaries in the Python
workers. A run of characters is tokenised and scored the first time a worker sees it;
afterwards it is a row number of a matrix, and a batch is a sum of that matrix's rows."""

from __future__ import annotations

import uuid

import numpy as np

from ..functions.langs import UNKNOWN
from ..functions.pytext import TOKENIZERS
from .score import NO_FLOOR, PRIOR_K
from .train import Model

# Fixed value; a top score below it is unknown.
UNKNOWN_THRESHOLD = 0.20
#: Runs that a worker remembers.
CACHE = 500_000
#: Rows of model tables that a scorer takes; train with smaller sizes beyond it.
MOST_ROWS = 1_000_000


#: What this worker has learned, by scorer; tasks that run in the same worker go on with it.
_live: dict[str, Scorer] = {}


class Scorer:
    """Scores texts by the same rules as the tables, in plain Python; picklable."""

    def __init__(
        self, langs: list[str], ranks: dict, lps: dict, floors: dict, threshold: float = UNKNOWN_THRESHOLD, tokenizer: str = "plain"
    ):
        self.langs, self.ranks, self.threshold, self.tokenizer = langs, ranks, threshold, tokenizer
        self.floors = np.array([floors.get(x, NO_FLOOR) for x in langs])
        #: Row 0 of the log-probabilities is of trigrams that no language has.
        self.trigram = {tri: k + 1 for k, tri in enumerate(lps)}
        self.lp = np.tile(self.floors, (len(lps) + 1, 1))
        for row, own in enumerate(lps.values(), 1):
            for k, lp in own.items():
                self.lp[row, k] = lp
        self.key = uuid.uuid4().hex
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "used", "weighted", "plain", "found")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def live(self) -> Scorer:
        """This scorer, or the one like it that an earlier task of the worker has used."""
        if self.key not in _live and len(_live) >= 2:
            _live.clear()
        return _live.setdefault(self.key, self)

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.used = 1  # row 0 is of runs that are no token
        self.weighted = np.zeros((1024, len(self.langs)))
        #: The rows' scores as they are, and their tokens.
        self.plain = np.zeros((1024, len(self.langs)))
        self.found = [""]

    @classmethod
    def of(cls, model: Model, threshold: float = UNKNOWN_THRESHOLD, tokenizer: str = "plain") -> Scorer:
        langs = model.order()
        at = {x: k for k, x in enumerate(langs)}
        ranks: dict = {}
        lps: dict = {}
        dictionary = model.dictionary.limit(MOST_ROWS + 1).toArrow()
        trigrams = model.trigrams.limit(MOST_ROWS + 1).toArrow()
        if max(len(dictionary), len(trigrams)) > MOST_ROWS:
            raise ValueError("the model is too large for a scorer")
        for token, lang, rank in zip(*(dictionary[c].to_pylist() for c in ("token", "lang", "rnk")), strict=True):
            ranks.setdefault(token, []).append((at[lang], rank))
        for tri, lang, lp in zip(*(trigrams[c].to_pylist() for c in ("tri", "lang", "lp")), strict=True):
            lps.setdefault(tri, {})[at[lang]] = lp
        return cls(langs, ranks, lps, {r["lang"]: r["lp"] for r in model.floors.collect()}, threshold, tokenizer)

    def words(self, tokens: list[str]) -> np.ndarray:
        """A row of scores for each token."""
        out = np.zeros((len(tokens), len(self.langs)))
        if not self.langs:
            return out
        missing = []
        for i, token in enumerate(tokens):
            hits = self.ranks.get(token)
            if hits:
                for k, rank in hits:
                    out[i, k] = 1.0 / (rank + PRIOR_K)
                out[i] /= out[i].sum()
            else:
                missing.append(i)
        if missing:
            padded = [f"^^{tokens[i]}$$" for i in missing]
            get = self.trigram.get
            at = [get(p[k : k + 3], 0) for p in padded for k in range(len(p) - 2)]
            size = np.array([len(p) - 2 for p in padded])
            raw = np.add.reduceat(self.lp[at], np.cumsum(size) - size, axis=0)
            e = np.exp(raw - raw.max(1, keepdims=True))
            out[missing] = e / e.sum(1, keepdims=True)
        return out

    def word(self, token: str) -> tuple[str, list[float]]:
        """Where a token's scores are from (dict or ngram), and the scores."""
        return "dict" if token in self.ranks else "ngram", self.words([token])[0].tolist()

    def _learn(self, runs: list[str]) -> None:
        one = TOKENIZERS[self.tokenizer][1]
        made = {r: one(r) for r in runs}
        known = [r for r, t in made.items() if t is not None]
        self.row.update((r, 0) for r, t in made.items() if t is None)
        if not known:
            return
        scores = self.words([made[r] for r in known])
        while self.used + len(known) > len(self.weighted):
            self.weighted = np.concatenate([self.weighted, np.zeros_like(self.weighted)])
            self.plain = np.concatenate([self.plain, np.zeros_like(self.plain)])
        self.plain[self.used : self.used + len(known)] = scores
        self.found += [made[r] for r in known]
        self.weighted[self.used : self.used + len(known)] = scores * scores.max(1, keepdims=True, initial=0.0)
        self.row.update((r, self.used + k) for k, r in enumerate(known))
        self.used += len(known)

    def tokens(self, text: str) -> list[str]:
        split, one = TOKENIZERS[self.tokenizer]
        return [t for t in map(one, split(text)) if t is not None]

    def rows(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the rows of its runs, 0 for those that are no token."""
        if len(self.row) > CACHE:
            self.forget()
        split = TOKENIZERS[self.tokenizer][0]
        found = [split(t) if t else [] for t in texts]
        row = self.row
        new = {r for rs in found for r in rs if r not in row}
        if new:
            self._learn(sorted(new))
        return [[row[r] for r in rs] for rs in found]

    def shares(self, texts: list[str | None], rows: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text the languages' shares, and whether it has any token; zeros where it has none."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out, np.zeros(len(texts), bool)
        rows = self.rows(texts) if rows is None else rows
        weighted = self.weighted
        for k, at in enumerate(rows):
            if at:
                out[k] = weighted[at].sum(0)
        total = out.sum(1)
        some = total > 0
        out[some] /= total[some, None]
        return out, some

    def best(self, texts: list[str | None]) -> tuple[list[str | None], list[float | None]]:
        """The top language and its score for each text; None for null texts."""
        share, some = self.shares(texts)
        top = share.argmax(1) if self.langs else np.zeros(len(texts), int)
        sure = some & (share[np.arange(len(texts)), top] >= self.threshold) if self.langs else some
        langs = [None if t is None else self.langs[k] if s else UNKNOWN for t, k, s in zip(texts, top, sure, strict=True)]
        scores = [None if t is None else float(share[i, top[i]]) if sure[i] else 1.0 for i, t in enumerate(texts)]
        return langs, scores

    def detect(self, text: str | None) -> tuple[str, float] | None:
        if text is None:
            return None
        langs, scores = self.best([text])
        return langs[0], scores[0]
