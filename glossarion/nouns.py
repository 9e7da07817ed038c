"""Results for single texts, scored on the driver with the model in memory."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.langs import UNKNOWN
from .operators.detect import LanguageDetector


@dataclass(frozen=True)
class Output:
    """The top language, and all of them with their scores, best first."""

    lang: str
    score: float
    distribution: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class WordScore:
    token: str
    scores: tuple[tuple[str, float], ...]
    source: str


@dataclass(frozen=True)
class Detailed:
    words: tuple[WordScore, ...]
    aggregate: tuple[tuple[str, float], ...]

    def output(self) -> Output:
        return Output(*self.aggregate[0], self.aggregate)


def detect_texts(detector: LanguageDetector, texts: list[str]) -> list[Output]:
    """For a few texts at hand; tables go through ``LanguageDetector.detect``."""
    scorer = detector.scorer
    share, some = scorer.shares(texts)
    out = []
    for row, any_ in zip(share, some, strict=True):
        best = sorted(zip(scorer.langs, row.tolist(), strict=True), key=lambda x: -x[1])
        known = any_ and best[0][1] >= detector.threshold
        listed = tuple(best) if known else ((UNKNOWN, 1.0),)
        out.append(Output(*listed[0], listed))
    return out


def detect_detailed_text(detector: LanguageDetector, text: str) -> Detailed:
    scorer = detector.scorer
    words = []
    for token in scorer.tokens(text):
        source, scores = scorer.word(token)
        listed = tuple((x, s) for x, s in zip(scorer.langs, scores, strict=True) if source == "ngram" or s > 0)
        words.append(WordScore(token, listed, source))
    return Detailed(tuple(words), detect_texts(detector, [text])[0].distribution)
