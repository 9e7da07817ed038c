"""The tokens of functions.text, and those by exact word boundaries, in plain Python for Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import regex

_ASCII_RUN = re.compile(r"[A-Za-z0-9']+")
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}']+")
_LETTER = regex.compile(r"\p{L}")
_WORD = regex.compile(r"(?V1)\b\w.*?\b", regex.WORD | regex.DOTALL)


def runs(text: str) -> list[str]:
    """Runs of word characters as they stand; ``token`` makes tokens of them."""
    return (_ASCII_RUN if text.isascii() else _RUN).findall(text)


def token(run: str) -> str | None:
    """The token of a run, or None where it has no letter."""
    out = run.strip("'").lower()
    return out if _LETTER.search(out) else None


def strict_runs(text: str) -> list[str]:
    """Words by Unicode word boundaries."""
    return _ASCII_RUN.findall(text) if text.isascii() else _WORD.findall(text)


def strict_token(run: str) -> str | None:
    """NFKC and lower case character by character; outer apostrophes go from ASCII runs."""
    out = run.strip("'") if run.isascii() else unicodedata.normalize("NFKC", run)
    return "".join(c.lower() for c in out) if any(c.isalpha() for c in out) else None


#: By name: how a text falls into runs, and a run into its token.
TOKENIZERS = {"plain": (runs, token), "strict": (strict_runs, strict_token)}


def tokens(text: str | None, tokenizer: str = "plain") -> list[str]:
    split, one = TOKENIZERS[tokenizer]
    return [t for t in map(one, split(text or "")) if t is not None]
