"""The training-data queries and their SQL, for the driver's entry file."""

from __future__ import annotations

from . import q01_chat, q02_lm, q03_neardup, q04_pii, q05_media, q06_quality, q07_mixing, q08_lines, q09_toxicity, q10_bpe

MODULES = (q01_chat, q02_lm, q03_neardup, q04_pii, q05_media, q06_quality, q07_mixing, q08_lines, q09_toxicity, q10_bpe)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and callable(f) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: m.ORACLE for m in MODULES for k in vars(m) if k.startswith("op") and k[2].isdigit() and hasattr(m, "ORACLE")}
