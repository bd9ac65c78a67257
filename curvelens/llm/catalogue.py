"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from curvelens.llm import bpe, decontaminate, language, licences, lm, media, near_dedup, sharding, substring_dedup, warc

_MODULES = (bpe, lm, substring_dedup, language, licences, media, decontaminate, near_dedup, warc, sharding)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
