"""The subpackage's queries, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib

#: modules with QUERIES and ORACLE_SQL
MODULES = ("substring_dedup", "warc", "ngram_lm", "quality", "toxicity", "sentencepiece_codec", "decontaminate", "simhash", "rendezvous", "licenses", "spelling", "code_compression", "set_join")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"dagspark.llm.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
