"""Queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("decontaminate", "secrets", "hamming_topk", "simhash", "suffix_dedup", "toxicity", "maxent", "warc", "langid", "packing")


def _all():
    return [import_module(f"switchback.llm.{name}") for name in _MODULES]


def queries() -> dict:
    found = {}
    for module in _all():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for module in _all():
        found |= module.ORACLE_SQL
    return found
