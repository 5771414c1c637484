"""Operators for preparing training data at scale; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "simhash", "sketch", "repeats", "licenses", "warc", "toxicity", "decontaminate", "urls", "tokencounts")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).ORACLE_SQL.items()}
