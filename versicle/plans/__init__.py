"""Query catalogue: one entry per operator family, with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "analysis", "streams")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __name__).ORACLE_SQL.items()}
