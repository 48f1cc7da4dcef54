"""Registered queries over the driver tables, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sequence", "files", "joins", "aggregates")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f".{m}", __name__).ORACLE_SQL.items()}
