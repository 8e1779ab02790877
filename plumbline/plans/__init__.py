"""Registered queries: each module has QUERIES (name -> callable) and SQL (name -> DuckDB SQL)."""

from importlib import import_module

#: Modules of this package that register queries.
NAMES = ("known_at", "nested_records", "quantities", "changes", "drift", "ledger", "scoring", "lots", "panels", "documents", "streams", "models", "parsing", "tenders", "ladders", "evidence")


def modules() -> list:
    return [import_module(f"{__name__}.{name}") for name in NAMES]
