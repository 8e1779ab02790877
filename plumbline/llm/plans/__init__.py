"""Registered queries of this subpackage: modules with QUERIES and SQL."""

from importlib import import_module

#: Modules of this package that register queries.
NAMES = ("names", "survivors", "tokens", "mixing", "abuse")


def modules() -> list:
    return [import_module(f"{__name__}.{name}") for name in NAMES]
