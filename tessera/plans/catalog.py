"""All queries outside the subpackage for texts, by name, and their SQL where there is one."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable) and SQL (name -> text).
MODULES = ("instants", "quantities", "relational", "texts", "parsing", "landed", "streams", "scoring", "inventory", "further")
FLAGSHIP = "sc09_scores"


def collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), kind)
    return out


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("SQL")
