"""Queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

import importlib

MODULES = ("pages", "names", "neardup", "tokens", "packing", "splitting")


def collect(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), kind)
    return out


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("SQL")
