"""Declared process catalogs, derived views and the registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("rollups", "tables", "calendar", "ledgers", "streams")


def load():
    """All registered queries and their SQL twins."""
    for name in _MODULES:
        importlib.import_module(f"tidemark.plans.{name}")
    from tidemark.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
