"""Registered queries: every operator over the given tables, with SQL to check it."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Import all query modules; returns the queries and their SQL."""
    for module in pkgutil.iter_modules(__path__, __name__ + "."):
        importlib.import_module(module.name)
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
