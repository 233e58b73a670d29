"""Catalogue of registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module of this folder and return (queries, SQL twins)."""
    from pagetext.catalog.registry import ORACLES, QUERIES

    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("q_"):
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
