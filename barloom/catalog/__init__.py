"""Registered queries by area."""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "timeseries", "mining", "ingest", "alignment", "patterns", "vectors", "reviews", "evaluation", "labeling", "phases", "modeling", "stores",
]


def load_all():
    for area in AREAS:
        import_module(f"barloom.catalog.{area}")
    from barloom.catalog.core import ORACLES, QUERIES

    return QUERIES, ORACLES
