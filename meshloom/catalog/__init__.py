"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

import importlib

from meshloom.catalog.registry import ORACLES, QUERIES

MODULES = (
    "scaling_queries",
    "manifest_queries",
    "join_queries",
    "design_queries",
    "topology_queries",
    "strain_queries",
    "split_queries",
    "report_queries",
    "training_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """Import every query module once; returns (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
