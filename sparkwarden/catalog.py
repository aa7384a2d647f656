"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

import importlib

from sparkwarden.plans import registry

MODULES = (
    "sparkwarden.operators.history",
    "sparkwarden.operators.projections",
    "sparkwarden.operators.relational",
    "sparkwarden.operators.spatial",
    "sparkwarden.operators.policy",
    "sparkwarden.operators.simulation",
    "sparkwarden.operators.routing",
    "sparkwarden.operators.risk",
    "sparkwarden.operators.composite",
    "sparkwarden.plans.chartspec",
    "sparkwarden.plans.views",
    "sparkwarden.sources.landed",
    "sparkwarden.sources.reference",
    "sparkwarden.sources.workbook",
    "sparkwarden.streaming.events",
)


def load() -> None:
    """Import every module that registers queries."""
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    load()
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    load()
    return registry.ORACLES
