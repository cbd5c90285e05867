"""Wires the query modules and the oracle SQL together."""

from __future__ import annotations

import importlib

_MODULES = [
    "snapforge.plans.q_snapshots",
    "snapforge.plans.q_cleaning",
    "snapforge.plans.q_validation",
    "snapforge.plans.q_publish",
    "snapforge.plans.q_review",
    "snapforge.plans.q_metadata",
    "snapforge.plans.q_sources",
]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    _load()
    from snapforge.plans.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    _load()
    from snapforge.plans.oracles import ORACLES

    return {k: v for k, v in ORACLES.items()}
