"""Registered queries and their SQL, gathered from the library's modules."""

from __future__ import annotations

from .functions import geocues, payload
from .plans import planner
from .sources import images
from .streaming import incremental
from .operators import detection, findings, report, rules, sensitive, similarity, statistics, store

MODULES = (sensitive, payload, geocues, similarity, store, statistics, planner, rules, detection, report, images, incremental, findings)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
