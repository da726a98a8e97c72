"""All queries of the engine."""

from __future__ import annotations

from tarnmill.plans import cases, decisions, dedup, extraction, joins, reports, rules, series, sinks, sources, states, texts, whole  # noqa: F401
from tarnmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
