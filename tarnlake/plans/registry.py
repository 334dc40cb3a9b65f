"""Queries by name and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tarnlake.plans import analysis, behaviour, conversed, encoding, matched, observed, placed, prompted, recorded, released, runs, stored

PLANS = (behaviour, analysis, observed, matched, recorded, encoding, conversed, stored, placed, prompted, released, runs)
QUERIES: dict = {name: f for plan in PLANS for name, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
