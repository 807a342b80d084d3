"""Every registered query of the engine with its oracle SQL."""

from __future__ import annotations

from stratiform.operators import advice, calibration, dispatch, evaluation, location, materialise, rollup, runs, scalars, snapshot, store, stored_json  # noqa: F401
from stratiform.plans import tools  # noqa: F401
from stratiform.registry import REGISTRY
from stratiform.streaming import runs as streams  # noqa: F401

FLAGSHIP = "agg_district_hourly"


def queries() -> dict:
    return {name: function for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
