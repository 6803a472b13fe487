"""The registry of named queries: each name maps to a plan builder and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Decorator that adds a plan builder under ``name``."""

    def add(plan: Plan) -> Plan:
        _PLANS[name] = plan
        if oracle is not None:
            _ORACLES[name] = oracle
        return plan

    return add


def _load() -> None:
    from terrane.plans import library  # noqa: F401 - importing registers the plans


def queries() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
