"""All registered query plans: name -> callable(spark, sf_dir) and name -> oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["detectors", "prep_queries", "profile_queries", "compare_queries", "pool_queries",
            "model_queries"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = import_module(f"tripwire.plans.{m}")
        out.update(getattr(mod, attr, {}))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")


def flagship(spark, sf_dir: str):
    """prepare → forest on benign train → SGD cascade → evaluation record."""
    from .model_queries import QUERIES as MQ

    return MQ["sgd_cascade"](spark, sf_dir)
