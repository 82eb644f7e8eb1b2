"""Queries that run every operator on the given tables, with the SQL to compare to."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "metric_checks",
    "source_checks",
    "curation_checks",
    "evaluation_checks",
    "scalar_checks",
)


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict:
    from evalweave.checks.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from evalweave.checks.registry import ORACLES

    _load()
    return dict(ORACLES)
