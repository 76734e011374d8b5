"""Registered queries and their SQL checks."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL, Query

_MODULES = ("profiling", "features", "predictions", "history", "modelling", "contest")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
