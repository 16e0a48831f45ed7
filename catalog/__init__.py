"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    from catalog import (  # noqa: F401
        coverage,
        enrich,
        ingest,
        layers,
        rollups,
        scalars,
        statistics,
        trends,
        views,
    )
