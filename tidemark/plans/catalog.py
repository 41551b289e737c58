"""The registry of runnable queries: a Spark builder, and SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.plans.tables import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables)`` under ``name``; views named in the oracle text are added to it."""

    def add(build):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, build, with_views(oracle) if oracle else None)
        return build

    return add
