"""Every query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


CATALOG: dict[str, Query] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name."""

    def register(fn):
        CATALOG[name or fn.__name__] = Query(fn, oracle)
        return fn

    return register


def load() -> dict[str, Query]:
    """The catalogue with every query module imported."""
    from loomspark.plans import reference_queries, source_queries  # noqa: F401

    return CATALOG
