"""Registered queries: an operator applied to the supplied tables, and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import oracle, view

Views = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARTS: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}
"""What each query was registered with: its function and SQL before views are put in."""


def query(name: str, sql: str | None = None):
    """Registers a function of views, v("bar") and so on, under a name with its oracle SQL."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: view(spark, sf_dir, n))

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], PARTS[name] = run, (f, sql)
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return register
