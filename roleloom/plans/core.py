"""Registration of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to tables and views: ``t.v_jobs``; ``t.dealt("v_jobs")`` has its rows spread for work on each of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def dealt(self, name: str, table: str = "orders") -> DataFrame:
        return view(self.spark, self.sf_dir, name, table)


def register(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the DuckDB check with ``{view}`` references."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return wrap
