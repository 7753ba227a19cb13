"""Where queries and their SQL checks are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.catalog.views import select, view, with_views


class Tables:
    """Views by attribute: ``t.v_logs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self._spark, self._dir, name)

    def sql(self, text: str) -> DataFrame:
        """A query over views, written for both engines."""
        return select(self._spark, self._dir, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` with the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return fn

    return add
