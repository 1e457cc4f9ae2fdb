"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.checks.roles import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MODULES = ("q_sources", "q_screen", "q_series", "q_metrics", "q_multiples", "q_scenarios", "q_gate", "q_scoring", "q_streams", "q_text", "q_events")


class Tables:
    """``t("orders")`` gives a driver table or role of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``, with its DuckDB twin if any."""

    def put(fn):
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"talus.checks.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
