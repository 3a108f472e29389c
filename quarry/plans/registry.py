"""All queries of the reference's operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t), t(name) being a table of the folder, as the query of that name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["weak_signals"](spark, sf_dir)


for _module in ("profile_queries", "signal_queries", "entity_queries", "graph_queries", "search_queries", "stream_queries", "source_queries", "pipeline_queries", "record_queries"):
    importlib.import_module(f"quarry.plans.{_module}")
