"""All registered queries and their DuckDB counterparts, gathered from the plan modules."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that has to give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


for _name in ("calendar", "market", "text", "vectors", "statistics", "relations", "more", "derived", "documents"):
    if importlib.util.find_spec(f"tidegauge.plans.{_name}"):
        importlib.import_module(f"tidegauge.plans.{_name}")
