"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from switchback.plans.catalog import ORACLES, QUERIES

_MODULES = ("profile_queries", "segment_queries", "scalar_queries", "graph_queries", "route_queries", "service_queries", "pipeline_queries")
for _name in _MODULES:
    import_module(f"switchback.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["m0_flagship_ascent_in_reach"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
