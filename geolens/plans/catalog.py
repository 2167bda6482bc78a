"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolens.plans import predict_queries, scalar_queries, source_queries, spatial_queries, table_queries
from geolens.plans.views import Tables

_GROUPS = (scalar_queries, table_queries, spatial_queries, predict_queries, source_queries)
FLAGSHIP = "evaluate_summary"


def _bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for group in _GROUPS for name, fn in group.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
