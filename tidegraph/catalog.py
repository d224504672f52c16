"""All registered queries of the network engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegraph.queries import base, graphs, relational, series  # noqa: F401  registering


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.single_layer(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
