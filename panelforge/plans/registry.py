"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.plans import block_queries, chain_queries, dealt, extra_queries, kernel_queries, panel_queries, window_queries

MODULES = [dealt, panel_queries, block_queries, kernel_queries, extra_queries, window_queries, chain_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return dealt.p1_rolling(spark, folder)
