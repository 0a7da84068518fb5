"""The valid delivery of every listing and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_rows(dsf: DataFrame, *values: str) -> DataFrame:
    """One row per (permno, lineno, date): the one with the latest loadts, then the highest obs_id.

    Every task reduces what it reads to a row a listing and date before
    anything moves, so redeliveries of a day do not.
    A null loadts counts as earliest; null keys form groups of their own.
    """
    newest = F.max(F.struct("loadts", "obs_id", *values)).alias("v")
    return (
        dsf.select("permno", "lineno", "date", "loadts", "obs_id", *values)
        .groupBy("permno", "lineno", "date")
        .agg(newest)
        .select("permno", "lineno", "date", *(F.col(f"v.{c}").alias(c) for c in values))
    )
