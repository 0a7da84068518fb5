"""Continuous periods and gaps of overlapping time intervals, merged on two levels.

Intervals are clipped into time shards and merged within each, then what
touches a shard's ends is stitched to its neighbours.

Scale: of the pieces of an entity in a shard that begin on one day only the
longest counts, so pieces are reduced by (entity, shard, start) before they
move. No group then has more rows than a shard has days, however many intervals
an entity has; the stitch of an entity sees at most its merged runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(pieces: DataFrame, group: list[str], tolerance: int) -> DataFrame:
    """Runs of pieces (a, b in days) that overlap or follow within ``tolerance`` days."""
    order = Window.partitionBy(*group).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("a") > reach + tolerance), 1).otherwise(0)
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("fresh", fresh).withColumn("run", run).groupBy(*group, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def periods(intervals: DataFrame, entity: list[str], start: Column, end: Column, tolerance: int = 1, shard_days: int = 1024) -> DataFrame:
    """Longest runs of covered days: the entity columns, startdt, enddt (dates, both included).

    Intervals within ``tolerance`` days of each other are one run; 1 joins
    those that follow each other day by day. Intervals with a null start or
    end, a null entity column, or an end before the start are ignored.
    """
    days = intervals.select(*entity, F.unix_date(start).alias("a"), F.unix_date(end).alias("b")).where(" and ".join(["a <= b", *(f"{c} is not null" for c in entity)]))
    shard = F.explode(F.sequence(F.floor(F.col("a") / shard_days).cast("int"), F.floor(F.col("b") / shard_days).cast("int")))
    low = F.col("shard") * shard_days
    pieces = (
        days.withColumn("shard", shard)
        .select(*entity, "shard", F.greatest("a", low).alias("a"), F.least("b", low + shard_days - 1).alias("b"))
        .groupBy(*entity, "shard", "a")
        .agg(F.max("b").alias("b"))
    )
    local = _merged(pieces, [*entity, "shard"], tolerance).drop("shard")
    whole = _merged(local, entity, tolerance)
    return whole.select(*entity, F.date_from_unix_date("a").alias("startdt"), F.date_from_unix_date("b").alias("enddt"))


def gaps(runs: DataFrame, entity: list[str]) -> DataFrame:
    """The uncovered days between two periods of an entity, with the columns of ``periods``."""
    follows = F.lead("startdt").over(Window.partitionBy(*entity).orderBy("startdt"))
    return (
        runs.withColumn("follows", follows)
        .where("follows is not null")
        .select(*entity, F.date_add("enddt", 1).alias("startdt"), F.date_add("follows", -1).alias("enddt"))
    )


def periods_and_gaps(intervals: DataFrame, entity: list[str], start: Column, end: Column, shard_days: int = 1024) -> DataFrame:
    """Periods and gaps in one frame: kind 'period' or 'gap', the entity columns, startdt, enddt."""
    runs = periods(intervals, entity, start, end, shard_days=shard_days)
    follows = F.lead("startdt").over(Window.partitionBy(*entity).orderBy("startdt"))
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("startdt"), F.col("enddt")),
        F.struct(F.lit("gap").alias("kind"), F.date_add("enddt", 1).alias("startdt"), F.date_add("follows", -1).alias("enddt")),
    )
    return (
        runs.withColumn("follows", follows)
        .select(*entity, "follows", F.explode(both).alias("x"))
        .where("x.kind = 'period' or follows is not null")
        .select("x.kind", *entity, "x.startdt", "x.enddt")
    )
