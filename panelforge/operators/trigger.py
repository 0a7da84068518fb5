"""When to refit: trailing statistics of a slow series, all by windows over its positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that the mean spans, that the deviation spans, and values that it needs.
SMOOTH, TRAIL, LEAST = 5, 12, 6


def trigger_inputs(series: DataFrame, by: list[str], smooth: int = SMOOTH, trail: int = TRAIL, least: int = LEAST) -> DataFrame:
    """Adds ``level`` (trailing mean of x), ``d`` (its change) and ``sigma``.

    sigma is the deviation of the changes before the position, never of its own.
    """
    order = Window.partitionBy(*by).orderBy("pos")
    past = order.rowsBetween(-trail, -1)
    return (
        series.withColumn("level", F.avg("x").over(order.rowsBetween(1 - smooth, 0)))
        .withColumn("d", F.col("level") - F.lag("level").over(order))
        .withColumn("sigma", F.when(F.count("d").over(past) >= least, F.stddev_samp("d").over(past)))
    )


def fired(gamma: float) -> Column:
    """Whether the change exceeds ``gamma`` sigmas; unknown counts as no."""
    return F.coalesce(F.abs("d") > gamma * F.col("sigma"), F.lit(False))


def trigger_set(inputs: DataFrame, by: list[str], gamma: float) -> DataFrame:
    """Fired positions, numbered among the eligible ones (sigma known) from 0: by, j."""
    eligible = inputs.where("sigma is not null").withColumn("j", (F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1).cast("bigint"))
    return eligible.where(fired(gamma)).select(*by, "j")


def refits(inputs: DataFrame, by: list[str], policy: str, gamma: float = 1.0) -> DataFrame:
    """Adds ``refit`` by a policy: 'never', 'periodic:k' or 'trigger'; the first position always fits.

    As built, 'periodic:k' refits every k + 1 positions: its counter starts at
    0 after a fit and must reach k before a position.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos")) - 1
    if policy == "never":
        rule = F.lit(False)
    elif policy.startswith("periodic:"):
        rule = F.pmod(n, F.lit(int(policy.split(":")[1]) + 1)) == 0
    elif policy == "trigger":
        rule = fired(gamma)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return inputs.withColumn("refit", (n == 0) | rule)
