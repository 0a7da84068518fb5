"""Portfolio weights as relations: rows (i, k, s) of a covariance in, rows (i, w) out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.linalg import bisection_nodes


def equal_weights(held: DataFrame, by: list[str]) -> DataFrame:
    """One by the number of assets of each group."""
    return held.withColumn("w", 1 / F.count("*").over(Window.partitionBy(*by)))


def bisection_weights(s: DataFrame, leaves: DataFrame, n: int, by: list[str] = (), volatility: bool = False) -> DataFrame:
    """Hierarchical risk parity without recursion.

    ``leaves``: i and leaf_pos (0 to n - 1). How a list of ``n`` leaves is
    halved does not depend on data, so all splits are one small table; the risk
    of every side of every split comes from one join with the pairs, and an
    asset's weight is the product of the shares of the sides that hold it. With
    ``volatility`` members are weighted by 1/sigma and sides compared by sigma.
    """
    by = list(by)
    spark = s.sparkSession
    sides = [(a, side, lo, hi) for a, (low, mid, high) in enumerate(bisection_nodes(n)) for side, lo, hi in (("l", low, mid), ("r", mid, high))]
    table = F.broadcast(spark.createDataFrame(sides, "node int, side string, lo int, hi int"))  # 2 n rows
    variance = F.greatest(F.col("s"), F.lit(1e-16))
    own = s.where("i = k").select(*by, "i", (1 / F.sqrt(variance) if volatility else 1 / variance).alias("inv"))
    member = leaves.select(*by, "i", "leaf_pos").join(own, [*by, "i"]).join(table, (F.col("leaf_pos") >= F.col("lo")) & (F.col("leaf_pos") < F.col("hi")))
    member = member.withColumn("q", F.col("inv") / F.sum("inv").over(Window.partitionBy(*by, "node", "side"))).select(*by, "node", "side", "i", "q")
    other = member.select(*by, "node", "side", F.col("i").alias("k"), F.col("q").alias("q2"))
    risk = member.join(other, [*by, "node", "side"]).join(s.select(*by, "i", "k", "s"), [*by, "i", "k"]).groupBy(*by, "node", "side").agg(F.sum(F.col("q") * F.col("q2") * F.col("s")).alias("v"))
    risk = risk.withColumn("v", F.sqrt(F.greatest("v", F.lit(0.0)))) if volatility else risk
    whole = F.sum("v").over(Window.partitionBy(*by, "node"))
    left = F.when(whole > 0, 1 - F.max(F.when(F.col("side") == "l", F.col("v"))).over(Window.partitionBy(*by, "node")) / whole).otherwise(0.5)
    share = risk.withColumn("left", left).select(*by, "node", "side", F.when(F.col("side") == "l", F.col("left")).otherwise(1 - F.col("left")).alias("share"))
    w = member.join(share, [*by, "node", "side"]).groupBy(*by, "i").agg(F.product("share").alias("w"))
    return w.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))))


def risk_contributions(s: DataFrame, weights: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per asset its share of the portfolio's variance."""
    by = list(by)
    a = weights.select(*by, "i", F.col("w").alias("wi"))
    b = weights.select(*by, F.col("i").alias("k"), F.col("w").alias("wk"))
    own = s.join(a, [*by, "i"]).join(b, [*by, "k"]).groupBy(*by, "i").agg(F.sum(F.col("wi") * F.col("wk") * F.col("s")).alias("rc"))
    total = F.sum("rc").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return own.select(*by, "i", F.when(total > 0, F.col("rc") / total).otherwise(F.col("rc")).alias("rc"))


def tilted_weights(forward: DataFrame, by: list[str], strength: float) -> DataFrame:
    """Equal weights blended with weights by the rank of a coming return: a control with a known edge. Ties by i."""
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.coalesce("fwd", F.lit(0.0)), "i")) - 1
    ranked = forward.withColumn("rank", rank.cast("double"))
    even = 1 / F.count("*").over(group)
    tilt = F.col("rank") / F.greatest(F.sum("rank").over(group), F.lit(1e-12))
    return ranked.withColumn("w", (1 - strength) * even + strength * tilt)
