"""As-of universes: who may be held at each rebalance, all rebalances at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UniverseRule:
    """Sizes and lags in calendar positions."""

    n_assets: int = 100
    min_history: int = 252
    cap_lag: int = 21
    every: int = 21


def rebalances(days: DataFrame, low: int, high: int, every: int) -> DataFrame:
    """Every ``every``-th position from ``low`` to ``high``."""
    return days.where(F.col("pos").between(low, high) & (F.pmod(F.col("pos") - low, F.lit(every)) == 0)).select("pos", "date")


def candidates(panel: DataFrame, members: DataFrame, marks: DataFrame, rule: UniverseRule) -> DataFrame:
    """Per rebalance and member: eligible or not, and the lagged market value.

    ``members``: permno, mbrstartdt, mbrenddt. Eligible: a member on the date,
    ``min_history`` returns before it, and a return on it. The market value is
    the last known one at or before ``cap_lag`` positions earlier. All three
    come from running windows per security, in one shuffle by security.
    """
    at = [int(r["pos"]) for r in marks.select("pos").collect()]  # a few hundred positions
    dates = marks.select(F.col("pos"), F.col("date"))
    grid = panel.select("permno").distinct().withColumn("pos", F.explode(F.array(*(F.lit(x).cast("bigint") for x in at)))).join(dates, "pos").select("permno", "pos", "date")
    up_to = Window.partitionBy("permno").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = panel.select("permno", F.col("pos").alias("at"), F.lit(0).alias("kind"), "ret", "mcap", F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("date").alias("date"))
    none = F.lit(None).cast("double")
    before = grid.select("permno", F.greatest(F.col("pos") - 1, F.lit(0)).alias("at"), F.lit(1).alias("kind"), none.alias("ret"), none.alias("mcap"), "pos", "date")
    lagged = grid.select("permno", F.greatest(F.col("pos") - rule.cap_lag, F.lit(0)).alias("at"), F.lit(2).alias("kind"), none.alias("ret"), none.alias("mcap"), "pos", "date")
    run = (
        seen.unionByName(before)
        .unionByName(lagged)
        .withColumn("history", F.count("ret").over(up_to))
        .withColumn("cap", F.last("mcap", ignorenulls=True).over(up_to))
        .where("kind > 0")
        .groupBy("permno", "pos", "date")
        .agg(F.max(F.when(F.col("kind") == 1, F.col("history"))).alias("history"), F.max(F.when(F.col("kind") == 2, F.col("cap"))).alias("cap"))
    )
    now = panel.where("ret is not null").select("permno", "pos", F.lit(True).alias("alive"))
    m = members.select(F.col("permno").alias("__p"), "mbrstartdt", "mbrenddt")
    inside = (F.col("permno") == F.col("__p")) & F.col("date").between(F.col("mbrstartdt"), F.col("mbrenddt"))
    return (
        run.join(m, inside, "left_semi")
        .join(now, ["permno", "pos"], "left")
        .withColumn("seasoned", F.col("history") >= rule.min_history)
        .withColumn("eligible", F.col("seasoned") & F.coalesce("alive", F.lit(False)))
        .select("permno", "pos", "date", "cap", "seasoned", "eligible")
    )


def snapshots(panel: DataFrame, members: DataFrame, marks: DataFrame, rule: UniverseRule) -> DataFrame:
    """pos, date, rank, permno, cap: the ``n_assets`` eligible members of largest lagged value, ties by permno."""
    order = Window.partitionBy("pos").orderBy(F.col("cap").desc_nulls_last(), "permno")
    held = candidates(panel, members, marks, rule).where("eligible")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.n_assets).select("pos", "date", "rank", "permno", "cap")


def realised_sizes(panel: DataFrame, members: DataFrame, marks: DataFrame, rule: UniverseRule) -> DataFrame:
    """Per rebalance the members, eligible, selected and unseasoned ones, and the turnover of the selection."""
    every = candidates(panel, members, marks, rule)
    counts = every.groupBy("pos", "date").agg(
        F.count("*").alias("n_members"), F.sum(F.col("eligible").cast("bigint")).alias("n_eligible"), F.sum((~F.col("seasoned")).cast("bigint")).alias("n_unseasoned")
    )
    picked = snapshots(panel, members, marks, rule).groupBy("pos").agg(F.collect_set("permno").alias("held"))
    before = F.lag("held").over(Window.orderBy("pos"))
    moved = F.size(F.array_except("held", "before")) + F.size(F.array_except("before", "held"))
    largest = F.greatest(F.size("held"), F.size("before"), F.lit(1))
    sets = picked.withColumn("before", before).select("pos", F.size("held").cast("bigint").alias("n_selected"), F.when(F.col("before").isNotNull(), moved / (2 * largest)).alias("turnover"))
    return counts.join(sets, "pos", "left").select("pos", "date", "n_members", "n_eligible", F.coalesce("n_selected", F.lit(0).cast("bigint")).alias("n_selected"), "n_unseasoned", "turnover")


def window_for(median_size: float, candidates_: tuple[int, ...] = (504, 756), most: float = 0.67) -> int:
    """The smallest window for which assets by days stay at or below ``most``."""
    fit = [w for w in sorted(candidates_) if median_size / w <= most]
    if not fit:
        raise ValueError(f"no window of {candidates_} holds {median_size} assets at a ratio of {most}")
    return fit[0]
