"""Walk-forward holdings in closed form.

Between rebalances a holding grows by its own returns until its first missing
one, and by the cash rate from then on; so the value of a portfolio on a day is
a sum over holdings of running products, and returns, drifted weights and
turnover follow from it without walking the days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import cut


def holding_windows(marks: DataFrame, by: list[str], lag: int, last: int) -> DataFrame:
    """Per rebalance the first and last position held: ``lag`` after it, to just before the next one's first."""
    follows = F.lead("pos").over(Window.partitionBy(*by).orderBy("pos"))
    return marks.select(*by, "pos", (F.col("pos") + lag).alias("start"), F.coalesce(follows + lag - 1, F.lit(last).cast("bigint")).alias("end")).where("start <= end")


def grown(weights: DataFrame, windows: DataFrame, panel: DataFrame, rates: DataFrame, by: list[str]) -> DataFrame:
    """Per held asset and day: its value (from its weight), the value of cash, and whether it still trades."""
    held = weights.join(windows, [*by, "pos"]).withColumn("day", F.explode(F.sequence("start", "end")))
    days = held.join(panel.select("permno", F.col("pos").alias("day"), "ret"), ["permno", "day"], "left").join(rates.select(F.col("pos").alias("day"), "rf"), "day", "left")
    run = Window.partitionBy(*by, "pos", "permno").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.coalesce("rf", F.lit(0.0))
    gone = F.max(F.col("ret").isNull().cast("int")).over(run)
    days = days.withColumn("gone", gone)
    step = F.when(F.col("gone") == 1, 1 + rate).otherwise(1 + F.col("ret"))
    return days.withColumn("value", F.col("w") * F.product(step).over(run)).withColumn("cash", F.product(1 + rate).over(run)).select(*by, "pos", "start", "end", "day", "permno", "w", "value", "cash", "gone")


def portfolio_values(days: DataFrame, by: list[str]) -> DataFrame:
    """Per segment and day the portfolio's value and its gross return."""
    value = days.groupBy(*by, "pos", "start", "day").agg((F.sum("value") + (1 - F.sum("w")) * F.max("cash")).alias("total"))
    before = F.coalesce(F.lag("total").over(Window.partitionBy(*by, "pos").orderBy("day")), F.lit(1.0))
    return value.withColumn("gross", F.col("total") / before - 1)


def drifted(days: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """The weights at the end of each segment; what no longer trades has none."""
    ends = days.where("day = end").join(values.select(*by, "pos", "day", "total"), [*by, "pos", "day"])
    return ends.select(*by, "pos", "permno", F.when(F.col("gone") == 1, 0.0).otherwise(F.col("value") / F.col("total")).alias("w"))


def turnover(weights: DataFrame, windows: DataFrame, drift: DataFrame, by: list[str], bps: float) -> DataFrame:
    """Per rebalance the half of all weight moved, and the cost of moving it; the first moves everything."""
    following = windows.select(*by, "pos", F.lead("pos").over(Window.partitionBy(*by).orderBy("pos")).alias("next"))
    old = drift.join(following, [*by, "pos"]).where("next is not null").select(*by, F.col("next").alias("pos"), "permno", F.col("w").alias("was"))
    moved = weights.join(windows.select(*by, "pos"), [*by, "pos"], "left_semi").join(old, [*by, "pos", "permno"], "full")
    dw = F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
    return moved.groupBy(*by, "pos").agg((0.5 * dw).alias("turnover"), (dw * bps / 1e4).alias("cost"))


def run(weights: DataFrame, marks: DataFrame, panel: DataFrame, rates: DataFrame, by: list[str], lag: int = 1, last: int | None = None, bps: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Daily returns (by, day, gross, net) and moves (by, pos, turnover, cost) of strategies.

    ``weights``: by, pos, permno, w. The cost of a rebalance is taken on its
    first held day.
    """
    last = panel.agg(F.max("pos")).first()[0] if last is None else last
    windows = holding_windows(marks, by, lag, last)
    days = cut(grown(weights, windows, panel, rates, by))  # read for values, and again at the ends of segments
    values = portfolio_values(days, by)
    moves = cut(turnover(weights, windows, drifted(days, values, by), by, bps))
    net = values.join(moves, [*by, "pos"]).withColumn("net", F.when(F.col("day") == F.col("start"), (1 + F.col("gross")) * (1 - F.col("cost")) - 1).otherwise(F.col("gross")))
    return net.select(*by, "pos", "day", "gross", "net"), moves


def metrics(daily: DataFrame, by: list[str], year: int, ret: str = "net") -> DataFrame:
    """Annual return, volatility, Sharpe ratio, worst fall and Calmar ratio per strategy.

    ``daily`` holds rf too. The curve of the worst fall starts after the first
    day, so a loss on it does not count. Fewer than two days, or no deviation,
    give a null ratio.
    """
    order = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.where(F.col(ret).isNotNull()).withColumn("wealth", F.sum(F.log1p(ret)).over(order))
    rows = rows.withColumn("fall", F.exp(F.col("wealth") - F.max("wealth").over(order)) - 1).withColumn("excess", F.col(ret) - F.coalesce("rf", F.lit(0.0)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_days"), F.sum(F.log1p(ret)).alias("total"), (F.stddev_samp(ret) * year**0.5).alias("ann_vol"), F.avg("excess").alias("m"), F.stddev_samp("excess").alias("sd"), F.min("fall").alias("max_drawdown")
    )
    annual = F.exp(F.col("total") * year / F.col("n_days")) - 1
    return out.select(
        *by, "n_days", annual.alias("ann_return"), "ann_vol", F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * year**0.5).alias("sharpe"), "max_drawdown",
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).alias("calmar"),
    )


def folds(low: int, high: int, least: int, count: int, purge: int) -> list[tuple[int, int, int, int, int]]:
    """Expanding walk-forward folds: (fold, train_lo, train_hi, test_lo, test_hi).

    The last test block takes the remainder. The embargo after a test block
    lies inside the purged rows, so it removes nothing further.
    """
    size = (high - low + 1 - least) // count
    if size <= 0:
        raise ValueError("the region is shorter than the least training block and one row a fold")
    out = []
    for i in range(count):
        first = low + least + i * size
        final = high if i == count - 1 else first + size - 1
        if final > first and first - purge - low >= least // 2:
            out.append((i + 1, low, first - 1 - purge, first, final))
    return out
