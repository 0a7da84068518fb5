"""The dense asset panel made of order lines, and what hangs on it, in Spark and in SQL.

An asset is a brand, a period a week, its market value the net value of its
lines, and its return the bounded symmetric change of that value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.session import cut
from panelforge.sources import table

#: Periods: estimation window, rebalance step, lag of market values, least history, assets, purge and embargo, folds.
WINDOW, EVERY, LAG, HISTORY, ASSETS, PURGE, FOLDS = 104, 4, 4, 52, 15, 4, 4
YEAR = 52


def asset_panel(spark: SparkSession, folder: str, unit: str = "week", asset: str = "p_brand") -> DataFrame:
    """permno, pos, date, mcap, ret."""
    lines = table(spark, folder, "lineitem", "l_partkey", "l_extendedprice", "l_discount", "l_shipdate")
    part = table(spark, folder, "part", "p_partkey", asset)
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    value = joined.groupBy(F.col(asset).alias("asset"), F.trunc(F.to_date("l_shipdate"), unit).alias("t")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    days = value.select("t").distinct().select("t", (F.row_number().over(Window.orderBy("t")) - 1).cast("bigint").alias("pos"))
    ids = value.select("asset").distinct().select("asset", F.dense_rank().over(Window.orderBy("asset")).cast("bigint").alias("permno"))
    own = Window.partitionBy("asset").orderBy("t")
    before = F.lag("value").over(own)
    return (
        value.withColumn("ret", F.round(0.1 * (F.col("value") - before) / (F.col("value") + before), 9))
        .join(days, "t")
        .join(ids, "asset")
        .select("permno", "pos", F.col("t").alias("date"), F.round("value", 4).alias("mcap"), "ret")
    )


P = """
v as (select p_brand as asset, cast(date_trunc('week', l_shipdate) as date) as t, sum(l_extendedprice * (1 - l_discount)) as value from lineitem join part on l_partkey = p_partkey group by 1, 2),
cal as (select t, row_number() over (order by t) - 1 as pos from (select distinct t from v)),
ids as (select asset, dense_rank() over (order by asset) as permno from (select distinct asset from v)),
p as (select cast(permno as bigint) as permno, cast(pos as bigint) as pos, v.t as date, round(value, 4) as mcap,
  round(0.1::double * (value - lag(value) over w) / (value + lag(value) over w), 9) as ret
  from v join cal on v.t = cal.t join ids on v.asset = ids.asset window w as (partition by v.asset order by v.t))
"""


def matrix_block(spark: SparkSession, folder: str, low: int = 101, size: int = WINDOW, assets: int = 13) -> DataFrame:
    """t (0 the oldest), i (1 to ``assets``), x: a window of returns, a missing one 0."""
    p = asset_panel(spark, folder)
    held = p.where(F.col("pos").between(low, low + size - 1) & (F.col("permno") <= assets)).select((F.col("pos") - low).alias("t"), F.col("permno").alias("i"), F.col("ret").alias("r"))
    grid = spark.range(size).select(F.col("id").alias("t")).withColumn("i", F.explode(F.expr(f"sequence(1L, {assets}L)")))
    return grid.join(held, ["t", "i"], "left").select("t", "i", F.coalesce("r", F.lit(0.0)).alias("x"))


def last_position(panel: DataFrame) -> int:
    """The last position of a panel, 0 without rows."""
    return int(panel.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last")).first()["last"])


def trailing_windows(spark: SparkSession, folder: str) -> DataFrame:
    """pos, t (0 the oldest), i, x: the window up to every rebalance of all assets with a return in it, a missing one 0."""
    p = cut(asset_panel(spark, folder))
    marks = p.select("pos").distinct().where((F.col("pos") >= WINDOW) & ((F.col("pos") - WINDOW) % EVERY == 0))
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(WINDOW - 1).cast("bigint")))
    at = marks.withColumn("t", step).withColumn("at", F.col("pos") - WINDOW + 1 + F.col("t"))
    known = at.join(p.where("ret is not null").select(F.col("pos").alias("at"), F.col("permno").alias("i"), F.col("ret").alias("r")), "at").drop("at")
    grid = known.select("pos", "i").distinct().withColumn("t", step)
    return cut(grid.join(known, ["pos", "t", "i"], "left").select("pos", "t", "i", F.coalesce("r", F.lit(0.0)).alias("x")))


def block_sql(low: int = 101, size: int = WINDOW, assets: int = 13) -> str:
    return f"""{P}, x as (select g.t, a.i, coalesce(p.ret, 0) as x from range({size}) g(t) cross join range(1, {assets + 1}) a(i) left join p on p.pos = g.t + {low} and p.permno = a.i)"""


def total_value(spark: SparkSession, folder: str) -> DataFrame:
    """run, pos, x: the value of the whole market by week, on one run."""
    return asset_panel(spark, folder).groupBy("pos").agg(F.sum("mcap").alias("v")).select(F.lit(0).alias("run"), "pos", (F.col("v") / 1e6).alias("x"))


TOTAL = f"{P}, total as (select pos, sum(mcap) / 1e6::double as x from p group by pos)"
