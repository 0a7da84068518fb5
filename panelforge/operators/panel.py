"""Survivorship-safe asset panels in long form: one row per position and asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share and exchange codes of ordinary common shares on the main exchanges.
SHARE_CODES, EXCHANGE_CODES = (10, 11), (1, 2, 3)
#: Performance delistings are codes 500 to 599, 400 and 401; a missing return of one is -0.30.
PERFORMANCE_CODES, MISSING_RETURN = (400, 401), -0.30


def finite(column: str | Column) -> Column:
    """Not null, not NaN, not infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def common_shares(names: DataFrame) -> DataFrame:
    """The names rows of ordinary common shares on the main exchanges."""
    return names.where(F.col("shrcd").isin(*SHARE_CODES) & F.col("exchcd").isin(*EXCHANGE_CODES))


def ever_valid(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the securities that any names row makes eligible."""
    return rows.join(common_shares(names).select("permno"), "permno", "left_semi")


def valid_on_date(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows inside an eligible names spell of their security; a row in two spells comes twice."""
    spells = common_shares(names).select("permno", "namedt", "nameendt")
    return rows.join(spells, "permno").where("date between namedt and nameendt").drop("namedt", "nameendt")


def inside_spells(rows: DataFrame, spells: DataFrame, start: str, end: str) -> DataFrame:
    """Rows that lie in at least one spell of their security, each once."""
    s = spells.select(F.col("permno").alias("__p"), F.col(start).alias("__a"), F.col(end).alias("__b"))
    return rows.join(s, (F.col("permno") == F.col("__p")) & F.col("date").between(F.col("__a"), F.col("__b")), "left_semi")


def filled_delistings(delist: DataFrame, held: DataFrame, fill: bool = True) -> DataFrame:
    """Delistings of held securities with a return for each, and where it came from."""
    ours = delist.join(held.select("permno").distinct(), "permno", "left_semi")
    failed = F.coalesce(F.col("dlstcd").between(500, 599) | F.col("dlstcd").isin(*PERFORMANCE_CODES), F.lit(False))
    if not fill:
        return ours.where("dlret is not null").withColumn("source", F.lit("observed"))
    source = F.when(F.col("dlret").isNotNull(), "observed").when(failed, "performance").otherwise("other")
    value = F.coalesce("dlret", F.when(failed, F.lit(MISSING_RETURN)).otherwise(F.lit(0.0)))
    return ours.withColumn("source", source).withColumn("dlret", value)


def splice_delistings(daily: DataFrame, delist: DataFrame, fill: bool = True) -> DataFrame:
    """``daily`` with delisting returns compounded in; dates only in ``delist`` become rows.

    Adds dlret, dlstcd, source and had_row (false for a row made here).
    """
    gone = filled_delistings(delist, daily, fill).select("permno", F.col("dlstdt").alias("date"), "dlret", "dlstcd", "source")
    both = daily.withColumn("had_row", F.lit(True)).join(gone, ["permno", "date"], "full")
    spliced = F.when(F.col("dlret").isNotNull(), (1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.col("dlret")) - 1).otherwise(F.col("ret"))
    return both.withColumn("ret", spliced).withColumn("had_row", F.coalesce("had_row", F.lit(False)))


def market_value(price: str = "prc", shares: str = "shrout") -> Column:
    """abs(price) times shares; a negative price is a quote midpoint."""
    return F.abs(F.col(price)) * F.col(shares)


def last_value(rows: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Per permno and date the last value that is not null, by an explicit order."""
    window = Window.partitionBy("permno", "date").orderBy(*order)
    return rows.where(F.col(value).isNotNull() & F.col("date").isNotNull()).withColumn("__n", F.row_number().over(window)).where("__n = 1").select("permno", "date", value)


def calendar(dates: DataFrame) -> DataFrame:
    """pos and date of every distinct date, from 0."""
    return dates.select("date").where("date is not null").distinct().select((F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("pos"), "date")


ORDER = ["loadts", "lineno", "obs_id"]


def build_panel(dsf: DataFrame, names: DataFrame | None, delist: DataFrame) -> DataFrame:
    """permno, pos, date, ret, mcap from raw tables.

    The calendar is the dates on which any security has a return. Of several
    rows of a security and date the last non-null value counts, by loadts,
    lineno, obs_id and value, nulls first.
    """
    rows = dsf if names is None else ever_valid(dsf, names)
    spliced = splice_delistings(rows, delist).withColumn("mcap", market_value())
    order = [F.col(c).desc_nulls_last() for c in ORDER]
    returns = last_value(spliced, "ret", [*order, F.col("ret").desc()])
    values = last_value(spliced, "mcap", [*order, F.col("mcap").desc()])
    days = calendar(returns)
    return returns.join(values, ["permno", "date"], "full").join(F.broadcast(days), "date").select("permno", "pos", "date", "ret", "mcap")


def aligned_rate(days: DataFrame, rf: DataFrame) -> DataFrame:
    """pos, date, rf: the last known rate up to each date, 0 before the first."""
    rate = F.last("rf", ignorenulls=True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(rf, "date", "left").select("pos", "date", F.coalesce(rate, F.lit(0.0)).alias("rf"))


def as_of_position(asked: DataFrame, days: DataFrame) -> DataFrame:
    """Per asked date the last calendar position at or before it, -1 before the first."""
    both = asked.select(F.col("date"), F.lit(1).alias("asked"), F.lit(None).cast("bigint").alias("pos")).unionByName(days.select("date", F.lit(0).alias("asked"), "pos"))
    last = F.last("pos", ignorenulls=True).over(Window.orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("pos", F.coalesce(last, F.lit(-1).cast("bigint"))).where("asked = 1").select("date", "pos")


def coverage(spells: DataFrame, panel: DataFrame, days: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Share of calendar dates inside each spell on which the security has a return."""
    dates = spells.join(days.select("date"), F.col("date").between(F.col(start), F.col(end)))
    seen = panel.where("ret is not null").select("permno", "date", F.lit(1.0).alias("seen"))
    return dates.join(seen, ["permno", "date"], "left").groupBy(*keys).agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("coverage"), F.count("*").alias("n_dates"))


def in_force(days: DataFrame, day: str, spells: DataFrame, start: str, end: str) -> DataFrame:
    """Every pair of a row of ``days`` and a spell that holds on its ``day``, both ends included.

    Spells are cut into months and meet days by month, so no range is joined
    on its own. Null days and ends and reversed spells hold on no day. Columns
    of both sides, which share none.
    """
    span = days.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    low, high = F.greatest(F.col(start), F.lit(span["a"]).cast("date")), F.least(F.col(end), F.lit(span["b"]).cast("date"))
    held = spells.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (low <= high))
    by_month = held.withColumn("__month", F.explode(F.sequence(F.trunc(low, "month"), F.trunc(high, "month"), F.expr("interval 1 month"))))
    met = days.withColumn("__month", F.trunc(day, "month")).join(by_month, "__month")
    return met.where(F.col(day).between(F.col(start), F.col(end))).drop("__month")


def following(keys: DataFrame, key: str, name: str, width: int = 1000) -> DataFrame:
    """Each key (distinct integers) but the last with the next larger one.

    Keys are ordered within buckets of ``width``; only the least key of each
    bucket is ordered over all.
    """
    held = keys.where(F.col(key).isNotNull()).withColumn("__bucket", F.floor(F.col(key) / width))
    least = held.groupBy("__bucket").agg(F.min(key).alias("__least"))
    after = least.select("__bucket", F.lead("__least").over(Window.orderBy("__bucket")).alias("__after"))
    inside = held.withColumn(name, F.lead(key).over(Window.partitionBy("__bucket").orderBy(key)))
    return inside.join(after, "__bucket").withColumn(name, F.coalesce(name, "__after")).where(F.col(name).isNotNull()).drop("__bucket", "__after")
