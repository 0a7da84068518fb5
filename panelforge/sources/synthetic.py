"""A generator of raw security tables: regimes, sectors, churn and delistings.

Cells are made where they are, from hashes of their keys: no state but the
regime path (a row a date) comes from the driver, and any number of partitions
gives the same tables.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.environments import regime_path

#: Chances to stay in the calm and in the wild regime, market and own deviations in each.
STAY, MARKET, OWN = (0.997, 0.985), (0.008, 0.022), (0.016, 0.018)
#: Shares of exits that are crashes, of crashes without a return, and of mergers.
CRASHES, UNKNOWN, MERGERS = 0.20, 0.13, 0.12


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash of keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*keys: Column) -> Column:
    """A standard normal number from a hash of keys."""
    return F.sqrt(-2 * F.log(uniform(F.lit("r"), *keys))) * F.cos(2 * np.pi * uniform(F.lit("a"), *keys))


def tables(spark: SparkSession, start: str, end: str, pool: int = 900, index: int = 500, sectors: int = 11, seed: int = 7) -> dict[str, DataFrame]:
    """dsf, names, membership, delist and rf between two dates."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    dates = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    dates = [d for d in dates if d.weekday() < 5]
    days = len(dates)
    rng = np.random.default_rng(seed)
    state = regime_path(days, STAY, rng)
    shock = rng.standard_normal(days) * np.take(MARKET, state)
    calendar = spark.createDataFrame([(i, d, int(s), float(m)) for i, (d, s, m) in enumerate(zip(dates, state, shock))], "t int, date date, regime int, market double")
    s, key = F.lit(seed), F.col("permno")
    ids = spark.range(pool).select((F.col("id") + 10_001).alias("permno"))
    traits = (
        ids.withColumn("beta", 0.5 + uniform(s, F.lit("beta"), key))
        .withColumn("sector", F.floor(uniform(s, F.lit("sector"), key) * sectors).cast("int"))
        .withColumn("born", F.when(uniform(s, F.lit("old"), key) < 0.6, 0).otherwise(F.floor(uniform(s, F.lit("born"), key) * days * 0.8)).cast("int"))
        .withColumn("gone", F.when(uniform(s, F.lit("stays"), key) < 0.5, F.lit(None)).otherwise(F.floor(F.col("born") + 60 + uniform(s, F.lit("gone"), key) * days)).cast("int"))
        .withColumn("gone", F.when(F.col("gone") < days, F.col("gone")))
        .withColumn("end", F.coalesce("gone", F.lit(days - 1)))
        .where(F.col("born") < F.col("end"))
    )
    cells = traits.withColumn("t", F.explode(F.sequence("born", "end"))).join(F.broadcast(calendar), "t")  # a row a date
    own = F.when(F.col("regime") == 0, OWN[0]).otherwise(OWN[1])
    move = F.col("beta") * F.col("market") + 0.006 * normal(s, F.lit("sec"), F.col("sector"), F.col("t")) + own * normal(s, F.lit("own"), key, F.col("t"))
    from pyspark.sql import Window

    path = Window.partitionBy("permno").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ret = F.greatest(F.lit(-0.9), move)
    size = F.exp(9 + 2 * normal(s, F.lit("size"), key))
    dsf = cells.withColumn("ret", F.round(ret, 6)).withColumn("prc", F.round(30 * F.exp(F.sum(F.log1p("ret")).over(path)), 2))
    dsf = dsf.withColumn("prc", F.when(uniform(s, F.lit("quote"), key, F.col("t")) < 0.01, -F.col("prc")).otherwise(F.col("prc")))
    dsf = dsf.select("permno", "date", "ret", "prc", F.round(size).alias("shrout"), F.lit(1.0).alias("cfacpr"), F.lit(1.0).alias("cfacshr"))
    on = lambda t, name: traits.join(F.broadcast(calendar.select(F.col("t").alias(t), F.col("date").alias(name))), t)
    names = on("born", "namedt").join(F.broadcast(calendar.select(F.col("t").alias("end"), F.col("date").alias("nameendt"))), "end")
    names = names.select("permno", "namedt", F.when(F.col("gone").isNotNull(), F.col("nameendt")).alias("nameendt"), F.lit(11).alias("shrcd"), (1 + F.pmod("permno", F.lit(3))).cast("int").alias("exchcd"), F.concat(F.lit("T"), key.cast("string")).alias("ticker"))
    member = names.where(uniform(s, F.lit("index"), key) < index / max(pool, 1)).select("permno", F.col("namedt").alias("mbrstartdt"), F.coalesce("nameendt", F.lit(last)).alias("mbrenddt"))
    kind = uniform(s, F.lit("exit"), key)
    crash, merged = kind < CRASHES, kind.between(CRASHES, CRASHES + MERGERS)
    lost = F.when(uniform(s, F.lit("lost"), key) >= UNKNOWN, F.round(-0.5 - 0.5 * uniform(s, F.lit("loss"), key), 6))
    delist = on("gone", "dlstdt").select("permno", "dlstdt", F.when(crash, lost).when(merged, F.round(0.2 * uniform(s, F.lit("gain"), key), 6)).otherwise(F.lit(0.0)).alias("dlret"), F.when(crash, 574).when(merged, 231).otherwise(500).alias("dlstcd"))
    rf = calendar.select("date", F.lit(round(0.02 / 252, 8)).alias("rf"))
    return {"dsf": dsf, "names": names, "membership": member, "delist": delist, "rf": rf}


def write_tables(made: dict[str, DataFrame], folder: str) -> None:
    """The tables as parquet, with an empty marker file that tells them from real ones."""
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = made["rf"].sparkSession
    spark.createDataFrame([("synthetic",)], "kind string").write.mode("overwrite").json(f"{folder}/_synthetic")


def is_synthetic(spark: SparkSession, folder: str) -> bool:
    """Whether the marker is there."""
    try:
        return spark.read.schema("kind string").json(f"{folder}/_synthetic").limit(1).count() == 1
    except Exception:  # noqa: BLE001
        return False
