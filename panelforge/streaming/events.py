"""Streams of events: windows, sessions, late data, a stateful trigger, and a join to spells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelforge import session

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream."""
    path = f"{folder}/events.parquet"
    static = spark.read.parquet(path)
    files = static.inputFiles()
    reader = spark.readStream.schema(static.schema)
    if any("events.parquet/" in f for f in files):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """A folder of our own among those that all executors see."""
    return f"{session.shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its result as a table."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        (batch.write.mode("overwrite").parquet(f"{folder}/out") if mode == "complete" else batch.write.mode("append").parquet(f"{folder}/out"))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _timed(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp of the session's zone, as watermarks ask for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their values by window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: start, end and events."""
    w = F.session_window("ts", gap)
    return _timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def closed_days(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily counts, each given once when no late event can change it; later ones are dropped."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


STATE = "levels array<double>, changes array<double>, last double"
TRIGGERED = "run int, pos bigint, level double, d double, sigma double, fired boolean"


def online_trigger(series: DataFrame, gamma: float = 1.0, smooth: int = 5, trail: int = 12, least: int = 6) -> DataFrame:
    """The trailing trigger as a stateful operator: 5 values and 12 changes a run are all it keeps.

    ``series``: run, pos, x, streamed; within a batch positions are put in
    order. Equal to operators.trigger on the whole series.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        levels, changes, last = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, x in zip(rows["pos"], rows["x"]):
            levels = [*levels, float(x)][-smooth:]
            level = float(np.mean(levels))
            d = None if last is None else level - last
            sigma = float(np.std(changes, ddof=1)) if len(changes) >= least else None
            out.append((key[0], int(pos), level, d, sigma, bool(d is not None and sigma is not None and abs(d) > gamma * sigma)))
            changes = ([*changes, d] if d is not None else changes)[-trail:]
            last = level
        state.update((levels, changes, last))
        yield pd.DataFrame(out, columns=["run", "pos", "level", "d", "sigma", "fired"])

    return series.groupBy("run").applyInPandasWithState(step, TRIGGERED, STATE, "append", GroupStateTimeout.NoTimeout)


def with_spells(events: DataFrame, spells: DataFrame, key: str, spell_key: str, start: str, end: str) -> DataFrame:
    """Streamed events with the static spell that holds on their day."""
    s = spells.select(F.col(spell_key).alias("__k"), F.col(start).alias("__a"), F.col(end).alias("__b"), "spell_id")
    on = (F.col(key) == F.col("__k")) & F.to_date("ts").between(F.col("__a"), F.col("__b"))
    return events.join(s, on, "left").drop("__k", "__a", "__b")
