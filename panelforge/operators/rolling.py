"""Rolling totals over trailing periods by two-stack queues.

A two-stack queue holds the active window as a back stack, whose running
aggregate covers the newer items, and a front stack, whose aggregates cover
the older ones; evicting pops the front, and an empty front is refilled by
flipping the back. No aggregate is ever subtracted, so any monoid will do:
maxima and minima as well as sums. Over a dense axis of days a window of w days
flips every w days, so the aggregates of both stacks are the running ones from
either end of each stretch of w days, and are taken for all days at once.

Scale: deliveries are reduced to valid rows and these to one partial aggregate
per entity and day before they reach a queue. Entities are cut into stretches
of ``shard_days``, each of which also gets the partial aggregates of the days
just before it, so that one entity with a third of all rows is many tasks, and
none gets more rows than ``shard_days`` plus the widest window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.arrowgroups import complete_groups, integers, numbers, starts

#: The monoids of a partial aggregate: operation and identity.
MONOIDS = {"sum": (np.add, 0.0), "n": (np.add, 0.0), "max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}


def two_stack(operation: np.ufunc, identity: float, items: np.ndarray, width: int) -> np.ndarray:
    """The aggregate of the last ``width`` items at each item, fewer at the start."""
    n = len(items)
    blocks = np.full(-(-n // width) * width, identity)
    blocks[:n] = items
    blocks = blocks.reshape(-1, width)
    back = operation.accumulate(blocks, axis=1).ravel()[:n]
    front = operation.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.arange(n)
    oldest = at - width + 1
    held = (oldest > 0) & (oldest % width != 0)  # else the front stack is empty
    out = back.copy()
    out[held] = operation(front[oldest[held]], back[held])
    return out


def queue_kernel(windows: tuple[int, ...], schema: pa.Schema):
    """A function over sorted partitions: (entity, shard) groups of a frame row and day rows."""
    widest = max(windows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, ["entity", "shard"]):
            entity, shard, kind = (integers(table, c) for c in ("entity", "shard", "kind"))
            day, upto = integers(table, "day"), integers(table, "upto")
            part = {m: numbers(table, m) for m in MONOIDS}
            cuts, made = starts(entity, shard), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if kind[a]:
                    continue  # only days before any stretch of this shard
                first, last = day[a], upto[a]
                base = first - widest + 1
                rows = slice(a + 1, b)
                at = day[rows] - base
                columns = [np.full(last - first + 1, entity[a]), np.arange(first, last + 1)]
                for width in windows:
                    for name, (operation, identity) in MONOIDS.items():
                        items = np.full(last - base + 1, identity)
                        items[at] = part[name][rows]
                        columns.append(two_stack(operation, identity, items, width)[widest - 1 :])
                made.append(columns)
            if made:
                joined = [np.concatenate(c) for c in zip(*made)]
                arrays = [pa.array(joined[0]), pa.array(joined[1].astype(np.int32)).cast(pa.date32())]
                for i in range(len(windows)):
                    s, n, most, least = joined[2 + 4 * i : 6 + 4 * i]
                    s = np.round(s, 9)
                    some = n > 0
                    mean = np.divide(s, n, out=np.zeros_like(s), where=some)
                    arrays += [pa.array(s), pa.array(n.astype(np.int64)), pa.array(mean, mask=~some), pa.array(most, mask=~some), pa.array(least, mask=~some)]
                yield from pa.Table.from_arrays(arrays, schema=schema).to_batches(max_chunksize=16384)

    return run


def rolling_totals(daily: DataFrame, bounds: DataFrame, windows: tuple[int, ...] = (7, 30), shard_days: int = 512) -> DataFrame:
    """Totals over trailing calendar days, for every day from an entity's first to its last.

    ``daily``: entity bigint, day date, and partial aggregates sum, n, max, min
    of the day. ``bounds``: entity, first date, last date. Both may be empty.

    Result: entity, day, and per window sum_w, n_w, avg_w, max_w, min_w. A
    window without a value has sum 0, n 0 and null avg, max and min. sum_w is
    rounded to nine decimals, and avg_w is that sum by n_w. Rows with a null
    entity or day belong to no entity and are left out.
    """
    widest = max(windows)
    number = lambda c: F.unix_date(F.col(c))
    frames = (
        bounds.where("entity is not null and first is not null")
        .select("entity", number("first").alias("a"), number("last").alias("b"))
        .withColumn("shard", F.explode(F.sequence(F.floor(F.col("a") / shard_days).cast("int"), F.floor(F.col("b") / shard_days).cast("int"))))
        .select(
            "entity", "shard", F.lit(0).alias("kind"), F.greatest("a", F.col("shard") * shard_days).alias("day"),
            F.least("b", (F.col("shard") + 1) * shard_days - 1).alias("upto"), *(F.lit(0.0).alias(m) for m in MONOIDS),
        )
    )
    days = daily.where("entity is not null and day is not null").withColumn("day", number("day"))
    own, later = F.floor(F.col("day") / shard_days).cast("int"), F.floor((F.col("day") + widest - 1) / shard_days).cast("int")
    parts = days.withColumn("shard", F.explode(F.sequence(own, later))).select(
        "entity", "shard", F.lit(1).alias("kind"), "day", F.lit(None).cast("int").alias("upto"), *(F.col(m).cast("double").alias(m) for m in MONOIDS)
    )
    fields = [pa.field("entity", pa.int64()), pa.field("day", pa.date32())]
    kinds = "entity bigint, day date"
    for w in windows:
        fields += [pa.field(f"sum_{w}", pa.float64()), pa.field(f"n_{w}", pa.int64()), *(pa.field(f"{x}_{w}", pa.float64()) for x in ("avg", "max", "min"))]
        kinds += f", sum_{w} double, n_{w} bigint, avg_{w} double, max_{w} double, min_{w} double"
    return (
        frames.unionByName(parts)
        .repartition("entity", "shard")
        .sortWithinPartitions("entity", "shard", "kind", "day")
        .mapInArrow(queue_kernel(windows, pa.schema(fields)), kinds)
    )
