"""Attributes as known at event time, by disjoint bitemporal rectangles.

A record covers a rectangle: its valid days by the days on which it was known.
Where rectangles of an entity overlap, the record known latest counts. Valid
time is cut into grid cells, and within a cell the plane is split into disjoint
rectangles, each with the one record that counts there. An event then lies in
one rectangle at most, and is located among those of its own cell.

Scale: only what a probe can hit is indexed, on the diagonal (known on the
event's day) or on the upper edge (known today). A record is cut to its days
there, and of equal pieces of a cell only the last known moves, so a cell of n
days has n (n + 1) pieces at most before the split and 2 n rectangles after it,
even for an entity with a third of all records. Events move once, by (entity,
cell): no entity is a single task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.arrowgroups import complete_groups, integers, starts

#: "Today", in days: after every day of the data.
TODAY = 1 << 29
#: Below every day.
NEVER = -(1 << 29)


def disjoint(records: list[tuple[int, int, int, int, int, int]], probed_only: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Split rectangles (v0, v1, k0, k1, known, id) into disjoint (v0, v1, k0, k1, id).

    Valid time v0..v1 includes both ends, knowledge k0..k1 excludes k1. Of
    several records the highest (known, id) counts. With ``probed_only`` those
    that neither the diagonal nor TODAY can hit are left out.
    """
    cuts = sorted({r[0] for r in records} | {r[1] + 1 for r in records})
    opening: dict[int, list] = {}
    for r in records:
        opening.setdefault(r[0], []).append(r)
    active: list = []
    out: list[tuple[int, int, int, int, int]] = []
    ending: dict[tuple[int, int, int], int] = {}  # (k0, k1, id) to its last rectangle in out
    for low, after in zip(cuts, cuts[1:]):
        active = [r for r in active if r[1] >= low]
        if low in opening:
            active = sorted(active + opening[low], key=lambda r: (-r[4], -r[5]))
        taken: list[tuple[int, int]] = []  # disjoint, sorted
        for r in active:
            at, free = r[2], []
            for a, b in taken:
                if b <= at:
                    continue
                if a >= r[3]:
                    break
                if a > at:
                    free.append((at, a))
                at = max(at, b)
            if at < r[3]:
                free.append((at, r[3]))
            for k0, k1 in free:
                if probed_only and k1 <= TODAY and (k1 <= low or k0 >= after):
                    continue
                before = ending.get((k0, k1, r[5]))
                if before is not None and out[before][1] == low - 1:
                    out[before] = (out[before][0], after - 1, k0, k1, r[5])
                else:
                    ending[k0, k1, r[5]] = len(out)
                    out.append((low, after - 1, k0, k1, r[5]))
            if free:
                spans, taken = sorted([*taken, *free]), []
                for a, b in spans:
                    if taken and a <= taken[-1][1]:
                        taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
                    else:
                        taken.append((a, b))
            if taken and taken[0][0] <= NEVER and taken[0][1] > TODAY:
                break
    return out


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in complete_groups(batches, ["entity", "cell"], 16384):
        names = ("entity", "cell", "v0", "v1", "k0", "k1", "known", "id")
        entity, cell, *rest = (integers(table, c) for c in names)
        cuts = starts(entity, cell)
        single = cuts[1:] - cuts[:-1]
        rows: list[tuple[list[int], ...]] = []
        lists = [x.tolist() for x in rest]
        for a, b, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), single.tolist()):
            e, c = int(entity[a]), int(cell[a])
            group = [tuple(x[i] for x in lists) for i in range(a, b)]
            if n == 1:
                v0, v1, k0, k1, _, name = group[0]
                if k1 > TODAY or (k0 <= v1 and v0 < k1):
                    rows.append((e, c, v0, v1, k0, k1, name))
            else:
                rows += [(e, c, *r) for r in disjoint(group)]
        if rows:
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["entity", "cell", "v0", "v1", "k0", "k1", "id"])


def rectangle_index(records: DataFrame, entity: str, start: Column, end: Column, known: Column, gone: Column, key: str, values: list[str], span: tuple[int, int], cell_days: int = 128) -> DataFrame:
    """One row per (entity, cell): ``rects``, an array of the disjoint rectangles with ``values``.

    Null start: never valid; null end: open; null ``known``: not known on any
    day, yet today; null ``gone``: not withdrawn. Valid time is clipped to
    ``span``, the first and last day of the events.
    """
    low, high = span
    flat = records.select(
        F.col(entity).alias("entity"), F.greatest(F.unix_date(start), F.lit(low)).alias("v0"), F.least(F.coalesce(F.unix_date(end), F.lit(high)), F.lit(high)).alias("v1"),
        F.coalesce(F.unix_date(known), F.lit(TODAY)).alias("k0"), F.coalesce(F.unix_date(gone), F.lit(TODAY + 1)).alias("k1"),
        F.coalesce(F.unix_date(known), F.lit(NEVER)).alias("known"), F.col(key).alias("id"), F.unix_date(start).isNotNull().alias("begun"), F.struct(*values).alias("values") if values else F.lit(None).cast("struct<none:int>").alias("values"),
    ).where("entity is not null and begun and v0 <= v1 and k0 < k1 and id is not null")
    cells = flat.withColumn("cell", F.explode(F.sequence(F.floor(F.col("v0") / cell_days).cast("int"), F.floor(F.col("v1") / cell_days).cast("int"))))
    edge = F.col("cell") * cell_days
    low_, high_ = F.greatest("v0", edge), F.least("v1", edge + cell_days - 1)
    # what a probe can hit of a record: on the diagonal the days on which it is both valid and known, today all its days
    begin, end = F.greatest(low_, F.col("k0")), F.least(high_, F.col("k1") - 1)
    hit = lambda a, b, k0, k1: F.struct(a.cast("int").alias("v0"), b.cast("int").alias("v1"), k0.cast("int").alias("k0"), k1.cast("int").alias("k1"))
    probed = F.array_compact(F.array(F.when(begin <= end, hit(begin, end, begin, end + 1)), F.when(F.col("k1") > TODAY, hit(low_, high_, F.lit(TODAY), F.lit(TODAY + 1)))))
    clipped = (
        cells.select("entity", "cell", "known", "id", F.explode(probed).alias("r"))
        .groupBy("entity", "cell", F.col("r.v0").alias("v0"), F.col("r.v1").alias("v1"), F.col("r.k0").alias("k0"), F.col("r.k1").alias("k1"))
        .agg(F.max(F.struct("known", "id")).alias("top"))
        .select("entity", "cell", "v0", "v1", "k0", "k1", "top.known", "top.id")
        .repartition("entity", "cell")
        .sortWithinPartitions("entity", "cell")
    )
    rects = clipped.mapInArrow(_split, "entity bigint, cell int, v0 int, v1 int, k0 int, k1 int, id bigint")
    if values:
        told = flat.groupBy("id").agg(F.first("values").alias("values"))
        rects = rects.join(told, "id").select("entity", "cell", "v0", "v1", "k0", "k1", "id", "values.*")
    return rects.groupBy("entity", "cell").agg(F.collect_list(F.struct("v0", "v1", "k0", "k1", "id", *values)).alias("rects"))


def located(rects: str, day: str, known: str) -> Column:
    """The rectangle of column ``rects`` that holds the point (``day``, ``known``), else null."""
    return F.expr(f"get(filter({rects}, r -> r.v0 <= {day} and r.v1 >= {day} and r.k0 <= {known} and r.k1 > {known}), 0)")


def as_known(events: DataFrame, entity: str, day: str, indexes: dict[str, DataFrame], cell_days: int = 128) -> DataFrame:
    """Every event with, per index, the record as known on its day (name_then) and today (name_now).

    Both are structs with id and the index's values, null where no record is
    in force. Events with a null entity or day keep null on both.
    """
    out = events.withColumn("__day", F.unix_date(day)).withColumn("__cell", F.floor(F.col("__day") / cell_days).cast("int")).withColumn("__entity", F.col(entity))
    for name, index in indexes.items():
        named = index.select(F.col("entity").alias("__entity"), F.col("cell").alias("__cell"), F.col("rects").alias(f"__{name}"))
        out = out.join(named, ["__entity", "__cell"], "left")
    for name in indexes:
        out = out.withColumn(f"{name}_then", located(f"__{name}", "__day", "__day")).withColumn(f"{name}_now", located(f"__{name}", "__day", str(TODAY)))
    return out.drop("__day", "__cell", "__entity", *(f"__{n}" for n in indexes))
