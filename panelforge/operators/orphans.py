"""References to records that do not exist.

Every change is a signed delta on its key: a referring row adds one reference
and its removal takes one, a record adds one to what the key ever held and to
what exists, and a withdrawal takes one from what exists, whenever either
arrives. The counts of a key are sums of deltas, so late, repeated and
out-of-order changes need no replay: the deltas of a load are added to the
counts of the former. Keys with references and without existence form the
current orphan report.

Scale: counts are summed before the shuffle, so a hot key is one partial row a
task. Only the keys in question go back to the referring rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.lookup import lookup_join

#: What a key's counts hold; all are sums or minima, so they merge in any order.
STATE = ["refs", "ever", "live", "first_valid", "first_known", "first_ref", "first_arrival"]


def _delta(rows: DataFrame, **parts: str | int) -> DataFrame:
    """A delta per row: counts where given as numbers, days where given as columns, else nothing."""
    counts = [F.lit(parts.get(c, 0)).cast("bigint").alias(c) for c in STATE[:3]]
    firsts = [(F.col(parts[c]) if c in parts else F.lit(None)).cast("date").alias(c) for c in STATE[3:]]
    return rows.where("key is not null").select("key", *counts, *firsts)


def made(records: DataFrame) -> DataFrame:
    """Deltas of new records: key, valid (start of validity), known."""
    return _delta(records, ever=1, live=1, first_valid="valid", first_known="known")


def withdrawn(records: DataFrame) -> DataFrame:
    """Deltas of withdrawals: key. A withdrawal may come before its record."""
    return _delta(records, live=-1)


def referred(references: DataFrame) -> DataFrame:
    """Deltas of referring rows: key, day, arrival."""
    return _delta(references, refs=1, first_ref="day", first_arrival="arrival")


def removed(references: DataFrame) -> DataFrame:
    """Deltas of removed referring rows: key. First days, which can't be taken back, only tell which keys are looked at."""
    return _delta(references, refs=-1)


def deltas(records: DataFrame, references: DataFrame) -> DataFrame:
    """The deltas of a load of ``records`` (key, valid, known, gone: withdrawn since, or null) and ``references`` (key, day, arrival)."""
    return made(records).unionByName(withdrawn(records.where("gone is not null"))).unionByName(referred(references))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """New counts from former counts and deltas, all with key and the columns of STATE."""
    whole = parts[0].select("key", *STATE)
    for part in parts[1:]:
        whole = whole.unionByName(part.select("key", *STATE))
    return whole.groupBy("key").agg(*(F.sum(c).alias(c) for c in STATE[:3]), *(F.min(c).alias(c) for c in STATE[3:]))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """The current orphan report: keys with references and no existing record."""
    return counts.where("refs > 0 and live <= 0").select("key", "refs", F.when(F.col("ever") > 0, "withdrawn").otherwise("missing").alias("reason"))


def orphan_rows(records: DataFrame, references: DataFrame, *carry: str) -> DataFrame:
    """The referring rows without a valid record, each with its first reason.

    ``references`` has key, day, arrival and the columns ``carry``; every row is
    judged, repeated ones too. Reasons in order: 'missing' (no record of the
    key), 'withdrawn' (all its records gone), 'early' (day before the earliest
    valid start), 'late' (earliest knowledge after the arrival). A null start,
    day or arrival is compared with nothing. Rows with a null key refer to
    nothing and are no orphans. Result: ``carry``, key, day, reason.
    """
    counts = merge_counts(deltas(records, references))
    doubtful = counts.where("refs > 0 and (live <= 0 or first_ref < first_valid or first_arrival < first_known)")
    reason = (
        F.when(F.col("ever") <= 0, "missing")
        .when(F.col("live") <= 0, "withdrawn")
        .when(F.col("day") < F.col("first_valid"), "early")
        .when(F.col("first_known") > F.col("arrival"), "late")
    )
    rows = references.where("key is not null").select("key", "day", "arrival", *carry)
    joined = lookup_join(rows, doubtful.select("key", "ever", "live", "first_valid", "first_known"), ["key"])
    return joined.withColumn("reason", reason).where("reason is not null").select(*carry, "key", "day", "reason")
