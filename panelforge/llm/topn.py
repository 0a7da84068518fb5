"""The N best items of each of millions of groups, by merging sorted runs.

Every task sorts what it holds into runs ordered by group, score and ties, of
which only the first N of a group are kept (no more of them can ever be among
the N best). Runs are bucketed by group into as many partitions as the session
shuffles into, and a bucket's runs are merged by a tree of losers; after N
outputs every run seeks to its next group.

Scale: what a task sends is at most N rows per group and run, so a group of
millions of items is split over all tasks and is never in one. A bucket is
merged as it is read, a stretch of rows at a time: of the group that a stretch
ends in, its N best go on as one more run of the next, so no task holds more
than a stretch, however many runs or groups there are. The order is total
(score, then the ties), so results do not depend on how rows are spread.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from panelforge.functions.arrowgroups import integers, numbers, starts

#: Rows of a run before it is cut to N a group, and of a stretch of a bucket that is merged at once.
RUN_ROWS, STRETCH = 500_000, 65_536
END = (float("inf"),)


class LoserTree:
    """The least head of several sorted runs, in one comparison a level."""

    def __init__(self, heads: list[tuple]):
        self.k = max(1, len(heads))
        self.heads = heads or [END]
        self.losers = [-1] * self.k
        self.build()

    def build(self) -> None:
        """Play all matches anew."""
        k, heads = self.k, self.heads
        winner = [0] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            if heads[b] < heads[a]:
                a, b = b, a
            winner[node], self.losers[node] = a, b
        self.losers[0] = winner[1] if k > 1 else 0

    @property
    def best(self) -> int:
        return self.losers[0]

    def replace(self, head: tuple) -> None:
        """Give the winning run its next head, and replay its matches."""
        at = self.losers[0]
        heads, losers = self.heads, self.losers
        heads[at] = head
        node = (self.k + at) // 2
        while node > 0:
            other = losers[node]
            if heads[other] < heads[at]:
                losers[node], at = at, other
            node //= 2
        losers[0] = at


def merge_runs(runs: list[list[tuple]], n: int) -> Iterator[tuple[tuple, int]]:
    """The first ``n`` rows of every group over all runs, with their rank.

    Runs are sorted lists of keys (group, -score, ties...).
    """
    groups = [[r[0] for r in run] for run in runs]
    at = [0] * len(runs)
    tree = LoserTree([run[0] if run else END for run in runs])
    while tree.heads[tree.best] is not END:
        group, rank = tree.heads[tree.best][0], 0
        while rank < n and tree.heads[tree.best] is not END and tree.heads[tree.best][0] == group:
            i = tree.best
            rank += 1
            yield tree.heads[i], rank
            at[i] += 1
            tree.replace(runs[i][at[i]] if at[i] < len(runs[i]) else END)
        if rank == n:  # seek
            for i, run in enumerate(runs):
                if at[i] < len(run) and groups[i][at[i]] == group:
                    at[i] = bisect_right(groups[i], group, at[i])
                    tree.heads[i] = run[at[i]] if at[i] < len(run) else END
            tree.build()


def _make_runs(n: int, ties: list[str]):
    names = ["group", "score", *ties]

    def cut(table: pa.Table, run: int) -> pa.RecordBatch:
        group, score = integers(table, "group"), numbers(table, "score")
        tied = [integers(table, t, -(1 << 62)) for t in ties]
        order = np.lexsort([*tied[::-1], -score, group])
        cuts = starts(group[order])
        rank = np.arange(len(order)) - np.repeat(cuts[:-1], np.diff(cuts))
        keep = order[rank < n]
        columns = [np.full(len(keep), run), group[keep], score[keep], *(t[keep] for t in tied)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["run", *names])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, made, task = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield cut(pa.Table.from_batches(held), task * 100_000 + made)
                held, rows, made = [], 0, made + 1
        if rows:
            yield cut(pa.Table.from_batches(held), task * 100_000 + made)

    return make


def _stretches(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def merged_stretches(stretches: Iterable[tuple[list[tuple], np.ndarray]], n: int) -> Iterator[list[tuple[tuple, int]]]:
    """The first ``n`` rows of every group with their rank, from stretches of keys (group, -score, ties...) with the run of each.

    Groups ascend over all stretches, and within a group and run keys ascend.
    """
    carried: list[tuple] = []  # the best so far of the group that the last stretch ended in
    for rows, number in stretches:
        order = np.argsort(number, kind="stable")
        cuts = starts(number[order])
        runs = [[rows[i] for i in order[a:b].tolist()] for a, b in zip(cuts[:-1], cuts[1:])]
        out = list(merge_runs([carried, *runs], n))
        last = rows[-1][0]
        carried = [key for key, _ in out if key[0] == last]
        yield [x for x in out if x[0][0] != last]
    yield list(zip(carried, range(1, n + 1)))


def _merge(n: int, ties: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys():
            for table in _stretches(batches, STRETCH):
                columns = [integers(table, "group").tolist(), (-numbers(table, "score")).tolist(), *(integers(table, t).tolist() for t in ties)]
                yield list(zip(*columns)), integers(table, "run")

        for out in merged_stretches(keys(), n):
            if out:
                kept = list(zip(*(k for k, _ in out)))
                arrays = [pa.array(kept[0], pa.int64()), pa.array(-np.array(kept[1], dtype=np.float64)), *(pa.array(c, pa.int64()) for c in kept[2:]), pa.array([r for _, r in out], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["group", "score", *ties, "rank"])

    return run


def top_n(items: DataFrame, group: str, score: str, ties: list[str], n: int) -> DataFrame:
    """Per group the ``n`` items of highest score: group, score, ties, rank (1 to n).

    ``group`` and ``ties`` are integers; items of equal score come in ascending
    order of the ties, a null tie first. Items with a null group or a score
    that is null or NaN are left out. Equal rows are items of their own.
    """
    held = items.select(F.col(group).cast("bigint").alias("group"), F.col(score).cast("double").alias("score"), *(F.col(t).cast("bigint").alias(t) for t in ties))
    held = held.where(F.col("group").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    kinds = "group bigint, score double, " + ", ".join(f"{t} bigint" for t in ties)
    runs = held.mapInArrow(_make_runs(n, ties), f"run bigint, {kinds}")
    order = [F.col("group"), F.col("run"), F.col("score").desc(), *(F.col(t) for t in ties)]
    merged = runs.repartition("group").sortWithinPartitions(*order).mapInArrow(_merge(n, ties), f"{kinds}, rank int")
    return merged.select("group", "score", *(F.when(F.col(t) > -(1 << 62), F.col(t)).alias(t) for t in ties), "rank")
