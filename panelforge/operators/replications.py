"""Monte-Carlo experiments: one row per replication, one seed per row.

A replication depends on its own seed alone, so results do not change with the
number of partitions. Panels that replications share are broadcast after a
check of their size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import environments, walk

#: Bytes up to which a panel is broadcast to replications.
PANEL_BYTES = 512 << 20
#: Partitions of replications for each core.
PER_CORE = 6


def dense(panel: DataFrame) -> np.ndarray:
    """Positions by securities as an array, after a check of its size; missing cells are NaN."""
    size = panel.agg(F.countDistinct("permno").alias("n"), F.max("pos").alias("t")).first()
    if (size["n"] or 0) * ((size["t"] or 0) + 1) * 8 > PANEL_BYTES:
        raise ValueError(f"a panel of {size['n']} securities by {size['t']} positions is too large to hand to every replication")
    rows = panel.where("ret is not null").select("pos", "permno", "ret").toPandas()
    return rows.pivot(index="pos", columns="permno", values="ret").reindex(range((size["t"] or 0) + 1)).to_numpy(dtype=float)


def grid(spark: SparkSession, names: list[str], reps: int, base: int) -> DataFrame:
    """environment, rep, seed."""
    g = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.array(*(F.struct(F.lit(n).alias("environment"), F.lit(i).alias("e")) for i, n in enumerate(names)))).alias("x"))
    return g.select("x.environment", "rep", (F.lit(base) + 1000 * F.col("x.e") + F.col("rep")).cast("bigint").alias("seed"))


def over_cores(work: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``work`` of about ``rows`` rows in several partitions a core, at most one a row."""
    cores = work.sparkSession.sparkContext.defaultParallelism
    return work.repartition(max(1, min(rows, PER_CORE * cores)), *keys)


def draws(spark: SparkSession, real: np.ndarray, names: list[str], reps: int, base: int) -> DataFrame:
    """environment, rep, deviation, largest_mean, missing, missing_real of every draw of the null environments."""
    shared = spark.sparkContext.broadcast(real)

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                x, signal = environments.draw(row.environment, shared.value, int(row.seed))
                out.append((row.environment, int(row.rep), float(np.nanstd(signal)), float(abs(np.nanmean(x, axis=0)).max()), int(np.isnan(x).sum()), int(np.isnan(shared.value).sum())))
            yield pd.DataFrame(out, columns=["environment", "rep", "deviation", "largest_mean", "missing", "missing_real"])

    work = over_cores(grid(spark, names, reps, base), reps * len(names), "environment", "rep")
    return work.mapInPandas(one, "environment string, rep bigint, deviation double, largest_mean double, missing bigint, missing_real bigint")


def null_matrix(spark: SparkSession, real: np.ndarray, names: list[str], reps: int, rule: walk.Rule, strategies: tuple[str, ...], base: int = 20260101) -> DataFrame:
    """environment, rep, strategy, sharpe, turnover, refits, fired, eligible of every replication."""
    shared = spark.sparkContext.broadcast(real)

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                x, signal = environments.draw(row.environment, shared.value, int(row.seed))
                for name, told in walk.run(x, signal, rule, strategies).items():
                    out.append({"environment": row.environment, "rep": int(row.rep), "strategy": name, **told})
            yield pd.DataFrame(out, columns=["environment", "rep", "strategy", "sharpe", "turnover", "refits", "fired", "eligible"])

    return grid(spark, names, reps, base).transform(lambda g: over_cores(g, reps * len(names), "environment", "rep")).mapInPandas(one, "environment string, rep bigint, strategy string, sharpe double, turnover double, refits double, fired double, eligible double")


def placebo_threshold(spark: SparkSession, size: int, counts: list[int], draws: int, percentile: float = 0.95, chunk: int = 2000, seed: int = 11) -> DataFrame:
    """events, threshold: the percentile of the largest overlap of random position sets with any schedule.

    Draws come in chunks of stated size with a seed each.
    """
    masks = np.array([(np.arange(size) % q == r) for q in range(2, 13) for r in range(q)])
    sizes = masks.sum(axis=1)

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                rng = np.random.default_rng([seed, int(row.events), int(row.chunk)])
                picks = np.argsort(rng.random((int(row.n), size)), axis=1)[:, : int(row.events)]
                hit = np.zeros((int(row.n), size), dtype=np.float32)
                np.put_along_axis(hit, picks, 1, axis=1)
                both = hit @ masks.T.astype(np.float32)
                yield pd.DataFrame({"events": int(row.events), "best": (both / (row.events + sizes - both)).max(axis=1).astype(float)})

    todo = [(n, c, min(chunk, draws - c * chunk)) for n in counts for c in range(-(-draws // chunk))]
    work = spark.createDataFrame(todo or [(0, 0, 0)], "events int, chunk int, n int").where("n > 0").transform(lambda g: over_cores(g, len(todo), "events", "chunk"))
    return work.mapInPandas(one, "events int, best double").groupBy("events").agg(F.percentile("best", F.lit(percentile)).alias("threshold"))


def modal_share(spark: SparkSession, size: int, counts: list[int], draws: int = 10_000, seed: int = 13) -> DataFrame:
    """events, m, low, high: median and 2.5 and 97.5 percent points of the modal gap share of random sets."""

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                rng = np.random.default_rng([seed, int(row.events)])
                picks = np.sort(np.argsort(rng.random((draws, size)), axis=1)[:, : int(row.events)], axis=1)
                g = np.diff(picks, axis=1)
                share = np.array([np.bincount(x).max() for x in g]) / g.shape[1]
                yield pd.DataFrame([{"events": int(row.events), "m": float(np.median(share)), "low": float(np.quantile(share, 0.025)), "high": float(np.quantile(share, 0.975))}])

    todo = [(n,) for n in counts if n >= 2]
    return spark.createDataFrame(todo or [(0,)], "events int").where("events > 0").transform(lambda g: over_cores(g, len(todo), "events")).mapInPandas(one, "events int, m double, low double, high double")


def _blocks(n: int, length: int, rng: np.random.Generator, times: int) -> np.ndarray:
    starts = rng.integers(0, n, (times, -(-n // length), 1))
    return ((starts + np.arange(length)) % n).reshape(times, -1)[:, :n]


def _shift(x: np.ndarray, fired: np.ndarray) -> np.ndarray:
    """Median of fired less that of the others, by row; NaN where either is empty."""
    with np.errstate(all="ignore"):
        return np.nanmedian(np.where(fired, x, np.nan), axis=1) - np.nanmedian(np.where(fired, np.nan, x), axis=1)


def bootstrap_p(x: np.ndarray, fired: np.ndarray, length: int, times: int, rng: np.random.Generator) -> float:
    """The circular block bootstrap p-value of a median shift, in one array of replicates."""
    import warnings

    d = _shift(x[None], fired[None])[0]
    if not np.isfinite(d):
        return float("nan")
    at = _blocks(len(x), length, rng, times)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        drawn = _shift(x[at], fired[at])
    kept = drawn[np.isfinite(drawn)]
    return float((1 + (kept - d >= d).sum()) / (len(kept) + 1)) if len(kept) else float("nan")


#: Where a shift is planted: at the positions of the target's mask, or at as many drawn anew for each replication.
CONDITIONS = ("fired", "uniform")


def power_curve(spark: SparkSession, x: np.ndarray, masks: dict[float, np.ndarray], deltas: list[float], reps: int, times: int, length: int, base: int = 31, alpha: float = 0.05, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """target, delta, condition, power, reps, se: how often a planted shift is found after Holm over all masks.

    Each replication resamples the path in blocks, plants ``delta`` where the
    target's mask fires or, in the condition 'uniform', at as many positions
    drawn anew, tests all masks and adjusts their p-values.
    """
    shared = spark.sparkContext.broadcast((x, masks))
    cells = [(t, d, c) for t in masks for d in deltas for c in conditions]

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sets = shared.value
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                rng = np.random.default_rng([base, int(row.target * 100), int(row.delta * 100), conditions.index(row.condition), int(row.rep)])
                plant = sets[row.target]
                if row.condition == "uniform":
                    plant = rng.permutation(plant)
                y = path[_blocks(len(path), length, rng, 1)[0]] + row.delta * plant
                p = np.array([bootstrap_p(y, m, length, times, rng) for m in sets.values()])
                order = np.argsort(p)
                adjusted = np.maximum.accumulate(np.minimum(1, p[order] * np.arange(len(p), 0, -1)))
                mine = list(sets).index(row.target)
                out.append({"target": row.target, "delta": row.delta, "condition": row.condition, "hit": float(adjusted[list(order).index(mine)] < alpha)})
            if out:
                yield pd.DataFrame(out)

    each = spark.createDataFrame(cells, "target double, delta double, condition string").crossJoin(spark.range(reps).withColumnRenamed("id", "rep"))  # a row a replication
    work = over_cores(each, reps * len(cells), "target", "delta", "condition", "rep")
    found = work.mapInPandas(one, "target double, delta double, condition string, hit double").groupBy("target", "delta", "condition").agg(F.avg("hit").alias("power"), F.count("*").alias("reps"))
    return found.withColumn("se", F.sqrt(F.col("power") * (1 - F.col("power")) / F.col("reps")))


def size_calibration(spark: SparkSession, size: int, rate: float, datasets: int, times: list[int], base: int = 47) -> DataFrame:
    """times, size: how often the bootstrap rejects at five percent when nothing is there."""

    def one(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                rng = np.random.default_rng([base, int(row.dataset)])
                x, fired = rng.standard_normal(size), rng.random(size) < rate
                out.append({"times": int(row.times), "hit": float(bootstrap_p(x, fired, 3, int(row.times), rng) <= 0.05)})
            yield pd.DataFrame(out)

    work = spark.range(datasets).select(F.col("id").alias("dataset"), F.explode(F.array(*map(F.lit, times))).alias("times")).transform(lambda g: over_cores(g, datasets * len(times), "dataset", "times"))
    return work.mapInPandas(one, "times int, hit double").groupBy("times").agg(F.avg("hit").alias("size"), F.count("*").alias("datasets"))
