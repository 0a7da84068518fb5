"""One estimation per rebalance, shared by all strategies.

Each rebalance is a group of its own (window times assets, a size set by the
rule), so estimation spreads over the cluster by date; what strategies need is
kept as arrays on one row per rebalance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import linalg

PASS = "pos bigint, n int, k int, variance double, ar double, cov_values array<double>, values array<double>, permnos array<bigint>, leaf array<int>, labels array<int>, cov array<double>, features array<double>"


def series(panel: DataFrame) -> DataFrame:
    """permno, first, x: each security's returns as one array over positions from its first, gaps as nulls."""
    spans = panel.where("ret is not null").groupBy("permno").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    days = spans.withColumn("pos", F.explode(F.sequence("first", "last"))).join(panel.select("permno", "pos", "ret"), ["permno", "pos"], "left")
    sorted_days = F.sort_array(F.collect_list(F.struct("pos", "ret")))
    return days.groupBy("permno", "first").agg(F.transform(sorted_days, lambda d: d["ret"]).alias("x"))


def windows(panel: DataFrame, held: DataFrame, window: int) -> DataFrame:
    """pos, permno, x: an array of the ``window`` returns up to each rebalance of what it holds, gaps as nulls.

    A security's returns move to a rebalance as one slice, not as rows.
    """
    all_series = series(panel)
    low = F.col("pos") - window + 1 - F.col("first")  # where the window begins in the array, from 0
    head = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.least(F.lit(window), -low)).cast("int"))
    body = F.slice("x", F.greatest(F.lit(1), low + 1).cast("int"), F.greatest(F.lit(0), F.lit(window) + F.least(F.lit(0), low)).cast("int"))
    return held.select("pos", "permno").join(all_series, "permno").select("pos", "permno", F.concat(head, body).alias("x"))


def matrix(pdf: pd.DataFrame, window: int, least: int = 10, missing: float = 0.05) -> tuple[list[int], np.ndarray] | None:
    """Assets and returns of one window, ascending; those lacking too much are out, missing cells are 0."""
    pdf = pdf.sort_values("permno")
    x = np.full((window, len(pdf)), np.nan)
    for j, own in enumerate(pdf["x"]):
        x[: len(own), j] = np.asarray(own, dtype=float)
    keep = np.isfinite(x).mean(axis=0) >= 1 - missing
    if keep.sum() < least:
        return None
    return [int(c) for c in pdf["permno"].to_numpy()[keep]], np.nan_to_num(x[:, keep])


def shared_pass(rows: DataFrame, window: int, estimator: str = "nls", k: int | None = None, clusters: tuple[int, int] = (2, 20), space: str = "pca") -> DataFrame:
    """Covariance, spectrum, tree, leaf order and labels of every rebalance.

    ``k`` fixes the components of the absorption ratio; without it each date
    uses its own. In the space 'correlation' the tree is of single linkage.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = matrix(pdf, window)
        if found is None:
            return pd.DataFrame(columns=[c.split()[0] for c in PASS.split(", ")])
        assets, x = found
        cov = linalg.ESTIMATORS[estimator](x)
        spectrum = linalg.Spectrum(cov, window)
        features = spectrum.features()
        if space == "correlation":
            distance = np.sqrt(np.maximum(0.5 * (1 - linalg.correlation(cov)), 0))
            merges = linalg.agglomerate(distance, "single")
        else:
            distance = linalg.euclidean(features)
            merges = linalg.agglomerate(distance)
        labels = linalg.cut_tree(len(assets), merges, int(np.clip(spectrum.k, *clusters)))
        return pd.DataFrame(
            [
                {
                    "pos": int(pdf["pos"].iloc[0]), "n": len(assets), "k": spectrum.k, "variance": spectrum.variance, "ar": spectrum.absorption(k), "cov_values": spectrum.cov_values.tolist(),
                    "values": spectrum.values.tolist(), "permnos": assets, "leaf": linalg.optimal_order(distance, merges), "labels": labels.tolist(), "cov": cov.ravel().tolist(), "features": features.ravel().tolist(),
                }
            ]
        )

    return rows.groupBy("pos").applyInPandas(one, PASS)


def frozen_k(first: DataFrame) -> int | None:
    """The number of components of the earliest rebalance, held for the whole run."""
    row = first.orderBy("pos").select("k").first()
    return None if row is None else int(row["k"])


def absorption(shared: DataFrame, k: int | None) -> DataFrame:
    """pos, x: the share of variance in the first ``k`` eigenvalues, from the kept ones."""
    kk = F.least(F.greatest(F.lit(1), F.lit(k) if k is not None else F.col("k")), F.size("cov_values"))
    head = F.aggregate(F.slice("cov_values", F.lit(1), kk), F.lit(0.0), lambda a, v: a + v)
    whole = F.aggregate("cov_values", F.lit(0.0), lambda a, v: a + v)
    return shared.select("pos", F.when(whole > 0, head / whole).alias("x"))


def labelled(shared: DataFrame) -> DataFrame:
    """pos, permno, label, leaf_pos of every rebalance."""
    each = shared.select("pos", F.posexplode(F.arrays_zip("permnos", "labels")).alias("i", "z"), "leaf")
    return each.select("pos", F.col("z.permnos").alias("permno"), F.col("z.labels").alias("label"), (F.array_position("leaf", F.col("i")) - 1).cast("int").alias("leaf_pos"))


WEIGHTS = "strategy string, pos bigint, permno bigint, w double, refit boolean"


def carried_trees(shared: DataFrame, refits: DataFrame, policies: dict[str, str]) -> DataFrame:
    """strategy, pos, leaves (the leaf order in force, as places among the assets of the date), refit.

    ``refits``: pos, fired. Only leaf orders, labels and coordinates are walked
    in order, in a task a strategy, as a tree once fitted is carried to the next.
    """
    table = shared.sparkSession.createDataFrame(list(policies.items()) or [("", "")], "strategy string, policy string").where("policy <> ''")
    rows = shared.select("pos", "n", "permnos", "leaf", "labels", "features").join(refits.select("pos", "fired"), "pos", "left").join(F.broadcast(table))  # a handful of strategies

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        tree: list[int] = []
        labels: dict[int, int] = {}
        since, out = 0, []
        for row in pdf.sort_values("pos").itertuples():
            assets = [int(a) for a in row.permnos]
            fit = not tree or (row.policy.startswith("periodic:") and since >= int(row.policy.split(":")[1])) or (row.policy == "trigger" and bool(row.fired))
            if fit:
                order, since = [int(i) for i in row.leaf], 0
                tree, labels = [assets[i] for i in order], dict(zip(assets, map(int, row.labels)))
            else:
                order, since = linalg.inherited_order(tree, labels, assets, np.asarray(row.features).reshape(len(assets), -1))[0], since + 1
            out.append({"strategy": row.strategy, "pos": int(row.pos), "leaves": order, "refit": fit})
        return pd.DataFrame(out)

    return rows.groupBy("strategy").applyInPandas(walk, "strategy string, pos bigint, leaves array<int>, refit boolean")


def strategy_weights(shared: DataFrame, refits: DataFrame, strategies: dict[str, tuple[str, str]]) -> DataFrame:
    """strategy, pos, permno, w, refit.

    Trees are carried first; then every rebalance is allocated on its own.
    """
    spark = shared.sparkSession
    table = spark.createDataFrame([(n, a) for n, (a, _) in strategies.items()], "strategy string, allocator string")
    trees = carried_trees(shared, refits, {n: p for n, (a, p) in strategies.items() if a.startswith("hrp")})
    rows = shared.select("pos", "n", "permnos", "cov").join(F.broadcast(table)).join(trees, ["strategy", "pos"], "left")

    def allocate(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                n = int(row.n)
                cov = np.asarray(row.cov).reshape(n, n)
                if row.allocator.startswith("hrp"):
                    w = linalg.hierarchical_weights(cov, [int(i) for i in row.leaves], volatility=row.allocator == "hrp_equalvol")
                elif row.allocator == "erc":
                    w = linalg.equal_risk_weights(cov)
                elif row.allocator == "minvar":
                    w = linalg.least_variance_weights(cov)
                else:
                    w = np.full(n, 1 / n)
                out.append(pd.DataFrame({"strategy": row.strategy, "pos": int(row.pos), "permno": np.asarray(row.permnos), "w": w, "refit": bool(row.refit) if row.refit is not None else False}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return rows.mapInPandas(allocate, WEIGHTS)
