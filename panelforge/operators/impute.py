"""Filling missing values from similar records by k-prototypes.

Records are clustered on their observed features: squared distance on scaled
numbers plus a weight for every category that differs; a feature that a record
lacks takes no part in its distance, nor in the prototype that its cluster gets.
A missing cell is filled from the record's cluster (median of a number, mode of
a category). Where what is known of a record cannot tell several clusters
apart, all of them together are its cluster. Where they hold too few observed
values, or nothing is known of the record, the cell is filled from its parent
(a coarse category of the record), and from all records in the last resort. A
flag per cell tells which it was.

Scale: every iteration is one pass that reduces to a row per cluster before
anything moves; only prototypes reach the driver (k times the number of
features). Fills are one more pass, reduced to a row per cluster, parent and
whole. Medians come from quantile sketches of bounded size, so a cluster that
holds a third of all rows is no large group.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.lookup import lookup_join
from panelforge.session import cut

#: Relative error of a median is one by this.
ACCURACY = 10_000
#: Records among which the first prototypes are chosen; those of least hash.
SEEDS = 2_000
#: How much further than the nearest a cluster may be (in squared scaled units) and not be told apart from it.
ALIKE = 0.02


class KPrototypes:
    """Prototypes: a centre per numeric feature, and a mode per categorical one.

    ``categorical`` gives the weight of each category that differs.
    """

    def __init__(self, numeric: list[str], categorical: dict[str, float], k: int = 12, rounds: int = 6, seed: int = 7):
        self.numeric, self.categorical, self.k, self.rounds, self.seed = numeric, categorical, k, rounds, seed
        self.shift, self.scale = np.zeros(len(numeric)), np.ones(len(numeric))
        self.centres: list[list[float | None]] = []
        self.modes: list[list[str | None]] = []

    @property
    def features(self) -> list[Column]:
        return [F.col(c).cast("double").alias(c) for c in self.numeric] + [F.col(c).cast("string").alias(c) for c in self.categorical]

    def _near(self):
        """A function from the features of rows to the numbers of their nearest prototypes, joined by commas."""
        centres = np.array([[np.nan if x is None else x for x in c] for c in self.centres], dtype=float).reshape(len(self.centres), len(self.numeric))
        modes, weights, shift, scale = self.modes, list(self.categorical.values()), self.shift, self.scale

        def near(*columns: pd.Series) -> pd.Series:
            if not len(centres) or not len(columns[0]):
                return pd.Series([None] * len(columns[0]), dtype=object)
            far, known = np.zeros((len(columns[0]), len(centres))), np.zeros(len(columns[0]), dtype=bool)
            for i, column in enumerate(columns[: len(shift)]):
                x = (column.to_numpy(dtype=float, na_value=np.nan) - shift[i]) / scale[i]
                known |= ~np.isnan(x)
                far += np.nan_to_num((x[:, None] - centres[None, :, i]) ** 2, nan=0.0)
            for j, column in enumerate(columns[len(shift) :]):
                codes, words = pd.factorize(column)  # -1 where it is not known, which is the last row
                differs = np.array([[weights[j] * (w != m[j]) for m in modes] for w in words] + [[0.0] * len(modes)], dtype=float).reshape(-1, len(modes))
                known |= codes >= 0
                far += differs[codes]
            alike = far <= far.min(axis=1, keepdims=True) + ALIKE
            patterns, at = np.unique(np.packbits(alike, axis=1), axis=0, return_inverse=True)
            names = [",".join(map(str, np.flatnonzero(np.unpackbits(p)[: far.shape[1]]))) for p in patterns]
            return pd.Series(np.array([*names, None], dtype=object)[np.where(known, at.ravel(), -1)])

        return F.pandas_udf(near, "string")

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with ``near``, the nearest clusters, ascending and more than one only if they are alike, and ``cluster``, the first of them; both null where no feature is known."""
        marked = df.withColumn("near", self._near()(*self.features))
        return marked.withColumn("cluster", F.substring_index("near", ",", 1).cast("int"))

    def _first(self, rows: list) -> None:
        """Prototypes far from each other: each is drawn among ``rows`` by its distance from those before."""
        if not rows:
            return
        draw = np.random.default_rng(self.seed)
        numbers = np.array([[np.nan if r[c] is None else r[c] for c in self.numeric] for r in rows], dtype=float).reshape(len(rows), len(self.numeric))
        numbers = (numbers - self.shift) / self.scale
        words = [[r[c] for c in self.categorical] for r in rows]
        weights = list(self.categorical.values())
        least, at = np.full(len(rows), np.inf), 0
        for _ in range(min(self.k, len(rows))):
            self.centres.append([None if np.isnan(x) else float(x) for x in numbers[at]])
            self.modes.append(list(words[at]))
            apart = np.nan_to_num((numbers - numbers[at]) ** 2).sum(axis=1)
            for j, weight in enumerate(weights):
                apart += weight * np.array([w[j] is not None and w[j] != words[at][j] for w in words])
            least = np.minimum(least, apart)
            if not least.sum() > 0:
                break
            at = int(draw.choice(len(rows), p=least / least.sum()))

    def fit(self, df: DataFrame) -> KPrototypes:
        """Fit on all rows of ``df``, each by what is known of it.

        The first prototypes are chosen among SEEDS records, those that lack
        least before others. ``df`` is read once a round, so it is cut from its
        lineage before.
        """
        self.centres, self.modes = [], []
        df = df.select(*self.features)
        names = [*self.numeric, *self.categorical]
        stats = df.agg(F.lit(1), *(f(c).alias(f"{c}_{n}") for c in self.numeric for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        self.shift = np.array([stats[f"{c}_m"] or 0.0 for c in self.numeric])
        self.scale = np.array([stats[f"{c}_s"] or 1.0 for c in self.numeric])
        lacking = functools.reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in names))
        some = df.where(lacking < len(names))
        self._first(some.orderBy(lacking, F.xxhash64(*names, F.lit(self.seed)), *names).limit(SEEDS).collect())  # no sort of all rows: every task keeps its SEEDS least
        for _ in range(self.rounds if self.centres else 0):
            told = self.assign(some).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in self.numeric), *(F.mode(c, True).alias(c) for c in self.categorical)).collect()
            centres, modes = [list(c) for c in self.centres], [list(m) for m in self.modes]
            for r in told:
                at = r["cluster"]
                centres[at] = [before if r[c] is None else float((r[c] - self.shift[i]) / self.scale[i]) for i, (c, before) in enumerate(zip(self.numeric, centres[at]))]
                modes[at] = [before if r[c] is None else r[c] for c, before in zip(self.categorical, modes[at])]
            same = modes == self.modes and np.allclose(np.array(centres, dtype=float), np.array(self.centres, dtype=float), equal_nan=True)
            self.centres, self.modes = centres, modes
            if same:
                break
        return self


def fill_missing(df: DataFrame, targets: dict[str, str], model: KPrototypes, parents: list[str], least: int = 5) -> DataFrame:
    """Fill the null cells of ``targets`` (column: 'median' or 'mode').

    ``df`` holds nulls in every cell to fill; disguised values are turned into
    nulls before. ``parents`` are coarse categories of the rows, of which the first
    that is known and has enough values counts; all may be null.
    Adds ``{column}_filled`` (the value, observed or filled) and
    ``{column}_method``: null where observed, else 'cluster', 'parent', 'all',
    or 'none' where no record has a value. Clusters and parents of fewer than
    ``least`` observed values are passed over. Ties of a mode go to the lowest
    value.
    """
    df = cut(df)
    marked = cut(model.fit(df).assign(df).withColumnRenamed("near", "__near"))
    lacking = functools.reduce(lambda a, b: a | b, (F.col(c).isNull() for c in targets))
    kinds = dict(df.dtypes)
    # which clusters a group of fills takes in: as many groups as the prototypes' categories allow
    near = marked.where(lacking & F.col("__near").isNotNull()).select("__near", F.explode(F.split("__near", ",").cast("array<int>")).alias("cluster")).distinct()
    near = near.groupBy("cluster").agg(F.collect_list("__near").alias("__sets"))
    told = lookup_join(marked.select("cluster", *parents, *(F.col(c).alias(f"__{c}") for c in targets)), near, ["cluster"], "left")
    group = lambda level, key: F.struct(F.lit(level).alias("level"), key.cast("string").alias("key"))
    fixed = F.array(*(group(p, F.col(p)) for p in parents), group("all", F.lit("")))
    groups = F.concat(F.transform(F.coalesce("__sets", F.array().cast("array<string>")), lambda x: group("cluster", x)), fixed)
    aggregates = []
    for column, how in targets.items():
        value = F.percentile_approx(f"__{column}", 0.5, ACCURACY) if how == "median" else F.mode(f"__{column}", True)
        aggregates += [value.alias(column), F.count(f"__{column}").alias(f"__n_{column}")]
    fills = cut(told.select(F.explode(groups).alias("g"), *(f"__{c}" for c in targets)).where("g.key is not null").groupBy("g.level", "g.key").agg(*aggregates))
    whole, out, levels = fills.where("level = 'all'").first(), marked, []
    for level, key in (("cluster", F.col("__near")), *((p, F.col(p).cast("string")) for p in parents)):
        enough = (F.when(F.col(f"__n_{c}") >= least, F.col(c)).alias(f"__{level}_{c}") for c in targets)
        out = lookup_join(out.withColumn("__key", key), fills.where(F.col("level") == level).select(F.col("key").alias("__key"), *enough), ["__key"], "left").drop("__key")
        levels.append((level, "cluster" if level == "cluster" else "parent"))
    for column in targets:
        last = F.lit(whole[column] if whole else None).cast(kinds[column])
        method = F.when(F.col(column).isNotNull(), F.lit(None).cast("string"))
        for level, name in levels:
            method = method.when(F.col(f"__{level}_{column}").isNotNull(), name)
        method = method.when(last.isNotNull(), "all").otherwise("none")
        value = F.coalesce(column, *(f"__{level}_{column}" for level, _ in levels), last).cast(kinds[column])
        out = out.withColumn(f"{column}_filled", value).withColumn(f"{column}_method", method)
    return out.select(*df.columns, "cluster", *(f"{c}_{x}" for c in targets for x in ("filled", "method")))
