"""Queries on dense kernels, replications, sinks, audits and streams. Most have no SQL and are held against brute force in the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import environments, linalg, walk
from panelforge.operators import audit, backtest, estimation, inference, moments, replications, trigger
from panelforge.plans import block_queries, dense_sql, views
from panelforge.plans.block_queries import TRIG, _r, _snapshot, _triggers
from panelforge.plans.views import P, TOTAL
from panelforge.session import cut
from panelforge.sources import sinks, table, tables
from panelforge.streaming import events as streams

RULE = walk.Rule(window=views.WINDOW, every=views.EVERY, first=views.WINDOW)
#: Replications of the null environments, placebo draws, placements, and replications and resamples of power and size: at least the reference's.
REPS, DRAWS, PLACEMENTS = 500, 100_000, 10_000
POWER_REPS, POWER_TIMES = 2000, 2000
SIZE_SETS, SIZE_TIMES = 2000, [600, 2000, 10_000]
RESAMPLES = 10_000
EIGHT = ["gaussian", "shuffle", "timing", "regimes", "slow_regimes", "static"]


def _shared(spark: SparkSession, folder: str, estimator: str = "nls", space: str = "pca", k: int | None = None):
    p, marks, snap = _snapshot(spark, folder)
    return p, marks, estimation.shared_pass(estimation.windows(p, snap, views.WINDOW), views.WINDOW, estimator, k, space=space)


def _by_window(spark, folder, kernel, kind: str) -> DataFrame:
    """A kernel on the window up to every rebalance, one group a rebalance; it is given the assets and their returns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="t", columns="i", values="x")
        return kernel(int(pdf["pos"].iloc[0]), m.columns.to_numpy(), m.to_numpy(dtype=float))

    return views.trailing_windows(spark, folder).groupBy("pos").applyInPandas(one, kind)


PAIRS = "pos bigint, i bigint, k bigint, s double"


def _pairs(pos: int, assets: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    i, k = np.indices(s.shape)
    return pd.DataFrame({"pos": pos, "i": assets[i.ravel()], "k": assets[k.ravel()], "s": s.ravel()})


def i13_nonlinear(spark, folder):
    """Nonlinear shrinkage of each window's covariance."""
    return _r(_by_window(spark, folder, lambda pos, assets, m: _pairs(pos, assets, linalg.nonlinear_shrinkage(m)), PAIRS), 10, "s")


def i22_pairwise(spark, folder):
    """The floored covariance over pairwise complete rows, some cells taken out."""

    def kernel(pos: int, assets: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        m = m.copy()
        m[np.add.outer(np.arange(m.shape[0]), 3 * np.arange(m.shape[1])) % 11 == 0] = np.nan
        f = linalg.pairwise_factor(m)
        return _pairs(pos, assets, f @ f.T)

    return _r(_by_window(spark, folder, kernel, PAIRS), 10, "s")


def i24_bulk(spark, folder):
    """Bulk variance, components kept and the noise edge of each window."""

    def kernel(pos: int, assets: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        s = linalg.Spectrum(linalg.sample_covariance(m), len(m))
        return pd.DataFrame([{"pos": pos, "variance": s.variance, "k": s.k, "edge": linalg.noise_edge(m.shape[1] / len(m), s.variance)}])

    return _r(_by_window(spark, folder, kernel, "pos bigint, variance double, k int, edge double"), 9, "variance", "edge")


def i25_spectrum(spark, folder):
    """Eigenvalues of correlation and covariance at every rebalance."""
    _, _, shared = _shared(spark, folder)
    each = F.posexplode(F.arrays_zip("values", "cov_values")).alias("rank", "z")
    return shared.select("pos", "n", "k", "variance", each).select("pos", "n", "k", F.round("variance", 9).alias("variance"), "rank", F.round("z.values", 9).alias("value"), F.round("z.cov_values", 11).alias("cov_value"))


def i26_absorption(spark, folder):
    """The absorption ratio of every rebalance, components held from the first."""
    _, _, shared = _shared(spark, folder)
    shared = cut(shared)
    return _r(estimation.absorption(shared, estimation.frozen_k(shared)), 9, "x")


def i27_features(spark, folder):
    """Squared length of each asset's coordinates (signs of eigenvectors are free)."""
    _, _, shared = _shared(spark, folder)
    each = shared.select("pos", "k", "features", F.posexplode("permnos").alias("i", "permno"))
    own = F.aggregate(F.slice("features", F.col("i") * F.col("k") + 1, F.col("k")), F.lit(0.0), lambda a, v: a + v * v)
    return each.select("pos", "permno", F.round(own, 8).alias("length"))


def i29_tree(spark, folder):
    """Leaf order and clusters of every rebalance."""
    _, _, shared = _shared(spark, folder)
    return estimation.labelled(shared)


def i29_clusters(spark, folder):
    """The clusters of every rebalance alone."""
    return i29_tree(spark, folder).select("pos", "permno", "label")


def i30_clusters(spark, folder):
    """The clusters in the space of correlation distances alone."""
    return i30_single_linkage(spark, folder).select("pos", "permno", "label")


def i30_single_linkage(spark, folder):
    """The same in the space of correlation distances."""
    _, _, shared = _shared(spark, folder, space="correlation")
    return estimation.labelled(shared)


def i31_cluster_counts(spark, folder):
    _, _, shared = _shared(spark, folder)
    return shared.select("pos", F.greatest(F.lit(2), F.least(F.lit(20), F.col("k"))).alias("clusters"), F.size(F.array_distinct("labels")).alias("found"))


def i37_equal_risk(spark, folder):
    """Equal risk weights of every rebalance; each contribution must be its share."""
    _, _, shared = _shared(spark, folder)

    def one(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                cov = np.asarray(row.cov).reshape(row.n, row.n)
                w = linalg.equal_risk_weights(cov)
                rc = w * (cov @ w)
                if abs(rc / rc.sum() * row.n - 1).max() > 1e-6:
                    raise ValueError(f"contributions at {row.pos} are not equal")
                out += [(int(row.pos), int(p), float(x)) for p, x in zip(row.permnos, w)]
            yield pd.DataFrame(out, columns=["pos", "permno", "w"])

    return _r(shared.select("pos", "n", "permnos", "cov").mapInPandas(one, "pos bigint, permno bigint, w double"), 7, "w")


def i39_least_variance(spark, folder):
    """Least variance weights of every rebalance, negative ones cut."""
    _, _, shared = _shared(spark, folder)
    w = estimation.strategy_weights(shared, shared.select("pos", F.lit(False).alias("fired")), {"MINVAR": ("minvar", "never")})
    return _r(w.select("pos", "permno", "w"), 8, "w")


def i41_shared(spark, folder):
    """What every strategy reads of a rebalance."""
    _, _, shared = _shared(spark, folder)
    return shared.select("pos", "n", "k", F.round("variance", 9).alias("variance"), F.round("ar", 9).alias("ar"))


def i42_frozen(spark, folder):
    """The components of the first rebalance, held for the run."""
    _, _, shared = _shared(spark, folder)
    return shared.groupBy().agg(F.min_by("k", "pos").alias("k"))


def _strategies(spark, folder, estimator: str = "nls", names=("EW", "ERC", "MINVAR", "HRP_static", "HRP_periodic_3", "HRP_trigger")):
    p, marks, shared = _shared(spark, folder, estimator)
    shared = cut(shared)
    ar = estimation.absorption(shared, estimation.frozen_k(shared)).withColumn("run", F.lit(0))
    inputs = trigger.trigger_inputs(ar, ["run"]).withColumn("fired", trigger.fired(1.0))
    chosen = {n: walk.STRATEGIES[n] for n in names}
    weights = cut(estimation.strategy_weights(shared, inputs, chosen))
    every = shared.select("pos").withColumn("strategy", F.explode(F.array(*map(F.lit, chosen))))
    rates = p.select("pos").distinct().withColumn("rf", F.lit(0.02 / views.YEAR))
    daily, moves = backtest.run(weights.select("strategy", "pos", "permno", "w"), every, p, rates, ["strategy"], last=views.last_position(p))
    return shared, inputs, weights, daily.withColumn("rf", F.lit(0.02 / views.YEAR)), moves


def i43_ar_trigger(spark, folder):
    """The trigger on the absorption ratio."""
    _, _, shared = _shared(spark, folder)
    shared = cut(shared)
    ar = estimation.absorption(shared, estimation.frozen_k(shared)).withColumn("run", F.lit(0))
    return _r(trigger.trigger_inputs(ar, ["run"]).select("pos", "x", "d", "sigma", trigger.fired(1.0).alias("fired")), 9, "x", "d", "sigma")


def i45_inherited(spark, folder):
    """Weights of a tree fitted once and carried through entries and exits."""
    _, _, weights, _, _ = _strategies(spark, folder, names=("HRP_static",))
    return weights.select("pos", "permno", "w", "refit")


def i49_runner(spark, folder):
    """All strategies on one shared pass: metrics, turnover and refits."""
    _, _, weights, daily, moves = _strategies(spark, folder)
    fits = weights.where("refit").select("strategy", "pos").distinct().groupBy("strategy").agg(F.count("*").alias("refits"))
    out = backtest.metrics(daily, ["strategy"], views.YEAR).join(moves.groupBy("strategy").agg(F.avg("turnover").alias("turnover")), "strategy").join(fits, "strategy", "left")
    return out.withColumn("refits", F.coalesce("refits", F.lit(0).cast("bigint")))


def i50_registry(spark, folder):
    """The comparator sets by name."""
    return spark.createDataFrame([(n, a, p) for n, (a, p) in walk.STRATEGIES.items()], "strategy string, allocator string, policy string")


def i56_sweep(spark, folder):
    """Sharpe ratios of strategies by estimator."""
    out = None
    for estimator in linalg.ESTIMATORS:
        _, _, _, daily, _ = _strategies(spark, folder, estimator, names=("EW", "HRP_static"))
        one = backtest.metrics(daily, ["strategy"], views.YEAR).select("strategy", F.lit(estimator).alias("estimator"), "sharpe")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("strategy").pivot("estimator", list(linalg.ESTIMATORS)).agg(F.first("sharpe"))


def _real(spark, folder):
    return replications.dense(views.asset_panel(spark, folder))


def i60_environments(spark, folder):
    """Deviation, mean and missing cells of one draw of each null environment."""
    return replications.draws(spark, _real(spark, folder), [*environments.ENVIRONMENTS, "timing"], 1, 100)


def i93_null_matrix(spark, folder):
    """Sharpe ratios of strategies on replications of the null environments."""
    return replications.null_matrix(spark, _real(spark, folder), EIGHT, REPS, RULE, ("EW", "HRP_static", "HRP_trigger"))


def i95_gate(spark, folder):
    """Paired bounds of strategies against the triggered one, by environment, with activation."""
    m = cut(replications.null_matrix(spark, _real(spark, folder), EIGHT, REPS, RULE, ("EW", "HRP_static", "HRP_trigger")))
    focal = m.where("strategy = 'HRP_trigger'").select("environment", "rep", F.col("sharpe").alias("own"), "fired", "eligible")
    d = m.where("strategy <> 'HRP_trigger'").join(focal.drop("fired", "eligible"), ["environment", "rep"]).select("environment", "strategy", "rep", (F.col("own") - F.col("sharpe")).alias("d"))
    bounds = inference.paired_bounds(d, ["environment", "strategy"], block_queries.MARGIN)
    active = focal.groupBy("environment").agg(F.median(F.col("fired") / F.col("eligible")).alias("rate"), F.avg((F.col("fired") >= 3).cast("double")).alias("active"))
    out = bounds.join(active, "environment")
    return out.withColumn("verdict", F.when((F.col("rate") >= 0.05) & (F.col("active") >= 0.9), F.col("verdict")).otherwise("INCONCLUSIVE"))


def i96_contrast(spark, folder):
    """Static tree less equal risk in the regime environment: mean with its interval and a three-way verdict."""
    m = cut(replications.null_matrix(spark, _real(spark, folder), ["regimes"], REPS, RULE, ("ERC", "HRP_static")))
    a, b = (m.where(F.col("strategy") == s).select("rep", F.col("sharpe").alias(c)) for s, c in (("HRP_static", "a"), ("ERC", "b")))
    d = a.join(b, "rep").select((F.col("a") - F.col("b")).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    low, high = F.col("mean") - 1.96 * F.col("se"), F.col("mean") + 1.96 * F.col("se")
    return s.select("n", "mean", low.alias("low"), high.alias("high"), F.when(high < -block_queries.MARGIN, "WORSE").when(low > block_queries.MARGIN, "BETTER").otherwise("ALIKE").alias("verdict"))


def i94_control(spark, folder):
    """A tilt to coming returns of rising strength: its edge over equal weights must rise too."""
    p, marks, snap = _snapshot(spark, folder)
    last = views.last_position(p)
    win = backtest.holding_windows(marks.select(F.lit(0).alias("run"), "pos"), ["run"], 1, last).drop("run")
    seg = snap.select("pos", "permno").join(win, "pos").withColumn("day", F.explode(F.sequence("start", "end"))).join(p.select("permno", F.col("pos").alias("day"), "ret"), ["permno", "day"], "left")
    fwd = seg.groupBy("pos", F.col("permno").alias("i")).agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("fwd"))
    from panelforge.operators import allocation

    weights = None
    for strength in (0.0, 0.1, 0.5):
        one = allocation.tilted_weights(fwd, ["pos"], strength).select(F.lit(f"{strength:.1f}").alias("strategy"), "pos", F.col("i").alias("permno"), "w")
        weights = one if weights is None else weights.unionByName(one)
    every = marks.select("pos").withColumn("strategy", F.explode(F.array(*map(F.lit, ("0.0", "0.1", "0.5")))))
    rates = p.select("pos").distinct().withColumn("rf", F.lit(0.0))
    daily, _ = backtest.run(weights, every, p, rates, ["strategy"], last=last, bps=0.0)
    return backtest.metrics(daily.withColumn("rf", F.lit(0.0)), ["strategy"], views.YEAR).select("strategy", F.round("sharpe", 6).alias("sharpe"))


def _counts(spark, folder) -> list[int]:
    return [r["n"] for r in _triggers(spark, folder).groupBy("gamma").agg(F.count("*").cast("int").alias("n")).orderBy("gamma").collect()]  # four candidates


def i69_placebo(spark, folder):
    """The overlap that random positions reach in 95 of 100 draws, at each candidate's number of events."""
    return replications.placebo_threshold(spark, block_queries.eligible(spark, folder), _counts(spark, folder), DRAWS)


def i80_density(spark, folder):
    """Median and range of the modal gap share of random positions."""
    return replications.modal_share(spark, block_queries.eligible(spark, folder), _counts(spark, folder), draws=PLACEMENTS)


def i81_burstiness(spark, folder):
    """Modal share less that of as many random positions, and whether it lies outside their range."""
    timing = inference.timing_variation(_triggers(spark, folder), ["gamma"]).withColumn("events", (F.col("n_gaps") + 1).cast("int"))
    null = replications.modal_share(spark, block_queries.eligible(spark, folder), _counts(spark, folder), draws=PLACEMENTS).distinct()
    kind = F.when(F.col("modal") > F.col("high"), "above").when(F.col("modal") < F.col("low"), "below").otherwise("inside")
    return timing.join(null, "events").select("gamma", "events", "modal", "m", (F.col("modal") - F.col("m")).alias("excess"), kind.alias("class"))


def _structure(spark, folder):
    rows = block_queries._structural(spark, folder).orderBy("t").select("t", "x", "fired").toPandas()  # one row a rebalance
    return rows["x"].to_numpy(dtype=float), rows["fired"].to_numpy(dtype=bool)


def i77_bootstrap_means(spark, folder):
    """5 and 95 percent points of resampled mean differences, by hashed draws: the 200 resamples of its SQL."""
    return _bootstrap_means(spark, folder, 200)


def i77_bootstrap_means_full(spark, folder):
    """The same of all resamples."""
    return _bootstrap_means(spark, folder, RESAMPLES)


def _bootstrap_means(spark, folder, times: int) -> DataFrame:
    d = block_queries._differences(spark, folder).withColumn("i", (F.row_number().over(Window.partitionBy("strategy").orderBy("rep")) - 1).cast("bigint"))
    n = d.groupBy("strategy").agg(F.count("*").alias("n"))
    draws = n.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))).repartition(24, "strategy", "b").withColumn("j", F.explode(F.expr("sequence(0L, n - 1)")))
    at = F.pmod(inference.hashed(F.lit("i77"), F.col("strategy"), F.col("b").cast("string"), F.col("j").cast("string")), F.col("n"))
    means = draws.withColumn("i", at).join(F.broadcast(d.select("strategy", "i", "d")), ["strategy", "i"]).groupBy("strategy", "b").agg(F.avg("d").alias("m"))
    q = lambda p: F.round(F.percentile("m", F.lit(p)), 9)
    return means.groupBy("strategy").agg(q(0.05).alias("low"), q(0.95).alias("high"))


I77 = f"""with {block_queries.DIFF}, ix as (select strategy, d, row_number() over (partition by strategy order by rep) - 1 as i from dd), nn as (select strategy, count(*) as n from dd group by 1),
dr as (select strategy, b, ('0x' || substr(md5('i77|' || strategy || '|' || b || '|' || j), 1, 12))::bigint % n as i from nn, range(200) r(b), range(2000) s(j) where j < n), me as (select strategy, b, avg(d) as m from dr join ix using (strategy, i) group by 1, 2)
select strategy, round(quantile_cont(m, 0.05), 9) as low, round(quantile_cont(m, 0.95), 9) as high from me group by strategy"""


def i73_bootstrap_full(spark, folder):
    """The p-value of i73_bootstrap, which its SQL holds to 200 resamples, from all of them."""
    rows = block_queries._structural(spark, folder)
    return block_queries._r(inference.block_bootstrap(rows, rows.count(), 4, RESAMPLES, "i73"), 9, "d", "p_value")


def i83_size(spark, folder):
    """How often the bootstrap rejects where nothing is there."""
    return replications.size_calibration(spark, 120, 0.4, SIZE_SETS, SIZE_TIMES)


def i84_power(spark, folder):
    """Power of the tests of all candidates by planted shift and by where it is planted."""
    x, fired = _structure(spark, folder)
    masks = {0.5: fired, 1.0: np.roll(fired, 1), 2.0: np.roll(fired, 2)}
    return replications.power_curve(spark, x, masks, [0.0, 0.5, 2.0], POWER_REPS, POWER_TIMES, 3)


def i85_bracket(spark, folder):
    """The first planted shift with a power of 0.8, and the one before."""
    cells = i84_power(spark, folder)
    before = F.lag("delta").over(Window.partitionBy("target", "condition").orderBy("delta"))
    reached = cells.withColumn("below", before).where("power >= 0.8")
    return reached.groupBy("target", "condition").agg(F.min_by("below", "delta").alias("below"), F.min("delta").alias("reached"))


def _structural_pass(spark, folder):
    """reb, pos, ar, vi: absorption and change of clusters at every rebalance."""
    _, _, shared = _shared(spark, folder)
    shared = cut(shared)
    k = estimation.frozen_k(shared)
    order = Window.partitionBy(F.lit(0)).orderBy("pos")
    ar = estimation.absorption(shared, k).withColumn("reb", F.row_number().over(order))
    labels = estimation.labelled(shared).join(ar.select("pos", "reb"), "pos")
    return ar, labels


def _change(labels: DataFrame, lag: int) -> DataFrame:
    later = labels.select("reb", "permno", F.col("label").alias("b"))
    earlier = labels.select((F.col("reb") + lag).alias("reb"), "permno", F.col("label").alias("a"))
    return moments.partition_scores(later.join(earlier, ["reb", "permno"]), ["reb"]).where("n >= 10").select("reb", "ari", "vi")


def i87_structural(spark, folder):
    """Absorption ratio, trigger inputs and change of clusters at every rebalance."""
    return _r(_structural_rows(spark, folder), 9, "x", "d", "sigma", "vi")


def _structural_rows(spark, folder):
    ar, labels = _structural_pass(spark, folder)
    inputs = trigger.trigger_inputs(ar.withColumn("run", F.lit(0)), ["run"])
    return inputs.join(_change(labels, 1), "reb", "left").select("reb", "pos", "x", "d", "sigma", F.col("sigma").isNotNull().alias("eligible"), "vi")


def i88_candidates(spark, folder):
    """Every candidate with its events, timing, overlap, shift and adjusted p-value, and whether it passes."""
    sp = _structural_rows(spark, folder).where("eligible").withColumn("j", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos")) - 1).cast("bigint")).persist()
    size = sp.count()
    each = sp.withColumn("gamma", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0))))).withColumn("fired", F.coalesce(F.abs("d") > F.col("gamma") * F.col("sigma"), F.lit(False)))
    sets = each.where("fired").select("gamma", "j")
    events = each.groupBy("gamma").agg(F.sum(F.col("fired").cast("bigint")).alias("events"), F.avg(F.col("fired").cast("double")).alias("rate"))
    out = events.join(inference.timing_variation(sets, ["gamma"]).select("gamma", "cv", "modal"), "gamma", "left").join(inference.schedule_overlap(sets, ["gamma"], size).select("gamma", "j_star"), "gamma", "left")
    rows = each.where("vi is not null").select("gamma", "j", F.col("vi").alias("x"), "fired")

    def p_value(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        rng = np.random.default_rng(int(pdf["gamma"].iloc[0] * 1000))
        return pd.DataFrame([{"gamma": float(pdf["gamma"].iloc[0]), "p": replications.bootstrap_p(pdf["x"].to_numpy(), pdf["fired"].to_numpy(), 3, 400, rng)}])

    p = rows.groupBy("gamma").applyInPandas(p_value, "gamma double, p double")
    adjusted = inference.holm(p.select(F.lit(0).alias("family"), F.col("gamma").alias("key"), "p"), ["family"]).select(F.col("key").alias("gamma"), "p", "p_holm")
    out = out.join(adjusted, "gamma").join(inference.median_shift(rows, ["gamma"]), "gamma", "left")
    ok = F.col("rate").between(0.05, 0.6) & (F.col("cv") >= 0.5) & (F.col("modal") <= 0.6) & (F.col("p_holm") <= 0.05)
    return out.withColumn("passes", F.coalesce(ok, F.lit(False)))


def i89_selection(spark, folder):
    """The passing candidate nearest to 1, the larger of two; none where none passes."""
    c = i88_candidates(spark, folder)
    nearest = c.where("passes").orderBy(F.abs(F.col("gamma") - 1), F.desc("gamma")).limit(1)
    counts = c.agg(F.lit(0).alias("run"), F.count("*").alias("candidates"), F.sum(F.col("passes").cast("bigint")).alias("passing"))
    return counts.join(nearest.select(F.pmod(F.col("gamma").cast("int"), F.lit(1)).alias("run"), "gamma"), "run", "left").drop("run")


def i92_sweep(spark, folder):
    """Mean change of clusters by horizon, and mean absorption by components."""
    _, _, shared = _shared(spark, folder)
    shared = cut(shared)
    ar, labels = _structural_pass(spark, folder)
    out = None
    for lag in (1, 2, 4, 8):
        one = _change(labels, lag).agg(F.avg("vi").alias("value")).select(F.lit("vi").alias("what"), F.lit(lag).alias("at"), "value")
        out = one if out is None else out.unionByName(one)
    for k in (1, 2, 4):
        out = out.unionByName(estimation.absorption(shared, k).agg(F.avg("x").alias("value")).select(F.lit("absorption").alias("what"), F.lit(k).alias("at"), "value"))
    return _r(out, 9, "value")


def i97_mechanism(spark, folder):
    """Firing rates of the trigger by environment, with their 2.5 and 97.5 percent points."""
    m = replications.null_matrix(spark, _real(spark, folder), EIGHT, REPS, RULE, ("HRP_trigger",), base=20270101)
    rate = F.col("fired") / F.col("eligible")
    q = lambda p: F.percentile(rate, F.lit(p))
    return m.groupBy("environment").agg(F.count("*").alias("reps"), q(0.025).alias("low"), F.median(rate).alias("mid"), q(0.975).alias("high"))


def i98_control(spark, folder):
    """How many candidates' modal shares lie inside the range of random positions."""
    c = i81_burstiness(spark, folder).groupBy("class").agg(F.count("*").alias("n"))
    return c.select("class", "n")


def i106_intervals(spark, folder):
    """Normal intervals of mean differences."""
    d = block_queries._differences(spark, folder).groupBy("strategy").agg(F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    return d.select("strategy", F.round(F.col("mean") - 1.96 * F.col("se"), 7).alias("low"), F.round(F.col("mean") + 1.96 * F.col("se"), 7).alias("high"))


I106 = f"with {block_queries.DIFF} select strategy, round(avg(d) - 1.96::double * stddev_samp(d) / sqrt(count(d)), 7) as low, round(avg(d) + 1.96::double * stddev_samp(d) / sqrt(count(d)), 7) as high from dd group by strategy"


# sinks, audits ---------------------------------------------------------------------------------
def a02_parquet(spark, folder):
    return sinks.round_trip(table(spark, folder, "membership"), "parquet")


def a10_csv(spark, folder):
    return sinks.round_trip(table(spark, folder, "membership"), "csv")


def a11_json(spark, folder):
    return sinks.round_trip(table(spark, folder, "membership"), "json")


MEMBERSHIP = "select * from membership"


def a12_jsonl(spark, folder):
    """A chained log written as JSON lines and replayed: events by whether their link holds."""
    log = sinks.round_trip(_chain(spark, folder), "json")
    return log.join(audit.chain_breaks(log).select("touch_id").distinct().withColumn("broken", F.lit(True)), "touch_id", "left").groupBy(F.coalesce("broken", F.lit(False)).alias("broken")).agg(F.count("*").alias("n"))


def _chain(spark, folder):
    rows = table(spark, folder, "eval_items", "item_id", "suite").orderBy("item_id").collect()  # a chain is made in order; ids and suites only
    return audit.hashed_chain(spark, [(r["item_id"], r["suite"]) for r in rows])


def i101_chain(spark, folder):
    """Breaks of a log in which one event was taken out, and one was changed and kept its hash."""
    log = _chain(spark, folder).where("touch_id <> 17")
    return audit.chain_breaks(log.withColumn("reason", F.when(F.col("touch_id") == 30, "other").otherwise(F.col("reason"))))


CHAIN = f"""items as (select item_id, coalesce(suite, 'None') as suite, row_number() over (order by item_id) as k from eval_items),
ch(k, touch_id, reason, prev_hash, event_hash) as (
  select 0::bigint, 0::bigint, '', '', '{audit.GENESIS}'
  union all
  select i.k, i.item_id, i.suite, ch.event_hash, sha256(ch.event_hash || '|' || i.item_id || '|' || i.suite) from ch join items i on i.k = ch.k + 1
)"""
BROKEN = """select touch_id, 'content' as kind from log where event_hash <> sha256(prev_hash || '|' || touch_id || '|' || reason)
union all select touch_id, 'link' from (select touch_id, prev_hash, lag(event_hash) over (order by touch_id) as before from log) where before is not null and prev_hash <> before"""
I101 = f"with recursive {CHAIN}, log as (select touch_id, case when touch_id = 30 then 'other' else reason end as reason, prev_hash, event_hash from ch where k > 0 and touch_id <> 17) {BROKEN}"
A12 = f"with recursive {CHAIN}, log as (select * from ch where k > 0) select b.touch_id is not null as broken, count(*) as n from log left join ({BROKEN}) b using (touch_id) group by 1"


def a13_numbers(spark, folder):
    """Numbers with a unit in the texts of subject examples, by a regular expression."""
    t = table(spark, folder, "subject_examples", "example_id", "text")
    found = F.explode(F.expr(r"regexp_extract_all(text, '([0-9]+\\.[0-9]+)%', 1)")).alias("number")
    return t.select("example_id", found).groupBy("example_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("number").cast("double")), 6).alias("total"))


A13 = r"select example_id, count(*) as n, round(sum(cast(x as double)), 6) as total from (select example_id, unnest(regexp_extract_all(text, '([0-9]+\.[0-9]+)%', 1)) as x from subject_examples) group by example_id"


def i99_manifest(spark, folder):
    """Rows, columns and content of every table."""
    return audit.manifest(spark, folder, tables.names(spark, folder))


def i100_numbers(spark, folder):
    """Recomputed numbers against expected ones."""
    rows = table(spark, folder, "rf").agg(F.count("*").cast("double").alias("a"), F.countDistinct("date").cast("double").alias("b"))
    actual = rows.select(F.explode(F.array(F.struct(F.lit("rows").alias("name"), F.col("a").alias("actual")), F.struct(F.lit("days").alias("name"), F.col("b").alias("actual")))).alias("x")).select("x.*")
    expected = spark.createDataFrame([("rows", 1797.0), ("days", 1797.0), ("other", 1.0)], "name string, expected double")
    return audit.compared(expected, actual, 1e-9)


I100 = "select name, expected, actual, case when actual is null then 'CHECK' when abs(actual - expected) <= 1e-9 then 'PASS' else 'FAIL' end as status from (values ('rows', 1797.0::double), ('days', 1797.0::double), ('other', 1.0::double)) e(name, expected) left join (select 'rows' as name, count(*)::double as actual from rf union all select 'days', count(distinct date)::double from rf) using (name)"


# streams -----------------------------------------------------------------------------------------
def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def j1_tumbling(spark, folder):
    out = streams.drained(streams.tumbling(streams.source(spark, folder)), "complete")
    return out.select(stamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


J1 = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


def j1_sliding(spark, folder):
    out = streams.drained(streams.tumbling(streams.source(spark, folder), "2 days", "1 day"), "complete")
    return out.select(stamp("start").alias("start"), "event_type", "n")


J1_SLIDING = "select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from (select unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as s, event_type from events) group by 1, 2"


def j2_sessions(spark, folder):
    """Sessions of users with a gap of six hours, from a stream that gives all of them after each batch."""
    out = streams.drained(streams.sessions(streams.source(spark, folder)), "complete")
    return out.select("user_id", stamp("start").alias("start"), "n")


J2 = "with m as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), r as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as run from m) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from r group by user_id, run"


def j3_closed(spark, folder):
    """Days that a watermark of two days closes, from a stream."""
    return streams.drained(streams.closed_days(streams.source(spark, folder))).select(stamp("start").alias("start"), "n")


def j4_online(spark, folder):
    """The trigger on the market's value as a stateful stream; equal to e03 on the whole series."""
    spot = streams.shared_folder(spark)
    views.total_value(spark, folder).repartition(1).write.parquet(f"{spot}/series")
    series = spark.readStream.schema("run int, pos bigint, x double").parquet(f"{spot}/series")
    out = streams.drained(streams.online_trigger(series))
    return out.select("pos", F.round("level", 7).alias("level"), F.round("d", 7).alias("d"), F.round("sigma", 7).alias("sigma"), "fired")


J4 = f"with {TRIG} select pos, round(level, 7) as level, round(d, 7) as d, round(sigma, 7) as sigma, coalesce(abs(d) > sigma, false) as fired from tr"


def j5_spells(spark, folder):
    """Streamed events with a static spell of their user."""
    spells = spark.range(150).select(F.col("id").alias("user"), F.lit("2024-01-05").cast("date").alias("a"), F.lit("2024-01-20").cast("date").alias("b"), F.col("id").alias("spell_id")).where("user % 3 = 0")
    out = streams.drained(streams.with_spells(streams.source(spark, folder).select("event_id", "user_id", "ts"), spells, "user_id", "user", "a", "b"))
    return out.select("event_id", "spell_id")


J5 = "select event_id, case when user_id % 3 = 0 and user_id < 150 and cast(ts as date) between date '2024-01-05' and date '2024-01-20' then user_id end as spell_id from events"

QUERIES = {
    f.__name__: f
    for f in (
        i13_nonlinear, i22_pairwise, i24_bulk, i25_spectrum, i26_absorption, i27_features, i29_tree, i29_clusters, i30_single_linkage, i30_clusters, i31_cluster_counts, i37_equal_risk, i39_least_variance, i41_shared, i42_frozen, i43_ar_trigger, i45_inherited,
        i49_runner, i50_registry, i56_sweep, i60_environments, i93_null_matrix, i95_gate, i96_contrast, i94_control, i69_placebo, i80_density, i81_burstiness, i77_bootstrap_means, i77_bootstrap_means_full, i73_bootstrap_full, i83_size, i84_power, i85_bracket, i87_structural,
        i88_candidates, i89_selection, i92_sweep, i97_mechanism, i98_control, i106_intervals, a02_parquet, a10_csv, a11_json, a12_jsonl, i101_chain, a13_numbers, i99_manifest, i100_numbers,
        j1_tumbling, j1_sliding, j2_sessions, j3_closed, j4_online, j5_spells,
    )
}
for _name in ("a02_parquet", "a10_csv", "a11_json"):
    QUERIES[_name] = (lambda q: lambda spark, folder: q(spark, folder).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("mbrstartdt", "mbrenddt", "recdt")}))(QUERIES[_name])
_MEMBERSHIP = "select mbr_id, permno, strftime(mbrstartdt, '%Y-%m-%d') as mbrstartdt, strftime(mbrenddt, '%Y-%m-%d') as mbrenddt, strftime(recdt, '%Y-%m-%d') as recdt from membership"
SQL = dense_sql.SQL | {
    "a12_jsonl": A12, "i101_chain": I101,
    "i77_bootstrap_means": I77, "i106_intervals": I106, "a02_parquet": _MEMBERSHIP, "a10_csv": _MEMBERSHIP, "a11_json": _MEMBERSHIP, "a13_numbers": A13, "i100_numbers": I100,
    "j1_tumbling": J1, "j1_sliding": J1_SLIDING, "j2_sessions": J2, "j4_online": J4, "j5_spells": J5,
}
