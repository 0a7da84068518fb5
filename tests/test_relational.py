import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import linalg
from panelforge.operators import allocation, audit, backtest, inference, moments, panel, replications, trigger, universe
from panelforge.streaming import events as streams

RNG = np.random.default_rng(11)
X = RNG.normal(0, 0.02, (120, 13))


@pytest.fixture(scope="module")
def x(spark):
    t, i = np.indices(X.shape)
    return spark.createDataFrame(pd.DataFrame({"t": t.ravel(), "i": i.ravel(), "x": X.ravel()})).persist()


def _square(df, column="s"):
    return df.toPandas().pivot(index="i", columns="k", values=column).to_numpy()


def test_pairs_equal_kernels(x):
    assert np.allclose(_square(moments.covariance(x)), np.cov(X.T))
    assert np.allclose(_square(moments.linear_shrinkage(x)), linalg.linear_shrinkage(X))
    assert np.allclose(_square(moments.decayed_shrinkage(x, 0.98, 120)), linalg.decayed_shrinkage(X, 0.98))
    assert np.allclose(_square(moments.correlation(moments.covariance(x)), "r"), np.corrcoef(X.T))


def test_bisection_equals_recursion(spark, x):
    cov = np.cov(X.T)
    order = [int(v) for v in RNG.permutation(13)]
    leaves = spark.createDataFrame([(a, p) for p, a in enumerate(order)], "i bigint, leaf_pos int")
    for vol in (False, True):
        got = allocation.bisection_weights(moments.covariance(x), leaves, 13, volatility=vol).orderBy("i").toPandas()["w"].to_numpy()
        assert np.allclose(got, linalg.hierarchical_weights(cov, order, vol))
    rc = allocation.risk_contributions(moments.covariance(x), spark.createDataFrame([(i, float(w)) for i, w in enumerate(linalg.equal_risk_weights(cov))], "i bigint, w double"))
    assert rc.agg(F.max(F.abs(F.col("rc") - 1 / 13))).first()[0] < 1e-6


def test_partition_scores(spark):
    a = spark.createDataFrame([(0, i % 3, i % 3 + 5) for i in range(30)] + [(1, i % 3, i % 2) for i in range(30)] + [(1, None, 1)], "run int, a int, b int")
    got = {r["run"]: r for r in moments.partition_scores(a, ["run"]).collect()}
    assert got[0]["ari"] == pytest.approx(1) and got[0]["vi"] == pytest.approx(0, abs=1e-12)
    assert got[1]["n"] == 30 and got[1]["ari"] < 0.1 and got[1]["vi"] > 1
    assert moments.partition_scores(a.limit(0), ["run"]).collect() == []


def test_trigger_sees_only_the_past_and_streams_alike(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=60).cumsum()
    rows = [(0, i, float(y)) for i, y in enumerate(v)]
    df = spark.createDataFrame(rows, "run int, pos bigint, x double")
    batch = {r["pos"]: r for r in trigger.trigger_inputs(df, ["run"]).withColumn("fired", trigger.fired(1.0)).collect()}
    cut = {r["pos"]: r for r in trigger.trigger_inputs(df.where("pos < 40"), ["run"]).withColumn("fired", trigger.fired(1.0)).collect()}
    assert all(batch[p]["sigma"] == cut[p]["sigma"] for p in cut) and batch[6]["sigma"] is None and batch[7]["sigma"] is not None
    df.repartition(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = {r["pos"]: r for r in streams.drained(streams.online_trigger(stream)).collect()}
    for p, r in batch.items():
        assert got[p]["fired"] == r["fired"] and got[p]["level"] == pytest.approx(r["level"])


def test_policies(spark):
    df = spark.createDataFrame([(0, i, float(i)) for i in range(13)], "run int, pos bigint, x double")
    inputs = trigger.trigger_inputs(df, ["run"])
    assert [r["pos"] for r in trigger.refits(inputs, ["run"], "periodic:3").where("refit").orderBy("pos").collect()] == [0, 4, 8, 12]
    assert trigger.refits(inputs, ["run"], "never").where("refit").count() == 1
    with pytest.raises(ValueError):
        trigger.refits(inputs, ["run"], "sometimes")


def test_overlap_of_an_odd_calendar_is_one(spark):
    odd = spark.createDataFrame([(0, j) for j in range(1, 233, 2)], "run int, j bigint")
    r = inference.schedule_overlap(odd, ["run"], 233).first()
    assert (r["j_star"], r["q"], r["r"]) == (1.0, 2, 1)
    t = inference.timing_variation(odd, ["run"]).first()
    assert (t["cv"], t["modal"]) == (0.0, 1.0)
    assert inference.timing_variation(odd.limit(2), ["run"]).first()["cv"] is None


def test_placebo_threshold_at_known_counts(spark):
    got = {r["events"]: r["threshold"] for r in replications.placebo_threshold(spark, 233, [112, 12], 20_000).collect()}
    assert got[112] == pytest.approx(0.3818, abs=0.006) and got[12] == pytest.approx(0.171, abs=0.006)


def test_holm(spark):
    p = spark.createDataFrame([(0, 0.5, 0.01), (0, 1.0, 0.04), (0, 1.5, 0.03), (0, 2.0, 0.20), (0, 9.0, float("nan")), (0, 9.5, None)], "family int, key double, p double")
    got = {r["key"]: r["p_holm"] for r in inference.holm(p, ["family"]).collect()}
    assert got[0.5] == pytest.approx(0.04) and got[1.5] == got[1.0] == pytest.approx(0.09) and got[2.0] == pytest.approx(0.2) and got[9.0] is None and got[9.5] is None


def test_bounds_and_controls(spark):
    d = spark.createDataFrame([("a", float(v)) for v in RNG.normal(0, 0.1, 150)] + [("a", float("nan")), ("b", 1.0)], "s string, d double")
    got = {r["s"]: r for r in inference.paired_bounds(d, ["s"], 0.1).collect()}
    assert got["a"]["n"] == 150 and got["a"]["verdict"] == "PASS" and got["b"]["verdict"] == "INCONCLUSIVE"
    moved = inference.location_shift(d.where("s = 'a' and not isnan(d)"), ["s"], 0.3)
    assert inference.paired_bounds(moved, ["s"], 0.1).first()["verdict"] == "FAIL"


def test_block_length_and_bootstrap(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=233)
    ar = np.zeros(233)
    for i in range(1, 233):
        ar[i] = 0.85 * ar[i - 1] + noise[i]
    length = lambda v: inference.block_length(spark.createDataFrame([(i, float(y)) for i, y in enumerate(v)], "t bigint, x double"), len(v)).first()[0]
    assert length(ar) > 5 and length(noise) <= 3
    fired = rng.random(233) < 0.48
    rows = spark.createDataFrame([(i, float(y + 1.2 * f), bool(f)) for i, (y, f) in enumerate(zip(noise, fired))], "t bigint, x double, fired boolean")
    a, b = (inference.block_bootstrap(rows.repartition(n), 233, 3, 200, "s").first() for n in (1, 5))
    assert a == b and a["d"] > 0.5 and a["p_value"] < 0.02


def test_power_does_not_depend_on_partitions(spark):
    v = np.random.default_rng(1).normal(size=80)
    masks = {0.5: np.arange(80) % 3 == 0, 1.0: np.arange(80) % 5 == 0}
    a = replications.power_curve(spark, v, masks, [0.0, 3.0], 4, 40, 2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    b = replications.power_curve(spark, v, masks, [0.0, 3.0], 4, 40, 2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert len(a) == 8 and all(r["power"] == 1 for r in a if r["delta"] == 3.0 and r["condition"] == "fired")
    assert all(r["power"] < 1 for r in a if r["delta"] == 3.0 and r["condition"] == "uniform")  # a shift anywhere is none of the mask's


def test_folds_leave_their_purge():
    for _, lo, hi, first, last in backtest.folds(0, 999, 300, 4, 21):
        assert first - hi - 1 == 21 and last > first and lo == 0
    with pytest.raises(ValueError):
        backtest.folds(0, 99, 300, 4, 21)


def test_run_holds_dead_names_in_cash(spark):
    p = spark.createDataFrame([(1, t, 0.01) for t in range(6)] + [(2, t, 0.02) for t in range(3)], "permno bigint, pos bigint, ret double")
    w = spark.createDataFrame([("s", 0, 1, 0.5), ("s", 0, 2, 0.5), ("s", 4, 1, 1.0)], "strategy string, pos bigint, permno bigint, w double")
    marks = spark.createDataFrame([("s", 0), ("s", 4)], "strategy string, pos bigint")
    rates = spark.range(6).select(F.col("id").alias("pos"), F.lit(0.001).alias("rf"))
    daily, moves = backtest.run(w, marks, p, rates, ["strategy"], bps=10.0)
    g = {r["day"]: r["gross"] for r in daily.collect()}
    assert g[1] == pytest.approx(0.015) and g[3] == pytest.approx((0.5 * 1.01**3 + 0.5 * 1.02**2 * 1.001) / (0.5 * 1.01**2 + 0.5 * 1.02**2) - 1)
    m = {r["pos"]: r["turnover"] for r in moves.collect()}
    assert m[0] == 0.5 and 0 < m[4] < 0.5


def test_universe_rules(spark):
    D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(1, t, D(t), 10.0, 0.1) for t in range(10)] + [(2, t, D(t), 10.0, 0.1) for t in range(10)] + [(3, t, D(t), None, 0.1) for t in range(10)] + [(4, t, D(t), 99.0, 0.1) for t in range(7, 10)]
    p = spark.createDataFrame(rows, "permno bigint, pos bigint, date date, mcap double, ret double")
    members = spark.createDataFrame([(i, D(0), D(9)) for i in (1, 2, 3, 4)] + [(1, D(0), D(9))], "permno bigint, mbrstartdt date, mbrenddt date")
    rule = universe.UniverseRule(n_assets=2, min_history=5, cap_lag=2, every=4)
    marks = universe.rebalances(p.select("pos", "date").distinct(), 4, 9, 4)
    got = [(r["pos"], r["permno"]) for r in universe.snapshots(p, members, marks, rule).orderBy("pos", "rank").collect()]
    assert got == [(8, 1), (8, 2)]
    sizes = {r["pos"]: r for r in universe.realised_sizes(p, members, marks, rule).collect()}
    assert sizes[4]["n_eligible"] == 0 and sizes[8]["n_members"] == 4 and sizes[8]["n_unseasoned"] == 1
    assert universe.window_for(100) == 504 and universe.window_for(400) == 756
    with pytest.raises(ValueError):
        universe.window_for(2000)


def test_panel_splices_delistings(spark):
    D = lambda n: dt.date(2020, 1, n)
    dsf = spark.createDataFrame([(1, 1, 1, D(1), 0.1, -10.0, 5.0, None), (2, 1, 1, D(2), 0.1, 10.0, 5.0, None), (3, 2, 1, D(1), None, 1.0, 1.0, None)], "obs_id bigint, permno bigint, lineno int, date date, ret double, prc double, shrout double, loadts timestamp")
    delist = spark.createDataFrame([(1, D(2), None, 574), (2, D(3), None, 231), (9, D(1), -0.5, 560)], "permno bigint, dlstdt date, dlret double, dlstcd int")
    got = {(r["permno"], r["date"].day): (r["ret"], r["mcap"]) for r in panel.build_panel(dsf, None, delist).collect()}
    assert got[1, 1] == (0.1, 50.0) and got[1, 2][0] == pytest.approx(1.1 * 0.7 - 1) and got[2, 3] == (0.0, None)
    assert not any(k[0] == 9 for k in got)


def test_touch_log(tmp_path, spark):
    log = audit.TouchLog(tmp_path / "log.jsonl")
    with pytest.raises(PermissionError):
        log.check()
    log.unlock("one")
    log.unlock("two")
    log.check()
    log.verify()
    read = lambda: spark.read.json(str(tmp_path / "log.jsonl"))
    assert audit.chain_breaks(read(), audit.touch_hash()).count() == 0
    log.unlock("a self-test", "selftest")
    lines = (tmp_path / "log.jsonl").read_text().splitlines()
    assert {r["provenance"]: r["n"] for r in audit.touches(read()).collect()}["selftest"] == 1
    (tmp_path / "log.jsonl").write_text("\n".join([lines[0].replace('"reason": "', '"reason": "not '), *lines[1:]]) + "\n")  # changed, with its old hash
    assert [r["kind"] for r in audit.chain_breaks(read(), audit.touch_hash()).collect()] == ["content"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines[1:]) + "\n")  # the first is gone
    assert [r["kind"] for r in audit.chain_breaks(read(), audit.touch_hash()).collect()] == ["link"]
    lines = log.path.read_text().splitlines()
    log.path.write_text(lines[1] + "\n")
    with pytest.raises(ValueError):
        log.verify()
