import datetime as dt

import numpy as np

from panelforge.operators import forest, spikes
from panelforge.operators.spikes import judge, readings

D0 = dt.date(2019, 1, 1)
KIND = "obs_id bigint, permno bigint, lineno int, date date, ret double, prc double, shrout double, cfacpr double, cfacshr double, loadts timestamp, block string"


def _listing(permno, n=260, seed=0):
    rng = np.random.default_rng([permno, seed])
    days = [d for d in (D0 + dt.timedelta(days=i) for i in range(2 * n)) if d.weekday() < 5][:n]
    ret = rng.normal(0, 0.02, n)
    prc = np.round(20 * np.cumprod(1 + ret), 2)
    return [[permno * 10_000 + i, permno, 1, days[i], float(round(ret[i], 6)), float(prc[i]), 5000.0, 1.0, 1.0, dt.datetime.combine(days[i], dt.time(9)), "clash"] for i in range(n)]


def _found(spark, rows):
    return {(r["obs_id"], r["field"]) for r in readings(spark.createDataFrame(rows, KIND)).collect()}


def test_planted_readings_are_found_and_nothing_else(spark):
    rows = _listing(1)
    want = set()
    rows[50][5] *= 100  # decimal shift, one day
    want.add((rows[50][0], "prc"))
    for i in range(80, 83):
        rows[i][6] *= 10
        want.add((rows[i][0], "shrout"))
    rows[100][4] += 0.9
    want.add((rows[100][0], "ret"))
    for i in range(121, 135):
        rows[i][5] = rows[120][5]
        want.add((rows[i][0], "prc"))
    rows[150][4], rows[160][5], rows[170][6] = -66.0, 0.0, -99.0
    want |= {(rows[150][0], "ret"), (rows[160][0], "prc"), (rows[170][0], "shrout")}
    for i in range(200, 260):  # a split is no case, nor is a quote midpoint
        rows[i][5], rows[i][6], rows[i][7], rows[i][8] = round(rows[i][5] / 2, 4), 10000.0, 0.5, 0.5
    rows[210][5] *= -1
    rows[259][4], rows[259][5] = -0.6, rows[258][5] * 0.4  # a crash on the last day
    assert _found(spark, rows + _listing(2)) == want


def test_redeliveries_are_judged_each(spark):
    rows = _listing(3)
    again = list(rows[40])
    again[0], again[9] = 99, rows[40][9] + dt.timedelta(days=2)
    rows[40][5] *= 1000  # the first delivery was wrong, the second corrected it
    assert _found(spark, [*rows, again]) == {(rows[40][0], "prc")}


def test_blocks_of_time_change_nothing(spark):
    rows = _listing(4, n=1200)
    rows[600][5] *= 10
    for i in range(780, 800):
        rows[i][5] = rows[779][5]
    want = {(rows[600][0], "prc")} | {(rows[i][0], "prc") for i in range(780, 800)}
    assert _found(spark, rows) == want


def test_nulls_ties_and_empty(spark):
    rows = _listing(5, n=40)
    for i in range(5, 30):
        rows[i][4 + i % 5] = None
    rows += [[7, None, None, None, None, None, None, None, None, None, None], [8, 6, 1, D0, -2.0, 1.0, None, None, None, None, None]]
    assert _found(spark, rows) == {(8, "ret")}
    assert _found(spark, rows[:0]) == set()


def test_every_reading_is_scored_alike_however_rows_are_spread(spark):
    df = spark.createDataFrame(_listing(1, 60) + _listing(2, 70), KIND)
    a = sorted((r["obs_id"], r["field"], r["score"]) for r in readings(df.repartition(1), everything=True).collect())
    b = sorted((r["obs_id"], r["field"], r["score"]) for r in readings(df.repartition(7), everything=True).collect())
    assert len(a) == 3 * 130 and a == b


def test_forest_isolates_an_outlier():
    x = np.abs(np.random.default_rng(0).normal(size=(200, 3)))
    x[17] = 20
    every = np.ones(200, dtype=bool)
    s = forest.scores(x, np.array([0, 200]), np.array([5], dtype=np.uint64), every)
    assert s.argmax() == 17 and s[17] > 0.6 and np.sort(s)[-2] < 0.5 and ((s > 0) & (s < 1)).all()
    assert len(forest.scores(x[:0], np.array([0]), np.zeros(0, dtype=np.uint64), every[:0])) == 0
    both = forest.scores(np.r_[x, x], np.array([0, 200, 400]), np.array([9, 5], dtype=np.uint64), np.r_[every, ~every])
    assert (both[200:] == s).all()  # sources do not touch, and one without a row to draw is drawn from whole


def _swinging(permno, seed, n=300, share=0.25):
    """A listing that goes up and comes back again by habit, with one move beyond that."""
    rows, rng = _listing(permno, n, seed), np.random.default_rng([seed, 99])
    level = rng.normal(0, 0.01, n) + np.where(rng.random(n) < share, rng.uniform(0.26, 0.4, n), 0.0)
    level[149:152] = 0.0, 2.5, 0.0
    ret = np.r_[0.0, np.expm1(np.diff(level))]
    for i, row in enumerate(rows):
        row[5], row[4] = float(round(20 * np.exp(level[i]), 4)), float(ret[i])
    rows[150][4], rows[151][4] = 0.0, 0.0
    return rows


def _columns(rows):
    n = len(rows)
    day = np.array([(r[3] - dt.date(1970, 1, 1)).days for r in rows])
    values = {c: np.array([r[k] for r in rows], dtype=float) for k, c in ((4, "ret"), (5, "prc"), (6, "shrout"), (7, "cfacpr"), (8, "cfacshr"))}
    return values | {"source": np.zeros(n, dtype=np.int64), "key": np.full(n, 11, dtype=np.uint64), "date": day}


def test_the_forest_decides_what_is_odd(monkeypatch):
    """With constant scores the rows are others: the check alone takes habits for errors, and without odd readings there is none."""
    cases = [_columns(_swinging(1, seed)) for seed in range(12)]

    def flags():
        return [set(np.flatnonzero(judge(c)["prc"][1]).tolist()) for c in cases]

    own = flags()
    assert all(150 in f for f in own) and sum(map(len, own)) <= 30
    monkeypatch.setattr(spikes, "scores", lambda features, *rest: np.ones(len(features)))
    check_alone = flags()
    assert sum(map(len, check_alone)) > 20 * sum(map(len, own))
    monkeypatch.setattr(spikes, "scores", lambda features, *rest: np.zeros(len(features)))
    assert not any(flags())


def test_a_hot_listing_is_judged_in_parts_with_the_same_result(spark):
    """Deliveries of every date many times over, equal, corrected and wrong, in one listing that holds most rows."""
    rows, rng = _listing(1), np.random.default_rng(3)
    rows[50][5] *= 100
    for i in range(80, 86):
        rows[i][6] *= 10
    many = []
    for k in range(12):
        for i, row in enumerate(rows):
            again = list(row)
            again[0], again[9] = row[0] + 1_000_000 * (k + 1), row[9] + dt.timedelta(days=k + 1)
            if rng.random() < 0.02:
                again[int(rng.choice([4, 5, 6]))] *= 50
            many.append(again)
    df = spark.createDataFrame(rows + many + _listing(2, 60) + [[8, None, None, None, None, 0.0, None, None, None, None, None]], KIND)

    def found(hot):
        return sorted((r["obs_id"], r["field"], r["score"], r["flagged"]) for r in readings(df, everything=True, hot_rows=hot).collect())

    whole = found(10**9)
    assert len(whole) == 3 * (13 * 260 + 61) and whole == found(300)
    assert sum(f for *_, f in whole) > 100
