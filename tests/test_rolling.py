import datetime as dt
import random

import numpy as np
import pytest

from panelforge.operators.latest import valid_rows
from panelforge.operators.rolling import rolling_totals, two_stack

DAY0 = dt.date(2020, 1, 1)
DAILY = "entity bigint, day date, sum double, n bigint, max double, min double"


@pytest.mark.parametrize("width", [1, 2, 7, 30, 100])
def test_two_stack_equals_brute_force(width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=83)
    for op, identity, plain in ((np.add, 0.0, sum), (np.maximum, -np.inf, max), (np.minimum, np.inf, min)):
        want = [plain(x[max(0, i - width + 1) : i + 1]) for i in range(len(x))]
        assert np.allclose(two_stack(op, identity, x, width), want)


def _daily(rows):
    return [(e, DAY0 + dt.timedelta(days=d), s, n, s, s) for e, d, s, n in rows]


def test_days_without_activity_and_shards(spark):
    r = random.Random(3)
    rows = [(e, d, round(r.uniform(-1, 1), 6), 1) for e in (1, 2) for d in sorted(r.sample(range(90), 25))]
    rows.append((1, 400, 0.5, 1))  # a long halt, over several shards
    daily = spark.createDataFrame(_daily(rows), DAILY)
    bounds = daily.groupBy("entity").agg({"day": "min"}).withColumnRenamed("min(day)", "first").join(daily.groupBy("entity").agg({"day": "max"}).withColumnRenamed("max(day)", "last"), "entity")
    got = {(x["entity"], (x["day"] - DAY0).days): x for x in rolling_totals(daily, bounds, (7, 30), shard_days=16).collect()}
    known = {(e, d): s for e, d, s, _ in rows}
    for e in (1, 2):
        own = [d for ee, d, _, _ in rows if ee == e]
        for d in range(min(own), max(own) + 1):
            x = got.pop((e, d))
            for w in (7, 30):
                v = [known[e, k] for k in range(d - w + 1, d + 1) if (e, k) in known]
                assert x[f"n_{w}"] == len(v)
                assert x[f"sum_{w}"] == pytest.approx(sum(v), abs=1e-9)
                assert (x[f"avg_{w}"] is None) == (not v) and (x[f"max_{w}"] is None) == (not v)
                if v:
                    assert x[f"max_{w}"] == max(v) and x[f"min_{w}"] == min(v)
    assert not got


def test_empty_and_null_keys(spark):
    daily = spark.createDataFrame([(None, DAY0, 1.0, 1, 1.0, 1.0), (1, None, 1.0, 1, 1.0, 1.0)], DAILY)
    bounds = spark.createDataFrame([(None, DAY0, DAY0), (2, None, None)], "entity bigint, first date, last date")
    assert rolling_totals(daily, bounds).collect() == []
    assert rolling_totals(daily.limit(0), bounds.limit(0)).collect() == []


def test_valid_rows_take_the_latest_delivery(spark):
    t = [dt.datetime(2020, 1, 1, h) for h in range(3)]
    rows = [(1, 1, DAY0, t[0], 1, 0.1, "x"), (1, 1, DAY0, t[1], 2, None, "x"), (1, 2, DAY0, None, 3, 0.3, "x"), (1, 2, DAY0, None, 4, 0.4, "x"), (None, 1, None, t[0], 5, 0.5, "x")]
    df = spark.createDataFrame(rows, "permno bigint, lineno int, date date, loadts timestamp, obs_id bigint, ret double, v string")
    got = {(r["permno"], r["lineno"]): r["ret"] for r in valid_rows(df, "ret").collect()}
    assert got == {(1, 1): None, (1, 2): 0.4, (None, 1): 0.5}
