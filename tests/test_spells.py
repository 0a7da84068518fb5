import datetime as dt
import random

from pyspark.sql import functions as F

from panelforge.operators import spells

D0 = dt.date(2019, 1, 1)


def _brute(rows, tolerance=1):
    out = set()
    for e in {r[0] for r in rows}:
        covered = sorted({d for ee, a, b in rows if ee == e and a is not None and b is not None and a <= b for d in range(a, b + 1)})
        runs = []
        for d in covered:
            if runs and d <= runs[-1][1] + tolerance:
                runs[-1][1] = d
            else:
                runs.append([d, d])
        out |= {("period", e, a, b) for a, b in runs}
        out |= {("gap", e, x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])}
    return out


def _df(spark, rows):
    day = lambda x: None if x is None else D0 + dt.timedelta(days=x)
    return spark.createDataFrame([(e, day(a), day(b), "clash") for e, a, b in rows], "permno bigint, a date, b date, shard string")


def test_periods_and_gaps_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(r.randrange(6), (s := r.randrange(0, 400)), s + r.choice([0, 1, 3, 20, 150, -2])) for _ in range(90)] + [(1, None, 5), (2, 5, None), (3, 10, 10), (3, 11, 11), (3, 13, 13)] * 2
    for shard in (8, 64, 1024):
        got = spells.periods_and_gaps(_df(spark, rows), ["permno"], F.col("a"), F.col("b"), shard_days=shard)
        assert {(x["kind"], x["permno"], (x["startdt"] - D0).days, (x["enddt"] - D0).days) for x in got.collect()} == _brute(rows)


def test_tolerance_empty_and_null_entity(spark):
    rows = [(1, 0, 1), (1, 6, 7), (1, 13, 14)]
    got = spells.periods(_df(spark, rows), ["permno"], F.col("a"), F.col("b"), tolerance=5, shard_days=4)
    assert sorted(((x["startdt"] - D0).days, (x["enddt"] - D0).days) for x in got.collect()) == [(0, 7), (13, 14)]
    assert spells.periods(_df(spark, [(None, 0, 1)]), ["permno"], F.col("a"), F.col("b")).collect() == []
    assert spells.gaps(spells.periods(_df(spark, rows).limit(0), ["permno"], F.col("a"), F.col("b")), ["permno"]).collect() == []
