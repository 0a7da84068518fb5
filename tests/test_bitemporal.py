import datetime as dt
import random

from pyspark.sql import functions as F

from panelforge.operators import bitemporal as B

D0 = dt.date(2018, 1, 1)
N0 = (D0 - dt.date(1970, 1, 1)).days


def _winner(records, v, k):
    held = [r for r in records if r[0] <= v <= r[1] and r[2] <= k < r[3]]
    return max(held, key=lambda r: (r[4], r[5]))[5] if held else None


def test_disjoint_rectangles_cover_every_point_once():
    r = random.Random(1)
    for _ in range(60):
        records = []
        for i in range(r.randrange(1, 9)):
            v0, k0 = r.randrange(20), r.randrange(20)
            records.append((v0, v0 + r.randrange(12), k0, r.choice([B.TODAY + 1, k0 + r.randrange(1, 9)]), k0, i))
        rects = B.disjoint(records, probed_only=False)
        probed = B.disjoint(records)
        for v in range(-1, 34):
            for k in [*range(0, 31), B.TODAY]:
                hit = [x[4] for x in rects if x[0] <= v <= x[1] and x[2] <= k < x[3]]
                assert len(hit) <= 1
                assert (hit[0] if hit else None) == _winner(records, v, k)
            for k in (v, B.TODAY):
                hit = [x[4] for x in probed if x[0] <= v <= x[1] and x[2] <= k < x[3]]
                assert (hit[0] if hit else None) == _winner(records, v, k)


def test_as_known_equals_brute_force(spark):
    r = random.Random(2)
    day = lambda x: None if x is None else D0 + dt.timedelta(days=x)
    recs = []
    for i in range(120):
        v0, k0 = r.choice([None, *range(100)]), r.choice([None, *range(120)])
        recs.append((i, r.randrange(8), v0, None if v0 is None or r.random() < 0.2 else v0 + r.randrange(-3, 60), k0, None if r.random() < 0.6 else (k0 or 0) + r.randrange(50), r.randrange(4)))
    recs += [recs[3][:1] + recs[3][1:]] * 2  # repeated rows
    events = [(j, r.randrange(9), r.randrange(110)) for j in range(300)] + [(900, None, 5), (901, 1, None)]
    rf = spark.createDataFrame([(i, e, day(a), day(b), day(k), day(w), c) for i, e, a, b, k, w, c in recs], "id bigint, permno bigint, a date, b date, k date, w date, code int")
    ef = spark.createDataFrame([(j, e, day(d), "clash") for j, e, d in events], "obs_id bigint, permno bigint, date date, rects string")
    index = B.rectangle_index(rf, "permno", F.col("a"), F.col("b"), F.col("k"), F.col("w"), "id", ["code"], (N0, N0 + 120), cell_days=16)
    got = {x["obs_id"]: x for x in B.as_known(ef, "permno", "date", {"x": index}, cell_days=16).collect()}
    assert len(got) == len(events)
    for j, e, d in events:
        known = lambda k: [x for x in recs if e is not None and d is not None and x[1] == e and x[2] is not None and x[2] <= d and (x[3] is None or x[3] >= d) and k(x)]
        then = known(lambda x: x[4] is not None and x[4] <= d and (x[5] is None or x[5] > d))
        now = known(lambda x: x[5] is None)
        best = lambda s: max(s, key=lambda x: (-1 if x[4] is None else x[4], x[0])) if s else None
        for name, want in (("x_then", best(then)), ("x_now", best(now))):
            have = got[j][name]
            assert (have is None) == (want is None), (j, name)
            if want:
                assert (have["id"], have["code"]) == (want[0], want[6])


def test_empty(spark):
    rf = spark.createDataFrame([], "id bigint, permno bigint, a date, b date, k date, w date, code int")
    ef = spark.createDataFrame([(1, 1, D0)], "obs_id bigint, permno bigint, date date")
    index = B.rectangle_index(rf, "permno", F.col("a"), F.col("b"), F.col("k"), F.col("w"), "id", ["code"], (N0, N0 + 9))
    assert [x["x_then"] for x in B.as_known(ef, "permno", "date", {"x": index}).collect()] == [None]
    assert B.as_known(ef.limit(0), "permno", "date", {"x": index}).collect() == []


def test_a_hot_cell_is_small_before_it_is_split(spark):
    """Thousands of records of one entity and cell leave a bounded number of pieces, and the same answers."""
    r = random.Random(4)
    n, cell = 3000, 8
    recs = [(i, 1, r.randrange(8), r.randrange(8), r.randrange(-2000, 12), r.choice([None, r.randrange(-1990, 40)])) for i in range(n)]
    day = lambda x: None if x is None else D0 + dt.timedelta(days=x)
    low = (N0 // cell + 1) * cell - N0  # a cell begins here
    rf = spark.createDataFrame([(i, e, day(low + a), day(low + b), day(low + k), day(None if w is None else low + w)) for i, e, a, b, k, w in recs], "id bigint, permno bigint, a date, b date, k date, w date")
    index = B.rectangle_index(rf, "permno", F.col("a"), F.col("b"), F.col("k"), F.col("w"), "id", [], (N0 + low, N0 + low + 7), cell_days=cell)
    assert all(len(x["rects"]) <= 2 * cell for x in index.collect())
    ef = spark.createDataFrame([(d, 1, day(low + d)) for d in range(8)], "obs_id bigint, permno bigint, date date")
    for x in B.as_known(ef, "permno", "date", {"x": index}, cell_days=cell).collect():
        d = x["obs_id"]
        then = [(k, i) for i, _, a, b, k, w in recs if a <= d <= b and k <= d and (w is None or w > d)]
        now = [(k, i) for i, _, a, b, k, w in recs if a <= d <= b and w is None]
        for have, want in ((x["x_then"], then), (x["x_now"], now)):
            assert (None if have is None else have["id"]) == (max(want)[1] if want else None)
