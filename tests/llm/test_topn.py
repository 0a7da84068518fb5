import random

import numpy as np

from panelforge.llm.topn import LoserTree, merge_runs, merged_stretches, top_n

KIND = "g bigint, s double, a bigint, b bigint, run string"


def _want(rows, n):
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]), key=lambda r: (-r[1], -(1 << 62) if r[2] is None else r[2], -(1 << 62) if r[3] is None else r[3]))
        out += [(g, r[1], r[2], r[3], i + 1) for i, r in enumerate(own[:n])]
    return sorted(out, key=str)


def _got(df, n):
    return sorted(((r["group"], r["score"], r["a"], r["b"], r["rank"]) for r in top_n(df, "g", "s", ["a", "b"], n).collect()), key=str)


def test_equal_to_brute_force_with_ties_nulls_and_a_hot_group(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.choice([None, float("nan"), 1.0, 2.0, float(r.randrange(50))]), r.choice([None, *range(40)]), r.randrange(5), "x") for _ in range(900)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, KIND)
    for parts in (1, 6):
        assert _got(df.repartition(parts), 10) == _want(rows, 10)
    assert _got(df, 1) == _want(rows, 1)


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert top_n(df, "g", "s", ["a", "b"], 10).collect() == []


def test_loser_tree_merges():
    r = random.Random(2)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted((r.randrange(9), r.randrange(99), i) for _ in range(r.randrange(0, 12))) for i in range(k)]
        flat = sorted(x for run in runs for x in run)
        assert [x for x, _ in merge_runs(runs, 10**9)] == flat
        assert LoserTree([run[0] for run in runs if run] or []).k >= 1
        seen = {}
        want = [x for x in flat if seen.setdefault(x[0], []).append(x) or len(seen[x[0]]) <= 2]
        assert [x for x, _ in merge_runs(runs, 2)] == want


def test_stretches_that_cut_groups_and_runs(monkeypatch):
    """However a bucket is cut into stretches, the rows are those of one merge."""
    r = random.Random(3)
    for _ in range(40):
        rows = [(r.randrange(4), r.randrange(6), float(-r.randrange(30)), i) for i in range(r.randrange(1, 120))]  # group, run, -score, tie
        rows.sort()
        size, n = r.randrange(1, 40), r.randrange(1, 6)
        cuts = [([(g, s, t) for g, _, s, t in rows[i : i + size]], np.array([u for _, u, _, _ in rows[i : i + size]])) for i in range(0, len(rows), size)]
        got = [x for part in merged_stretches(cuts, n) for x in part]
        flat, seen = sorted((g, s, t) for g, _, s, t in rows), {}
        want = [(x, len(seen[x[0]])) for x in flat if seen.setdefault(x[0], []).append(x) or len(seen[x[0]]) <= n]
        assert got == want
    assert [x for part in merged_stretches([], 3) for x in part] == []
