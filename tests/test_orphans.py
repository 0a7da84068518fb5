import datetime as dt

from panelforge.operators import lookup, orphans

D = lambda m, d=1: dt.date(2020, m, d)
REC = "key bigint, valid date, known date, gone date"
REF = "row_id bigint, key bigint, day date, arrival date, reason string"


def _frames(spark):
    records = [(1, D(1), D(1), None), (2, D(1), D(1), D(5)), (2, D(2), D(2), D(6)), (3, D(4), D(1), None), (3, D(3), D(6), None), (4, None, None, None), (None, D(1), D(1), None), (5, D(1), D(9), None)]
    refs = [(10, 1, D(2), D(2), "x"), (11, 9, D(2), D(2), "x"), (11, 9, D(2), D(2), "x"), (12, 2, D(2), D(2), "x"), (13, 3, D(2), D(2), "x"), (14, 3, D(3), D(3), "x"), (15, 4, None, None, "x"), (16, None, D(1), D(1), "x"), (17, 5, D(2), D(8), "x"), (18, 5, D(2), D(9), "x")]
    return spark.createDataFrame(records, REC), spark.createDataFrame(refs, REF)


def test_reasons(spark):
    records, refs = _frames(spark)
    got = sorted((r["row_id"], r["reason"]) for r in orphans.orphan_rows(records, refs.drop("reason"), "row_id").collect())
    assert got == [(11, "missing"), (11, "missing"), (12, "withdrawn"), (13, "early"), (17, "late")]


def test_counts_of_deltas_merge_in_any_order(spark):
    records, refs = _frames(spark)
    whole = orphans.merge_counts(orphans.deltas(records, refs))
    late = orphans.merge_counts(orphans.merge_counts(orphans.deltas(records.limit(0), refs)), orphans.deltas(records, refs.limit(0)))
    assert sorted(map(str, whole.collect())) == sorted(map(str, late.collect()))
    assert {(r["key"], r["refs"], r["reason"]) for r in orphans.orphan_keys(whole).collect()} == {(9, 2, "missing"), (2, 1, "withdrawn")}


def _report(counts):
    return {(r["key"], r["refs"], r["reason"]) for r in orphans.orphan_keys(counts).collect()}


def test_late_withdrawals_late_records_and_removed_references(spark):
    """Counts are carried from load to load; each load brings deltas of either sign."""
    rec = lambda *keys: spark.createDataFrame([(k, D(1), D(1), None) for k in keys], REC)
    ref = lambda *keys: spark.createDataFrame([(i, k, D(2), D(2), "x") for i, k in enumerate(keys)], REF)
    counts = orphans.merge_counts(orphans.made(rec(1, 1, 2)), orphans.referred(ref(1, 2, 3, 3, 4)))
    assert _report(counts) == {(3, 2, "missing"), (4, 1, "missing")}
    counts = orphans.merge_counts(counts, orphans.withdrawn(rec(2, 1)), orphans.made(rec(3)))  # one of two records of 1, the only one of 2; 3 arrives late
    assert _report(counts) == {(2, 1, "withdrawn"), (4, 1, "missing")}
    counts = orphans.merge_counts(counts, orphans.removed(ref(4)), orphans.withdrawn(rec(1, 5)), orphans.referred(ref(5)))  # the withdrawal of 5 comes before its record
    assert _report(counts) == {(2, 1, "withdrawn"), (1, 1, "withdrawn"), (5, 1, "missing")}
    counts = orphans.merge_counts(counts, orphans.made(rec(5)), orphans.made(rec(2)))
    assert _report(counts) == {(1, 1, "withdrawn"), (5, 1, "withdrawn")}


def test_empty(spark):
    records, refs = _frames(spark)
    assert orphans.orphan_rows(records, refs.limit(0), "row_id").collect() == []
    assert {r["reason"] for r in orphans.orphan_rows(records.limit(0), refs.drop("reason"), "row_id").collect()} == {"missing"}


def test_lookup_join_salts_beyond_its_bound(spark):
    facts = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    for how in ("inner", "left"):
        a = sorted(map(str, lookup.lookup_join(facts, side, ["k"], how).select("k", "v", "name").collect()))
        b = sorted(map(str, lookup.lookup_join(facts, side, ["k"], how, rows=1).select("k", "v", "name").collect()))
        assert a == b
