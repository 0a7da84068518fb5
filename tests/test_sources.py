import pytest
from pyspark.sql import functions as F

from panelforge.operators import audit
from panelforge.plans.extra_queries import RegionLocked, guard_region
from panelforge.sources import sinks, synthetic
from panelforge.sources.tables import conform


def test_scans_take_declared_columns_and_turn_nan_into_null(spark):
    df = spark.createDataFrame([(1, float("nan"), "x", 5)], "permno bigint, ret double, block string, obs_id int")
    row = conform(df, "dsf").first()
    assert row["ret"] is None and row["obs_id"] == 5 and row["cfacpr"] is None and "block" not in row.asDict()
    assert conform(df, "dsf", "permno", "loadts").columns == ["permno", "loadts"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_sinks_give_back_what_they_took(spark, kind):
    df = spark.createDataFrame([(1, None, 0.1, "a,b\"c"), (2, "2020-01-01", None, "é\tx")], "id bigint, d string, x double, s string")
    assert sorted(sinks.round_trip(df, kind).collect()) == sorted(df.collect())
    assert sinks.round_trip(df.limit(0), kind).collect() == []


def test_first_readable(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "b"))
    (tmp_path / "a").mkdir()
    assert sinks.first_readable(spark, [str(tmp_path / x) for x in ("none", "a", "b")]) == str(tmp_path / "b")
    assert sinks.first_readable(spark, [str(tmp_path / "none")]) is None


def test_synthetic_tables(spark, tmp_path):
    made = synthetic.tables(spark, "2019-01-01", "2019-12-31", pool=40, index=20)
    a = made["dsf"].agg(F.count("*"), F.bit_xor(F.xxhash64("permno", "date", "ret"))).first()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert made["dsf"].repartition(5).agg(F.count("*"), F.bit_xor(F.xxhash64("permno", "date", "ret"))).first() == a
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made["dsf"].groupBy("permno", "date").count().where("count > 1").isEmpty()
    assert made["delist"].join(made["dsf"], "permno", "left_anti").isEmpty()
    assert 0.005 < made["dsf"].agg(F.stddev("ret")).first()[0] < 0.06
    synthetic.write_tables(made, str(tmp_path / "out"))
    assert synthetic.is_synthetic(spark, str(tmp_path / "out")) and not synthetic.is_synthetic(spark, str(tmp_path))


def test_guard(spark):
    p = spark.createDataFrame([(1,), (9,)], "pos bigint")
    assert guard_region(p, 10) is p
    with pytest.raises(RegionLocked):
        guard_region(p, 9)


def test_numbers_against_expected_ones(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "name string, expected double")
    x = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("d", 1.0)], "name string, actual double")
    assert {r["name"]: r["status"] for r in audit.compared(e, x, 1e-9).collect()} == {"a": "PASS", "b": "FAIL", "c": "CHECK", "d": "CHECK"}
