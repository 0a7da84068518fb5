import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.operators.impute import KPrototypes, fill_missing
from panelforge.plans.dealt import fill_delistings
from panelforge.sources import table

KIND = "id bigint, x double, y double, kind string, code int, cluster_note string"
FOLDER = Path("/root/testdata/sf0.1")


def _rows(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        bad = i % 2 == 0
        out.append((i, r.gauss(-0.7 if bad else 0.05, 0.05), r.gauss(5 if bad else 1, 0.3), "f" if bad else "m", 560 if bad else 231, "x"))
    return out


def _fill(df, least=5, k=4):
    return fill_missing(df, {"x": "median", "code": "mode"}, KPrototypes(["x", "y"], {"kind": 1.0}, k=k), ["kind"], least)


def test_cells_are_filled_from_their_like_and_marked(spark):
    rows = _rows()
    gone = {7: "x", 8: "x", 21: "code", 22: "code"}
    rows = [(i, None if gone.get(i) == "x" else x, y, k, None if gone.get(i) == "code" else c, n) for i, x, y, k, c, n in rows]
    got = {r["id"]: r for r in _fill(spark.createDataFrame(rows, KIND)).collect()}
    assert len(got) == len(rows)
    for i, field in gone.items():
        assert got[i][f"{field}_method"] in ("cluster", "parent")
    assert got[8]["x_filled"] < -0.5 and got[7]["x_filled"] > -0.1
    assert got[22]["code_filled"] == 560 and got[21]["code_filled"] == 231
    assert all(r["x_method"] is None and r["x_filled"] == r["x"] for i, r in got.items() if gone.get(i) != "x")


def test_fallbacks(spark):
    rows = [(1, None, 1.0, "a", 1, None), (2, None, None, None, None, None), (3, 0.5, 1.0, "b", 1, None), (3, 0.5, 1.0, "b", 1, None)]
    got = [r["x_method"] for r in _fill(spark.createDataFrame(rows, KIND), least=50).orderBy("id").collect()]
    assert got == ["all", "all", None, None]
    rows = _rows(40) + [(100, None, None, "f", None, None), (101, None, None, None, None, None)]
    got = {r["id"]: r for r in _fill(spark.createDataFrame(rows, KIND), least=15, k=9).collect()}
    assert got[100]["x_method"] in ("cluster", "parent") and got[100]["x_filled"] < -0.5
    assert got[101]["x_method"] == got[101]["code_method"] == "all"
    none = spark.createDataFrame([(1, None, None, None, None, None)], KIND)
    assert [(r["x_method"], r["x_filled"]) for r in _fill(none).collect()] == [("none", None)]
    assert _fill(none.limit(0)).collect() == []


def test_small_clusters_fall_back_to_their_parent(spark):
    """A record of its own kind of y is a cluster of one; its x comes from all of its category."""
    rows = [*_rows(80), (500, None, 900.0, "f", None, None)]
    got = _fill(spark.createDataFrame(rows, KIND), k=12).where("id = 500").first()
    assert got["x_method"] == got["code_method"] == "parent" and got["x_filled"] < -0.5 and got["code_filled"] == 560


def test_records_that_lack_a_feature_take_part_and_join_their_kind(spark):
    """What a record lacks must not draw it to others that lack it too."""
    rows = _rows(400)
    rows = [(i, None if i % 10 in (0, 1) else x, y, k, c, n) for i, x, y, k, c, n in rows]
    model = KPrototypes(["x", "y"], {"kind": 6.0}, k=6)
    got = fill_missing(spark.createDataFrame(rows, KIND), {"x": "median"}, model, ["kind"]).where("x is null").collect()
    assert all(r["x_method"] == "cluster" and (r["x_filled"] < -0.5) == (r["kind"] == "f") for r in got) and len(got) == 80


def test_clusters_that_cannot_be_told_apart_fill_together(spark):
    """Two clusters of one kind differ in x alone; a record that lacks x gets the median of both, not of one of them."""
    rows = [(i, -1.0 if i % 3 else 1.0, 0.0, "a", 1, None) for i in range(90)] + [(200 + i, 0.1, 0.0, "b", 2, None) for i in range(30)] + [(900, None, 0.0, "a", None, None)]
    df = spark.createDataFrame(rows, KIND)
    model = KPrototypes(["x"], {"kind": 9.0}, k=3)
    got = fill_missing(df, {"x": "median"}, model, ["kind"]).where("id = 900").first()
    assert len(model.centres) == 3 and (got["x_method"], got["x_filled"]) == ("cluster", -1.0)
    shared = model.assign(df).where("id = 900").first()["near"]
    assert len(shared.split(",")) == 2


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
def test_hidden_cells_are_filled_better_than_from_their_parent(spark):
    """A tenth of the known values of each field is hidden, several times over; all draws count together."""
    delist = table(spark, str(FOLDER), "delist")
    error, parent_error, hits, parent_hits, methods = [], [], 0, 0, set()
    for seed in range(4):
        draw = F.pmod(F.xxhash64("delist_id", F.lit(seed)), F.lit(10))
        told = delist.withColumn("own_ret", F.when((F.col("dlret") >= -1) & (draw == 0), F.col("dlret"))).withColumn("own_code", F.when(F.col("dlstcd").between(100, 699) & (draw == 1), F.col("dlstcd")))
        told = told.withColumn("dlret", F.when(F.col("own_ret").isNull(), F.col("dlret"))).withColumn("dlstcd", F.when(F.col("own_code").isNull(), F.col("dlstcd")))
        out = fill_delistings(told).toPandas()
        median, mode = out.groupby("kind")["dlret"].median(), out[out["dlstcd"].notna()].groupby("size")["dlstcd"].agg(lambda x: x.mode().iloc[0])
        ret, code = out[out["own_ret"].notna()], out[out["own_code"].notna()]
        error += list((ret["dlret_filled"] - ret["own_ret"]).abs())
        parent_error += list((ret["kind"].map(median).fillna(out["dlret"].median()) - ret["own_ret"]).abs())
        hits += int((code["dlstcd_filled"] == code["own_code"]).sum())
        parent_hits += int((code["size"].map(mode).fillna(out["dlstcd"].mode().iloc[0]) == code["own_code"]).sum())
        methods |= set(ret["dlret_method"]) | set(code["dlstcd_method"])
    assert sum(error) < sum(parent_error) and hits > parent_hits
    assert {"cluster", "parent"} <= methods
    print(sum(error) / len(error), sum(parent_error) / len(error), hits, parent_hits)
