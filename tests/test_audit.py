from pathlib import Path

import pytest

from panelforge.plans import kernel_queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


def test_the_chain_holds_every_item(spark):
    items = spark.read.parquet(f"{FOLDER}/eval_items.parquet").count()
    assert kernel_queries.a12_jsonl(spark, str(FOLDER)).collect() == [(False, items)]
    assert sorted(tuple(r) for r in kernel_queries.i101_chain(spark, str(FOLDER)).collect()) == [(18, "link"), (30, "content")]


def test_the_manifest_lists_every_table(spark):
    got = {r["tab"]: r["n_rows"] for r in kernel_queries.i99_manifest(spark, str(FOLDER)).collect()}
    assert got == {p.stem: spark.read.parquet(str(p)).count() for p in FOLDER.glob("*.parquet")}
