"""Queries without SQL take the last position and the eligible ones from the panel."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.operators import replications
from panelforge.plans import block_queries, kernel_queries, views

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


def test_eligible_positions_follow_the_calendar(spark, monkeypatch):
    series = spark.range(500).select(F.lit(0).alias("run"), F.col("id").alias("pos"), F.sin(F.col("id") * F.col("id")).alias("x"))
    monkeypatch.setattr(views, "total_value", lambda *_: series)
    asked = []
    monkeypatch.setattr(replications, "placebo_threshold", lambda spark, size, *rest: asked.append(size))
    monkeypatch.setattr(replications, "modal_share", lambda spark, size, *rest, **named: asked.append(size))
    kernel_queries.i69_placebo(spark, "")
    kernel_queries.i80_density(spark, "")
    assert asked == [493, 493]  # six changes must be known before


def test_rebalances_reach_the_end_of_the_panel(spark):
    p, marks, _ = block_queries._snapshot(spark, str(FOLDER))
    last = views.last_position(p)
    assert last - views.EVERY < max(r["pos"] for r in marks.collect()) <= last
