"""Monte Carlo queries run at least the reference's replications."""

from pathlib import Path

import pytest

from panelforge.operators import replications
from panelforge.plans import block_queries, kernel_queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name,operator,want",
    [
        ("i93_null_matrix", "null_matrix", [500]),
        ("i95_gate", "null_matrix", [500]),
        ("i96_contrast", "null_matrix", [500]),
        ("i97_mechanism", "null_matrix", [500]),
        ("i69_placebo", "placebo_threshold", [100_000]),
        ("i80_density", "modal_share", [10_000]),
        ("i81_burstiness", "modal_share", [10_000]),
        ("i98_control", "modal_share", [10_000]),
        ("i83_size", "size_calibration", [2000, [600, 2000, 10_000]]),
        ("i84_power", "power_curve", [2000, 2000]),
        ("i85_bracket", "power_curve", [2000, 2000]),
    ],
)
def test_counts(spark, monkeypatch, name, operator, want):
    def asked(*args, **named):
        raise Asked([*args, *named.values()])

    monkeypatch.setattr(replications, operator, asked)
    with pytest.raises(Asked) as e:
        kernel_queries.QUERIES[name](spark, str(FOLDER))
    given = [x for x in e.value.args[0] if isinstance(x, (int, list))]
    assert all(w in given for w in want)


def test_all_resamples_of_means(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
    want = con.sql(kernel_queries.I77.replace("range(200)", "range(10000)")).df().sort_values("strategy").to_numpy().tolist()
    got = kernel_queries.i77_bootstrap_means_full(spark, str(FOLDER)).orderBy("strategy").select("strategy", "low", "high").toPandas().to_numpy().tolist()
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1:] for r in got] == [pytest.approx(r[1:], abs=1e-8) for r in want]


def test_all_resamples_of_the_shift(spark, monkeypatch):
    rows = spark.createDataFrame([(t, float(t % 7), t % 3 == 0) for t in range(30)], "t bigint, x double, fired boolean")
    monkeypatch.setattr(block_queries, "_structural", lambda *_: rows)
    assert kernel_queries.i73_bootstrap_full(spark, "").first()["kept"] > 9_900
