"""Queries against their SQL on the smallest tables, where they are."""

from pathlib import Path

import pandas as pd
import pytest

from panelforge.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
duckdb = pytest.importorskip("duckdb")
NAMES = [
    "p1_rolling", "p2_found", "p4_found", "p4_report", "p4_state", "p5_found", "p5_asof", "p7_found", "c01_splice", "c04_crosswalk", "d16_coverage", "e08_spells", "i01_panel", "i12_linear", "i18_intensity", "i35_hierarchical", "i68_overlap",
    "i75_bounds", "i74_holm", "i77_bootstrap_means", "j1_sliding", "j4_online", "i29_clusters", "i37_equal_risk", "i43_ar_trigger", "i49_daily", "i49_moves", "h13_json", "a05_access", "i101_chain", "j2_sessions",
]


def _rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(str([None if pd.isna(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in row]) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, con, name):
    got = registry.queries()[name](spark, str(FOLDER)).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
