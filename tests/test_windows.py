"""Queries over all assets and every trailing window, against numpy and against the 13-asset block."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from panelforge.functions import linalg
from panelforge.operators import replications
from panelforge.plans import block_queries, registry, views
from panelforge.plans.block_queries import ALPHA

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
BLOCK_END = 101 + views.WINDOW - 1


@pytest.fixture(scope="module")
def real(spark):
    return replications.dense(views.asset_panel(spark, str(FOLDER)))


def _get(spark, name):
    every = name.endswith("_all") or not hasattr(block_queries, name)
    found = registry.queries()[name.removesuffix("_all")] if every else getattr(block_queries, name)
    return found(spark, str(FOLDER)).toPandas()


def _windows(real):
    for pos in range(views.WINDOW, len(real), views.EVERY):
        x = real[pos - views.WINDOW + 1 : pos + 1]
        held = np.isfinite(x).any(axis=0)
        yield pos, np.flatnonzero(held) + 1, np.nan_to_num(x[:, held])


@pytest.mark.parametrize(
    "name,kernel,column",
    [
        ("i11_covariance_all", linalg.sample_covariance, "s"),
        ("i12_linear_all", linalg.linear_shrinkage, "s"),
        ("i13_nonlinear", linalg.nonlinear_shrinkage, "s"),
        ("i19_decayed_all", lambda x: linalg.decayed_shrinkage(x, ALPHA), "s"),
        ("i20_equal_weights_all", lambda x: linalg.decayed_shrinkage(x, 1.0), "s"),
        ("i21_correlation_all", lambda x: linalg.correlation(linalg.sample_covariance(x)), "r"),
    ],
)
def test_all_assets_and_every_window(spark, real, name, kernel, column):
    got = {pos: g.pivot(index="i", columns="k", values=column) for pos, g in _get(spark, name).groupby("pos")}
    want = list(_windows(real))
    assert sorted(got) == [pos for pos, _, _ in want] and max(got) > len(real) - 1 - views.EVERY
    for pos, assets, x in want:
        assert list(got[pos].index) == list(assets)
        assert np.allclose(got[pos].to_numpy(), kernel(x), atol=2e-9)


def test_tree_weights_of_all_assets(spark, real):
    w, rc = _get(spark, "i35_hierarchical_all"), _get(spark, "i38_contributions_all")
    for pos, assets, x in _windows(real):
        cov = linalg.sample_covariance(x)
        want = linalg.hierarchical_weights(cov, list(range(len(assets))))
        assert np.allclose(w[w.pos == pos].sort_values("i")["w"], want, atol=2e-9)
        share = want * (cov @ want)
        assert np.allclose(rc[rc.pos == pos].sort_values("i")["rc"], share / share.sum(), atol=2e-8)


@pytest.mark.parametrize("name", ["c14_pairs", "i11_covariance", "i16_weighted", "i21_correlation", "i28_distance"])
def test_holds_the_block(spark, name):
    block, every = _get(spark, name), _get(spark, name + "_all")
    own = every[(every.pos == BLOCK_END) & (every.i <= 13) & (every.k <= 13)]
    both = block.merge(own, on=["i", "k"], suffixes=("", "_all"))
    assert len(both) == len(own) > 0
    c = [c for c in block.columns if c not in ("i", "k", "n")][0]
    assert np.allclose(both[c].astype(float), both[c + "_all"].astype(float), atol=1e-8)


@pytest.mark.parametrize("name", ["i15_effective_all", "i17_target_all", "i18_intensity_all", "i17_exact_pairs_all", "i36_equal_volatility_all", "i22_pairwise", "i24_bulk"])
def test_every_rebalance_has_rows(spark, real, name):
    got = _get(spark, name)
    assert sorted(got.pos.unique()) == [pos for pos, _, _ in _windows(real)]
    assert not got.isna().any().any() and isinstance(got, pd.DataFrame)
