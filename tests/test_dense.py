import itertools

import numpy as np
import pytest

from panelforge.functions import environments, linalg, walk


def _panel(seed=0, days=600, n=80, k=3):
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(n, k))
    s = 0.02 * b @ b.T + np.diag(rng.uniform(0.5, 1.5, n))
    return rng.normal(size=(days, n)) @ np.linalg.cholesky(s).T, s


@pytest.mark.parametrize("days,n", [(600, 80), (60, 100)])
def test_estimators_are_definite_and_beat_the_sample(days, n):
    x, s = _panel(days=days, n=n)
    loss = {name: np.linalg.norm(f(x) - s) for name, f in linalg.ESTIMATORS.items()}
    assert loss["nls"] < loss["sample"] and loss["lw_linear"] < loss["sample"]
    for name, f in linalg.ESTIMATORS.items():
        out = f(x)
        assert np.allclose(out, out.T)
        if name != "sample":
            assert np.linalg.eigvalsh(out)[0] > 0


def test_noise_has_few_components_and_factors_are_found():
    x = np.random.default_rng(3).normal(size=(750, 100))
    assert linalg.Spectrum(linalg.sample_covariance(x), 750).k <= 2
    x, _ = _panel(k=5, days=900, n=100)
    assert 2 <= linalg.Spectrum(linalg.sample_covariance(x), 900).k <= 7


def test_optimal_order_is_optimal():
    for seed in range(4):
        d = linalg.euclidean(np.random.default_rng(seed).normal(size=(7, 2)))
        merges = linalg.agglomerate(d)

        def orders(node):
            if node < 7:
                return [[node]]
            a, b, _ = merges[node - 7]
            return [x + y for p, q in ((orders(a), orders(b)), (orders(b), orders(a))) for x, y in itertools.product(p, q)]

        cost = lambda o: sum(d[i, j] for i, j in zip(o, o[1:]))
        assert cost(linalg.optimal_order(d, merges)) == pytest.approx(min(map(cost, orders(12))))


def test_tree_weights_do_not_depend_on_column_order():
    x, _ = _panel(n=20)
    cov = linalg.sample_covariance(x)

    def weights(c):
        f = linalg.Spectrum(c, 600).features()
        d = linalg.euclidean(f)
        return linalg.hierarchical_weights(c, linalg.optimal_order(d, linalg.agglomerate(d)))

    p = np.random.default_rng(1).permutation(20)
    a, b = weights(cov)[p], weights(cov[np.ix_(p, p)])
    flipped = np.abs(a - b).max()  # a mirrored order of an even list gives the same halves
    assert flipped < 1e-8


def test_planted_blocks_are_recovered():
    rng = np.random.default_rng(2)
    f = rng.normal(size=(800, 2))
    x = np.hstack([f[:, [0]] + 0.3 * rng.normal(size=(800, 20)), f[:, [1]] + 0.3 * rng.normal(size=(800, 20))])
    s = linalg.Spectrum(linalg.sample_covariance(x), 800)
    labels = linalg.cut_tree(40, linalg.agglomerate(linalg.euclidean(s.features())), 2)
    assert len(set(labels[:20])) == len(set(labels[20:])) == 1 and labels[0] != labels[-1]


def test_equal_risk_and_least_variance():
    cov = linalg.sample_covariance(_panel(n=13)[0])
    w = linalg.equal_risk_weights(cov)
    rc = w * (cov @ w)
    assert np.abs(rc / rc.sum() - 1 / 13).max() < 1e-6
    assert np.allclose(linalg.equal_risk_weights(np.eye(5)), 0.2)
    m = linalg.least_variance_weights(cov)
    assert m.sum() == pytest.approx(1) and (m >= 0).all()


def test_decay_of_one_is_equal_weights():
    x, _ = _panel(days=200, n=10)
    a, b = linalg.decayed_shrinkage(x, 1 - 1e-9), linalg.decayed_shrinkage(x, 1.0)
    assert np.allclose(a, b, atol=1e-6)


def test_student_quantiles():
    assert linalg.student_quantile(0.95, 149) == pytest.approx(1.6551445338, abs=1e-8)
    assert linalg.student_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert linalg.student_quantile(0.05, 1) == pytest.approx(-6.3137515147, abs=1e-7)


def test_inherited_order_places_newcomers_behind_their_nearest():
    points = np.array([[0.0], [1.0], [0.1], [0.95], [0.12]])
    order, labels = linalg.inherited_order([10, 11, 99], {10: 1, 11: 2, 99: 3}, [10, 11, 12, 13, 14], points)
    assert [[10, 11, 12, 13, 14][i] for i in order] == [10, 14, 12, 11, 13]
    assert labels == [1, 2, 1, 2, 1]


@pytest.mark.parametrize("name", [*environments.ENVIRONMENTS, "timing"])
def test_environments_keep_missing_cells_and_seeds(name):
    x, _ = _panel(days=300, n=12)
    x[5:40, 3] = np.nan
    a, signal = environments.draw(name, x, 5)
    assert (np.isnan(a) == np.isnan(x)).all() and (np.isnan(signal) >= np.isnan(x)).all()
    assert np.array_equal(a, environments.draw(name, x, 5)[0], equal_nan=True)
    if name == "shuffle":
        raw = np.sort(x[50])
        assert np.allclose(np.sort(a[50] - a[50].mean()), raw - raw.mean(), atol=0.6)
    with pytest.raises(ValueError):
        environments.draw("none", x, 1)


def test_holding_equals_a_walk_over_days():
    rng = np.random.default_rng(7)
    block = rng.normal(0, 0.02, (9, 4))
    block[4:, 1] = np.nan
    block[6, 2] = np.nan  # comes back, stays in cash
    w, rate = np.array([0.4, 0.3, 0.2, 0.05]), 0.001
    cur, dead, want = w.copy(), np.zeros(4, bool), []
    for row in block:
        dead |= ~np.isfinite(row)
        alive = np.where(dead, 0, cur)
        cash = 1 - alive.sum()
        r = (alive * np.nan_to_num(row)).sum() + cash * rate
        want.append(r)
        cur = alive * (1 + np.nan_to_num(row)) / (1 + r)
    got, drift = walk.held(block, w, rate)
    assert np.allclose(got, want) and np.allclose(drift, cur)


def test_replication_runs_all_strategies():
    x = 0.01 * _panel(days=220, n=14)[0]
    out = walk.run(x, x, walk.Rule(estimator="lw_linear"), tuple(walk.STRATEGIES))
    assert set(out) == set(walk.STRATEGIES) and all(np.isfinite(v["sharpe"]) for v in out.values())
    assert out["HRP_static"]["refits"] == 1 and out["HRP_periodic_3"]["refits"] > out["HRP_static"]["refits"]
