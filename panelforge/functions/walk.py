"""A walk-forward run on one dense panel, for replications; the relational one is in operators.backtest."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from panelforge.functions import linalg


@dataclass(frozen=True)
class Rule:
    window: int = 104
    every: int = 4
    first: int = 104
    lag: int = 1
    smooth: int = 5
    trail: int = 12
    least: int = 6
    gamma: float = 1.0
    estimator: str = "nls"
    clusters: tuple[int, int] = (2, 20)
    k: int | None = None


#: Strategies: allocator and refit policy.
STRATEGIES = {
    "EW": ("ew", "never"),
    "ERC": ("erc", "never"),
    "MINVAR": ("minvar", "never"),
    "HRP_static": ("hrp", "never"),
    "HRP_periodic_3": ("hrp", "periodic:3"),
    "HRP_trigger": ("hrp", "trigger"),
}


class Estimate:
    """What all strategies share at a rebalance; its tree is made when a strategy fits one."""

    def __init__(self, at: int, assets: np.ndarray, cov: np.ndarray, spectrum: linalg.Spectrum, clusters: tuple[int, int]):
        self.at, self.assets, self.cov, self.spectrum, self.clusters = at, assets, cov, spectrum, clusters

    @cached_property
    def tree(self) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        distance = linalg.euclidean(self.spectrum.features())
        return distance, linalg.agglomerate(distance)

    @cached_property
    def order(self) -> list[int]:
        return linalg.optimal_order(*self.tree)

    @cached_property
    def labels(self) -> np.ndarray:
        return linalg.cut_tree(len(self.assets), self.tree[1], int(np.clip(self.spectrum.k, *self.clusters)))


def estimates(returns: np.ndarray, rule: Rule) -> list[Estimate]:
    """One covariance and spectrum per rebalance; assets that lack more than 5 % of the window are out."""
    out = []
    for t in range(rule.first, len(returns), rule.every):
        block = returns[t - rule.window + 1 : t + 1]
        ok = np.isfinite(block)
        assets = np.flatnonzero((ok.mean(axis=0) >= 0.95) & ok[-1])
        if len(block) < rule.window or len(assets) < 10:
            continue
        cov = linalg.ESTIMATORS[rule.estimator](np.where(ok, block, 0.0)[:, assets])
        out.append(Estimate(t, assets, cov, linalg.Spectrum(cov, rule.window, k=rule.k), rule.clusters))
    return out


def trigger(level: np.ndarray, rule: Rule, gamma: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(change, sigma, fired) of a series: trailing mean, its change, and the deviation of earlier changes."""
    n = len(level)
    sums = np.r_[0.0, np.cumsum(level)]
    low = np.maximum(np.arange(n) - rule.smooth + 1, 0)
    smooth = (sums[1:] - sums[low]) / (np.arange(n) + 1 - low)
    d = np.r_[np.nan, np.diff(smooth)]
    sigma = np.full(n, np.nan)
    for i in range(n):
        past = d[max(0, i - rule.trail) : i]
        past = past[np.isfinite(past)]
        if len(past) >= rule.least:
            sigma[i] = past.std(ddof=1)
    with np.errstate(invalid="ignore"):
        return d, sigma, np.abs(d) > (rule.gamma if gamma is None else gamma) * sigma


def held(block: np.ndarray, w: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Daily returns of a holding and its drifted weights: missing once, in cash from then on."""
    gone = np.logical_or.accumulate(~np.isfinite(block), axis=0)
    value = w * np.cumprod(np.where(gone, 1 + rate, 1 + np.nan_to_num(block)), axis=0)
    total = value.sum(axis=1) + (1 - w.sum()) * (1 + rate) ** np.arange(1, len(block) + 1)
    return total / np.r_[1.0, total[:-1]] - 1, np.where(gone[-1], 0.0, value[-1] / total[-1])


def weights_path(found: list[Estimate], fired: np.ndarray, allocator: str, policy: str) -> list[tuple[np.ndarray, bool]]:
    """Weights of each rebalance and whether the tree was fitted anew."""
    tree: list[int] = []
    labels: dict[int, int] = {}
    since, out = 0, []
    for i, e in enumerate(found):
        if allocator == "hrp":
            fit = not tree or (policy.startswith("periodic:") and since >= int(policy.split(":")[1])) or (policy == "trigger" and bool(fired[i]))
            if fit:
                order, since = e.order, 0
                tree = [int(e.assets[j]) for j in order]
                labels = {int(a): int(x) for a, x in zip(e.assets, e.labels)}
            else:
                order, since = linalg.inherited_order(tree, labels, [int(a) for a in e.assets], e.spectrum.features())[0], since + 1
            out.append((linalg.hierarchical_weights(e.cov, order), fit))
        elif allocator == "erc":
            out.append((linalg.equal_risk_weights(e.cov), False))
        elif allocator == "minvar":
            out.append((linalg.least_variance_weights(e.cov), False))
        else:
            out.append((np.full(len(e.assets), 1 / len(e.assets)), False))
    return out


def run(returns: np.ndarray, signal: np.ndarray, rule: Rule, strategies: tuple[str, ...], rate: float = 0.0, year: int = 52, bps: float = 10.0) -> dict[str, dict[str, float]]:
    """Sharpe ratio, mean turnover and refits of each strategy on one panel."""
    found = estimates(returns, rule)
    if not found:
        return {}
    seen = found if signal is returns else estimates(signal, rule)
    by_date = {e.at: e for e in seen}
    k = found[0].spectrum.k  # held for the whole run
    level = np.array([by_date.get(e.at, e).spectrum.absorption(k) for e in found])
    fired = trigger(level, rule)[2]
    out = {}
    for name in strategies:
        daily, moved, fits, last = [], [], 0, np.zeros(returns.shape[1])
        for i, (e, (w, fit)) in enumerate(zip(found, weights_path(found, fired, *STRATEGIES[name]))):
            begin = e.at + rule.lag
            end = found[i + 1].at + rule.lag if i + 1 < len(found) else len(returns)
            if begin >= end:
                continue
            whole = np.zeros(returns.shape[1])
            whole[e.assets] = w
            dw = np.abs(whole - last).sum()
            gross, drift = held(returns[begin:end][:, e.assets], w, rate)
            gross[0] = (1 + gross[0]) * (1 - dw * bps / 1e4) - 1
            last = np.zeros(returns.shape[1])
            last[e.assets] = drift
            daily.append(gross)
            moved.append(dw / 2)
            fits += fit
        r = np.concatenate(daily) - rate
        sd = r.std(ddof=1)
        out[name] = {"sharpe": float(r.mean() / sd * year**0.5) if sd > 0 else float("nan"), "turnover": float(np.mean(moved)), "refits": float(fits), "fired": float(fired.sum()), "eligible": float(len(found))}
    return out
