"""Null environments: synthetic panels without an edge, the missing cells of the real one kept."""

from __future__ import annotations

import numpy as np

from panelforge.functions.linalg import pairwise_factor


def deviations(real: np.ndarray) -> np.ndarray:
    """Standard deviation per asset; the median one where it is unknown or zero."""
    with np.errstate(all="ignore"):
        sd = np.nanstd(real, axis=0, ddof=1)
    ok = np.isfinite(sd) & (sd > 0)
    return np.where(ok, sd, np.median(sd[ok]) if ok.any() else 1.0)


def _masked(x: np.ndarray, real: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(real), x, np.nan)


def iid_gaussian(real: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Independent normal returns of each asset's own deviation."""
    return _masked(rng.standard_normal(real.shape) * deviations(real), real)


def shuffled(real: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The returns of each date dealt anew among the assets that have one, then demeaned by asset."""
    ok = np.isfinite(real)
    seats = np.argsort(np.where(ok, np.arange(real.shape[1]), real.shape[1]), axis=1, kind="stable")
    cards = np.argsort(np.where(ok, rng.random(real.shape), np.inf), axis=1)
    out = np.full(real.shape, np.nan)
    np.put_along_axis(out, seats, np.take_along_axis(real, cards, axis=1), axis=1)
    out = _masked(out, real)
    with np.errstate(all="ignore"):
        return out - np.nanmean(out, axis=0)


def shifted_signal(real: np.ndarray, rng: np.random.Generator, least: int = 252) -> np.ndarray:
    """The same panel moved around the calendar by a random shift: a signal without its timing."""
    days = len(real)
    by = int(rng.integers(least, days - least)) if days - least > least else days // 2
    return _masked(np.concatenate([real[-by:], real[:-by]]), real)


def regime_path(days: int, stay: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """A two-state path that begins in state 0, from the lengths of its stays."""
    out, state, at = np.zeros(days, dtype=int), 0, 0
    while at < days:
        length = int(rng.geometric(1 - stay[state]))
        out[at : at + length] = state
        at, state = at + length, 1 - state
    return out


def regime_switching(real: np.ndarray, rng: np.random.Generator, stay: tuple[float, float] = (0.99, 0.97), factors: int = 3, volatility: float = 2.5, loading: float = 1.4) -> np.ndarray:
    """Volatility and common moves rise together in the second state; means are zero in both."""
    days, assets = real.shape
    high = regime_path(days, stay, rng)[:, None] == 1
    scale, load = np.where(high, volatility, 1.0), np.where(high, loading, 1.0)
    beta = rng.standard_normal((factors, assets))
    x = 0.35 * load * scale * (rng.standard_normal((days, factors)) @ beta) + scale * rng.standard_normal(real.shape)
    x *= deviations(real) / x.std(axis=0)
    return _masked(x - x.mean(axis=0), real)


def static_correlation(real: np.ndarray, rng: np.random.Generator, factor: np.ndarray | None = None) -> np.ndarray:
    """Independent dates of one fixed covariance, fitted once."""
    factor = pairwise_factor(real) if factor is None else factor
    return _masked(rng.standard_normal(real.shape) @ factor.T, real)


SLOW = (0.999, 0.9985)
ENVIRONMENTS = {
    "gaussian": iid_gaussian,
    "shuffle": shuffled,
    "regimes": regime_switching,
    "slow_regimes": lambda real, rng: regime_switching(real, rng, stay=SLOW),
    "static": static_correlation,
}


def draw(name: str, real: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(returns, signal) of an environment, by name and seed."""
    rng = np.random.default_rng(seed)
    if name == "timing":
        return real, shifted_signal(real, rng, least=max(1, len(real) // 4))
    if name not in ENVIRONMENTS:
        raise ValueError(f"unknown environment {name!r}; there are timing, {', '.join(sorted(ENVIRONMENTS))}")
    x = ENVIRONMENTS[name](real, rng)
    return x, x
