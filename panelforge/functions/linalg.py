"""Dense kernels on one window of returns: what relational algebra cannot express."""

from __future__ import annotations

import numpy as np

ROOT5 = 5.0**0.5


def sample_covariance(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=0)
    return centred.T @ centred / (len(x) - 1)


def nonlinear_shrinkage(x: np.ndarray) -> np.ndarray:
    """Analytical nonlinear shrinkage (Ledoit and Wolf, 2020), from the published formulas.

    The spectral density of the sample eigenvalues and its Hilbert transform
    are estimated with an Epanechnikov kernel of local bandwidth, and each
    eigenvalue is moved to its oracle value; eigenvectors stay.
    """
    n, p = len(x) - 1, x.shape[1]
    values, vectors = np.linalg.eigh(sample_covariance(x))
    null = max(0, p - n)
    lam = np.maximum(values[null:], 1e-300)
    width = n ** (-1 / 3)
    u = (lam[:, None] / lam[None, :] - 1) / width
    inside = 1 - u**2 / 5
    density = (0.75 / ROOT5 * np.maximum(inside, 0) / (width * lam)).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_part = inside * np.log(np.abs((ROOT5 - u) / (ROOT5 + u)))
    log_part = np.where(np.isfinite(log_part), log_part, 0.0)
    hilbert = ((-0.3 * u + 0.75 / ROOT5 * log_part) / (np.pi * width * lam)).mean(axis=1)
    if not null:
        ratio = p / n
        moved = lam / ((np.pi * ratio * lam * density) ** 2 + (1 - ratio - np.pi * ratio * lam * hilbert) ** 2)
    else:
        edge = (0.3 / width**2 + 0.75 / (ROOT5 * width) * (1 - 0.2 / width**2) * np.log((1 + ROOT5 * width) / (1 - ROOT5 * width))) / np.pi * (1 / lam).mean()
        lowest = n / (np.pi * (p - n) * edge)
        moved = np.r_[np.full(null, lowest), 1 / (np.pi**2 * lam * (density**2 + hilbert**2))]
    out = vectors @ (moved[:, None] * vectors.T)
    return (out + out.T) / 2


def linear_shrinkage(x: np.ndarray) -> np.ndarray:
    days, p = x.shape
    centred = x - x.mean(axis=0)
    s = centred.T @ centred / days
    mu, ss = np.trace(s) / p, (s**2).sum()
    far = ss - p * mu**2
    noise = ((centred**2).sum(axis=1) ** 2).sum() / days**2 - ss / days
    share = min(noise, far) / far if far > 0 else 0.0
    return (1 - share) * s + share * mu * np.eye(p)


def decayed_shrinkage(x: np.ndarray, alpha: float = 0.996) -> np.ndarray:
    """Exponentially weighted covariance (the last row heaviest) shrunk to equal correlations."""
    days, p = x.shape
    w = alpha ** np.arange(days - 1, -1, -1.0)
    w /= w.sum()
    y = x - w @ x
    s = (y.T * w) @ y
    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
    scale = np.outer(sd, sd)
    off = ~np.eye(p, dtype=bool)
    mean = (s / scale)[off].mean() if p > 1 else 0.0
    target = np.where(off, mean * scale, s)
    squares = (y.T**2 * w) @ y**2 - s**2
    cubes = (y.T**3 * w) @ y - np.diag(s)[:, None] * s
    rho = np.trace(squares) + mean * (cubes * (sd[None, :] / sd[:, None]))[off].sum()
    gap = ((target - s) ** 2).sum()
    delta = float(np.clip((squares.sum() - rho) / gap * (w**2).sum(), 0, 1)) if gap > 0 else 0.0
    return (1 - delta) * s + delta * target


ESTIMATORS = {"nls": nonlinear_shrinkage, "lw_linear": linear_shrinkage, "sample": sample_covariance, "ewma_cc": decayed_shrinkage}


def pairwise_factor(x: np.ndarray, shrink: float = 0.1) -> np.ndarray:
    """A square root of the covariance over pairwise complete rows, with a ridge and a floor."""
    ok = np.isfinite(x)
    z = np.where(ok, x, 0.0)
    n = ok.T.astype(float) @ ok
    sums = z.T @ ok  # of i over the rows that k has too
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (z.T @ z - sums * sums.T / n) / (n - 1)
    own = np.diag(s).copy()
    usual = np.nanmedian(own[np.isfinite(own) & (own > 0)]) if (np.isfinite(own) & (own > 0)).any() else 1.0
    own = np.where(np.isfinite(own) & (own > 0), own, usual)
    s = np.where(np.isfinite(s), s, 0.0)
    np.fill_diagonal(s, own)
    s = (1 - shrink) * (s + s.T) / 2 + shrink * np.diag(own)
    values, vectors = np.linalg.eigh(s)
    return vectors * np.sqrt(np.maximum(values, max(1e-12, 1e-8 * values[-1])))


def correlation(s: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(s))
    sd = np.where(sd > 0, sd, 1e-12)
    out = np.clip(s / sd[:, None] / sd[None, :], -1, 1)
    np.fill_diagonal(out, 1.0)
    return out


def noise_edge(ratio: float, variance: float = 1.0) -> float:
    """The upper edge of the Marchenko-Pastur law."""
    return variance * (1 + ratio**0.5) ** 2


def retained(values: np.ndarray, ratio: float, most_rounds: int = 50) -> tuple[float, int]:
    """Bulk variance and number of eigenvalues (descending) above the noise edge, at a fixed point."""
    tail = np.cumsum(values[::-1])[::-1] / np.arange(len(values), 0, -1)  # mean of what is left from each on
    variance, k = 1.0, -1
    for _ in range(most_rounds):
        above = min(int((values > noise_edge(ratio, variance)).sum()), len(values) - 1)
        if above == k:
            break
        k, variance = above, float(tail[above])
    return variance, max(k, 0)


class Spectrum:
    """Eigenvalues of the correlation and of the covariance, and the components kept."""

    def __init__(self, cov: np.ndarray, window: int, least: int = 1, k: int | None = None):
        p = len(cov)
        values, vectors = np.linalg.eigh(correlation(cov))
        self.values, self.vectors = values[::-1], vectors[:, ::-1]
        self.cov_values = np.linalg.eigvalsh(cov)[::-1]
        self.variance, found = retained(self.values, p / window)
        self.k = max(min(found if k is None else k, p - 1), least)

    def absorption(self, k: int | None = None) -> float:
        total = self.cov_values.sum()
        k = max(1, min(self.k if k is None else k, len(self.cov_values)))
        return float(self.cov_values[:k].sum() / total) if total > 0 else float("nan")

    def features(self, k: int | None = None) -> np.ndarray:
        k = self.k if k is None else k
        return self.vectors[:, :k] * np.sqrt(np.maximum(self.values[:k], 0))


def euclidean(points: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))
    np.fill_diagonal(d, 0.0)
    return d


def agglomerate(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by the Lance-Williams recurrence; cluster n + m is that of merge m."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, merges = list(range(n)), np.ones(n), []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        height = float(d[i, j])
        if method == "ward":
            total = size + size[i] + size[j]
            row = np.sqrt(np.maximum(((size + size[i]) * d[i] ** 2 + (size + size[j]) * d[j] ** 2 - size * height**2) / total, 0))
        elif method == "single":
            row = np.minimum(d[i], d[j])
        else:
            raise ValueError(f"unknown linkage {method!r}")
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        merges.append((name[i], name[j], height))
        name[i] = n + step
    return merges


def optimal_order(distance: np.ndarray, merges: list[tuple[int, int, float]]) -> list[int]:
    """The leaf order of a tree of least total distance between neighbours (Bar-Joseph and others, 2001).

    Of an order and its mirror the one that begins with the smaller leaf counts.
    """
    n = len(distance)
    if n == 1:
        return [0]
    leaves: dict[int, list[int]] = {i: [i] for i in range(n)}
    best: dict[int, np.ndarray] = {i: np.zeros((1, 1)) for i in range(n)}  # by left and right end
    for m, (a, b, _) in enumerate(merges):
        la, lb = leaves[a], leaves[b]
        # each left end of a with each right end of b: cheapest inner ends by two (min, +) products
        reach = np.stack([(best[a][u][:, None] + distance[np.ix_(la, lb)]).min(axis=0) for u in range(len(la))])
        joined = np.stack([(reach + best[b][:, w][None, :]).min(axis=1) for w in range(len(lb))], axis=1)
        whole = np.full((len(la) + len(lb),) * 2, np.inf)
        whole[: len(la), len(la) :] = joined
        whole[len(la) :, : len(la)] = joined.T
        leaves[n + m], best[n + m] = la + lb, whole

    def walk(node: int, left: int, right: int) -> list[int]:
        """The leaves of ``node`` from position ``left`` to position ``right`` of its list."""
        if node < n:
            return [node]
        a, b, _ = merges[node - n]
        na = len(leaves[a])
        if left >= na:
            return walk(node, right, left)[::-1]
        cost = best[a][left][:, None] + distance[np.ix_(leaves[a], leaves[b])] + best[b][:, right - na][None, :]
        i, j = divmod(int(cost.argmin()), cost.shape[1])
        return walk(a, left, i) + walk(b, j, right - na)

    root = n + len(merges) - 1
    left, right = divmod(int(best[root].argmin()), len(leaves[root]))
    order = walk(root, left, right)
    return order if order[0] < order[-1] else order[::-1]


def cut_tree(n: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """Labels 1, 2, ... of at most ``k`` clusters, numbered by their first leaf."""
    parent = list(range(n + len(merges)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for m, (a, b, _) in enumerate(merges[: max(0, n - k)]):
        parent[root(a)] = parent[root(b)] = n + m
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen) + 1) for i in range(n)])


def bisection_nodes(n: int) -> list[tuple[int, int, int]]:
    """(low, middle, high) of every split of a list of ``n`` leaves into halves."""
    out, todo = [], [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low > 1:
            middle = low + (high - low) // 2
            out.append((low, middle, high))
            todo += [(low, middle), (middle, high)]
    return sorted(out)


def hierarchical_weights(cov: np.ndarray, order: list[int], volatility: bool = False) -> np.ndarray:
    """Risk parity down the halves of a leaf order, by variance or by volatility."""
    own = np.maximum(np.diag(cov), 1e-16)
    inverse = 1 / np.sqrt(own) if volatility else 1 / own
    s, inv = cov[np.ix_(order, order)], inverse[list(order)]
    risk = inv[:, None] * s * inv[None, :]
    table = np.zeros((len(order) + 1,) * 2)
    table[1:, 1:] = risk.cumsum(axis=0).cumsum(axis=1)  # the risk of any stretch in four look-ups
    total = np.r_[0, inv.cumsum()]

    def of(low: int, high: int) -> float:
        block = table[high, high] - table[low, high] - table[high, low] + table[low, low]
        v = max(block, 0.0) / (total[high] - total[low]) ** 2
        return v**0.5 if volatility else v

    w = np.ones(len(order))
    for low, middle, high in bisection_nodes(len(order)):
        a, b = of(low, middle), of(middle, high)
        share = 1 - a / (a + b) if a + b > 0 else 0.5
        w[low:middle] *= share
        w[middle:high] *= 1 - share
    out = np.zeros(len(order))
    out[list(order)] = w / w.sum()
    return out


def equal_risk_weights(cov: np.ndarray, tolerance: float = 1e-12, rounds: int = 200) -> np.ndarray:
    """Equal risk contributions: damped Newton steps on half the variance less the mean log weight."""
    n = len(cov)
    x = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-16))
    x *= (x @ cov @ x) ** -0.5
    value = lambda y: 0.5 * y @ cov @ y - np.log(y).sum() / n
    for _ in range(rounds):
        slope = cov @ x - 1 / (n * x)
        step = np.linalg.solve(cov + np.diag(1 / (n * x**2)), slope)
        t = 1.0
        while (x - t * step <= 0).any() or value(x - t * step) > value(x) - 1e-4 * t * (slope @ step) + 1e-18:
            t /= 2
            if t < 1e-12:
                break
        x = x - t * step if t >= 1e-12 else x
        if np.abs(t * step).max() <= tolerance * np.abs(x).max():
            break
    return x / x.sum()


def least_variance_weights(cov: np.ndarray, long_only: bool = True) -> np.ndarray:
    """Weights of the pseudo-inverse, with negative ones cut afterwards (not the constrained optimum)."""
    n = len(cov)
    even = np.full(n, 1 / n)
    w = np.linalg.pinv(cov).sum(axis=1)
    if abs(w.sum()) <= 1e-16:
        return even
    w = w / w.sum()
    if long_only:
        w = np.maximum(w, 0)
        w = w / w.sum() if w.sum() > 0 else even
    return w


def inherited_order(tree: list[int], labels: dict[int, int], current: list[int], features: np.ndarray) -> tuple[list[int], list[int]]:
    """A fitted leaf order carried to today's assets.

    Assets that left are dropped; a newcomer takes its place behind the nearest
    survivor in today's coordinates and that one's label, of several behind one
    survivor the last first. Without survivors the order is today's.
    """
    at = {a: i for i, a in enumerate(current)}
    kept = [a for a in tree if a in at]
    if not kept:
        return list(range(len(current))), [1] * len(current)
    anchors: dict[int, list[int]] = {a: [] for a in kept}
    label = {a: labels[a] for a in kept}
    points = features[[at[a] for a in kept]]
    for a in current:
        if a not in label:
            near = kept[int(((points - features[at[a]]) ** 2).sum(axis=1).argmin())]
            anchors[near].insert(0, a)
            label[a] = label[near]
    order = [at[b] for a in kept for b in (a, *anchors[a])]
    return order, [label[a] for a in current]


def student_quantile(p: float, df: float) -> float:
    """The quantile of Student's t, by bisection on its distribution (a continued fraction)."""
    from math import exp, lgamma, log

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = exp(a * log(x) + b * log(1 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
        f = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f

    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -student_quantile(1 - p, df)
    low, high = 0.0, 1e6
    for _ in range(200):
        t = (low + high) / 2
        below = 1 - 0.5 * beta(df / 2, 0.5, df / (df + t * t))
        low, high = (t, high) if below < p else (low, t)
    return (low + high) / 2
