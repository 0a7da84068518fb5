"""Isolation forests of many small sources at once.

Every source (a group of adjacent rows) gets trees of its own. A tree cuts the
box of a source's features at random: a node draws a feature and a place in
its own cell. Features are in usual sizes of their source and the box reaches
up to ROOM of them, so the largest of ordinary readings is not isolated for
being the largest, nor is an odd one hidden behind one that is odder still. A
sample of the source's rows tells how full cells are; a reading is isolated at
the depth at which its cell holds at most one of them. All draws are hashes of
the source's key, so scores do not depend on how rows are spread over
partitions or chunks.
"""

from __future__ import annotations

import numpy as np

TREES, SAMPLE, DEPTH = 20, 128, 6
#: The height of a box; what lies beyond is as odd as it gets.
ROOM = 25.0


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread unsigned integers from any integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes."""
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def expected_path(n: np.ndarray) -> np.ndarray:
    """The mean depth of a search that fails among ``n`` leaves."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 2.0)
    out = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def scores(features: np.ndarray, cuts: np.ndarray, keys: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The anomaly score of every row, 0 to 1, against the forest of its own source.

    ``features``: rows by features, 0 to ROOM, without NaN. ``cuts``: where
    sources begin, then the number of rows. ``keys``: a hash per source.
    ``drawn``: the rows that a sample may hold; a source without any is sampled
    from all its rows.
    """
    n, width = features.shape
    if not n:
        return np.zeros(0)
    sources, nodes, inner = len(cuts) - 1, (1 << (DEPTH + 1)) - 1, (1 << DEPTH) - 1
    each = np.arange(sources)
    source = np.repeat(each, np.diff(cuts))
    lacking = np.add.reduceat(drawn.astype(np.int64), cuts[:-1]) == 0
    pool = np.flatnonzero(drawn | lacking[source])
    first = np.searchsorted(pool, cuts)
    base, flat, at_row = mixed(keys.astype(np.uint64)), np.ascontiguousarray(features, dtype=np.float32).ravel(), (np.arange(n) * width).astype(np.int32 if n * width < 1 << 31 else np.int64)
    longest = expected_path(np.arange(SAMPLE + 1)).astype(np.float32)
    origin = (source * inner).astype(np.int32 if sources * nodes < 1 << 31 else np.int64)
    leaves = 1 << DEPTH
    total = np.zeros(n, dtype=np.float32)
    for t in range(1, TREES + 1):
        with np.errstate(over="ignore"):
            tree = mixed(base + np.uint64(t * 1_000_003))
            draw = unit(mixed(tree[:, None] + np.arange(1, SAMPLE + 1, dtype=np.uint64) * np.uint64(7_919)))
            chance = mixed(tree[:, None] + np.arange(1, inner + 1, dtype=np.uint64) * np.uint64(104_729))
        feature, place = (chance % np.uint64(width)).astype(np.int32), unit(mixed(chance))
        split = np.empty((sources, inner), dtype=np.float32)
        low, high = np.zeros((nodes, sources, width), dtype=np.float32), np.full((nodes, sources, width), ROOM, dtype=np.float32)
        for node in range(inner):
            f = feature[:, node]
            a, b = low[node, each, f], high[node, each, f]
            split[:, node] = at = a + place[:, node] * (b - a)
            for child in (2 * node + 1, 2 * node + 2):
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, each, f] = at
            low[2 * node + 2, each, f] = at
        f, s = feature.ravel(), split.ravel()
        node = np.zeros(n, dtype=origin.dtype)
        for _ in range(DEPTH):
            here = origin + node
            node = 2 * node + 1 + (flat[at_row + f[here]] > s[here])
        leaf = source * leaves + (node - inner)
        # how full the leaves are, and from them the nodes above; a path ends at the first node with one sampled row or none
        sample = pool[(first[:-1, None] + draw * np.diff(first)[:, None]).astype(np.int64)].ravel()
        full = np.bincount(leaf[sample], minlength=sources * leaves).reshape(sources, leaves)
        path = DEPTH + longest[full]
        for depth in range(DEPTH - 1, 0, -1):
            wide = full.reshape(sources, 1 << depth, -1).sum(axis=2)
            over = np.repeat(wide, leaves >> depth, axis=1)
            path = np.where(over <= 1, np.float32(depth), path)
        total += path.ravel()[leaf]
    return np.exp2(-total.astype(np.float64) / TREES / float(longest[-1]))
