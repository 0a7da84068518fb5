"""Implausible spikes, stuck values and impossible readings per source.

Every reading gets the score of an isolation forest of its own source, on its
level (distance from the median of its neighbours), difference (to the reading
before), season (distance from the readings four weeks before and after; for a
return, what the prices leave unexplained) and run length, all in sizes usual
for the source. A reading that cannot exist comes out by explicit limits. One
that the forest finds odd comes out if an exact check tells what is wrong with
it: the level leaves its course and returns within some weeks, or the change
contradicts the other field, or the value sticks. The check asks little of the
size of a move; how far is far for a source is what the forest decides.

Scale: a source is cut into blocks of time, each with a margin of days on both
sides as context, and deliveries of a block beyond a bound are judged in parts,
so a source with a third of all rows is several tasks. Rows move once. All work on a chunk of sources is on arrays.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.arrowgroups import complete_groups, integers, numbers, starts
from panelforge.operators.forest import ROOM, mixed, scores
from panelforge.session import cut

BLOCK_DAYS, MARGIN_DAYS = 1096, 90
#: The score from which a reading is odd for its source and is checked.
SUSPECT = 0.5
#: The least size of a change, in logs, that counts as usual.
TINY = 0.01
#: Rows of a source and block from which its deliveries are judged in several parts.
HOT_ROWS = 200_000
#: Dates that a stuck value lasts at least, and share of repeats that is normal for a source.
STUCK_DATES, OFTEN = 12, 0.2
#: Dates that a source must have to be judged by its own behaviour.
LEAST_DATES = 8
#: Dates and days within which a level must come back.
BACK_DATES, BACK_DAYS = 45, 70


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.where(x > 0, x, np.nan))


class Series:
    """The valid readings of a chunk: one per source and date, in order."""

    def __init__(self, source: np.ndarray, date: np.ndarray):
        self.cuts = starts(source, date)[1:] - 1 if len(source) else np.zeros(0, dtype=np.int64)
        self.at = self.cuts  # the row of each date's last delivery
        self.of = np.repeat(np.arange(len(self.at)), np.diff(np.r_[-1, self.at]))  # row to date
        self.source, self.date = source[self.at], date[self.at]
        bounds = starts(self.source)
        self.bounds = bounds
        self.first = np.repeat(bounds[:-1], np.diff(bounds))
        self.after = np.repeat(bounds[1:], np.diff(bounds))

    def before(self, ok: np.ndarray) -> np.ndarray:
        """The last earlier date of the source for which ``ok`` holds, or -1."""
        pos = np.maximum.accumulate(np.where(ok, np.arange(len(ok)), -1))
        out = np.r_[-1, pos[:-1]]
        return np.where(out >= self.first, out, -1)

    def next(self, ok: np.ndarray) -> np.ndarray:
        """The first later date of the source for which ``ok`` holds, or -1."""
        n = len(ok)
        pos = np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1]
        out = np.r_[pos[1:], n]
        return np.where(out < self.after, out, -1)


def filled(x: np.ndarray, series: Series) -> np.ndarray:
    """Per date, the value of the source carried forward, then back; 0 where it has none."""
    ok = ~np.isnan(x)
    back, ahead = series.before(ok), series.next(ok)
    return np.where(ok, x, np.where(back >= 0, x[back], np.where(ahead >= 0, x[ahead], 0.0)))


def spread(x: np.ndarray, source: np.ndarray, sources: int) -> np.ndarray:
    """1.4826 times the median of abs(x) per source, 0 for none."""
    ok = ~np.isnan(x)
    a, s = np.abs(x[ok]), source[ok]
    a = a[np.lexsort((a, s))]
    n = np.bincount(s, minlength=sources)
    end = np.cumsum(n)
    out = np.zeros(sources)
    some = n > 0
    out[some] = a[(end - n + (n - 1) // 2)[some]]
    return 1.4826 * out


def excursions(x: np.ndarray, series: Series, least: np.ndarray, change: np.ndarray | None) -> np.ndarray:
    """Dates whose level ``x`` leaves that before by more than ``least`` and comes back.

    At either end of a source, where a return can't be seen, a level counts if
    ``change`` (what another field says of the move) contradicts it.
    """
    bad = np.zeros(len(x), dtype=bool)
    c = np.flatnonzero(~np.isnan(x))
    if not len(c):
        return bad
    xc, sc, dc = x[c], series.source[c], series.date[c]
    step = np.diff(xc)
    jumps = np.flatnonzero((sc[1:] == sc[:-1]) & (np.abs(step) > least[c[1:]])) + 1
    low, high = np.searchsorted(sc, sc, "left"), np.searchsorted(sc, sc, "right")
    out = np.zeros(len(c), dtype=bool)
    for j in jumps.tolist():
        if out[j]:
            continue
        lo, hi = int(low[j]), int(high[j])
        past = xc[max(lo, j - 8) : j][~out[max(lo, j - 8) : j]]
        if not len(past):
            continue
        base = float(np.median(past[-3:]))
        jump = xc[j] - base
        if abs(jump) <= least[c[j]]:
            continue
        end = min(hi, j + BACK_DATES)
        ahead = xc[j + 1 : end]
        turned = -step[j : end - 1] * np.sign(jump) > 0.5 * abs(jump)  # at once, as it left
        back = np.flatnonzero(turned & (np.abs(ahead - base) < 0.35 * abs(jump)) & (dc[j + 1 : end] - dc[j] <= BACK_DAYS))
        if len(back):
            out[j : j + 1 + int(back[0])] = True
            continue
        told = change[c[j]] if change is not None else (0.0 if abs(jump) > 2 else np.nan)
        if np.isnan(told) or abs(told - step[j - 1]) < 0.5 * abs(step[j - 1]):
            continue
        if hi - j <= 25 and hi - j < j - lo:
            out[j:hi] = True
        elif j - lo <= 25 and j - lo < hi - j:
            out[lo:j] = True
    bad[c[out]] = True
    return bad


def runs(x: np.ndarray, series: Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per date: dates that its run of equal values has, whether it repeats the one before, both over values only; and the share of repeats normal for its source."""
    length, repeats, often = np.zeros(len(x)), np.zeros(len(x), dtype=bool), np.zeros(len(x))
    c = np.flatnonzero(~np.isnan(x))
    if not len(c):
        return length, repeats, often
    xc, sc = x[c], series.source[c]
    again = np.r_[False, (sc[1:] == sc[:-1]) & (xc[1:] == xc[:-1])]
    run = np.cumsum(~again) - 1
    size = np.bincount(run)[run]
    length[c], repeats[c] = size, again
    usual = size < STUCK_DATES
    sources = int(series.source.max()) + 1
    n, r = np.bincount(sc[usual], minlength=sources), np.bincount(sc[usual & again], minlength=sources)
    often[:] = (r / np.maximum(n, 1))[series.source]
    return length, repeats, often


def _features(x: np.ndarray, run: np.ndarray, rows: np.ndarray, series: Series, own: np.ndarray, gap: np.ndarray | None = None) -> np.ndarray:
    """Level, difference, season and run length of every row's reading ``own``, in usual sizes of its source, 0 where unknown.

    ``x``: the valid readings by date, which alone tell what is usual. ``gap``
    takes the place of the season. A run is in logs, at ROOM from STUCK_DATES on.
    """
    n = len(x)
    at = np.arange(n)

    def shifted(by: int) -> np.ndarray:
        to = at + by
        ok = (to >= series.first) & (to < series.after)
        return np.where(ok, x[np.clip(to, 0, n - 1)], np.nan)

    near = np.sort(np.stack([shifted(b) for b in (-45, -32, -19, -6, 6, 19, 32, 45)]), axis=0)
    held = (~np.isnan(near)).sum(axis=0)
    level = near[np.clip((held - 1) // 2, 0, 7), at]
    prior = series.before(~np.isnan(x))
    last = np.where(prior >= 0, x[prior], np.nan)
    early, late = shifted(-20), shifted(20)
    month = np.where(np.isnan(early), late, np.where(np.isnan(late), early, (early + late) / 2))
    season = np.abs(own - month[rows]) if gap is None else np.abs(gap)
    out = np.stack([np.abs(own - level[rows]), np.abs(own - last[rows]), season, np.log(np.maximum(run, 1))[rows]], axis=1)
    out = np.nan_to_num(out, nan=0.0, posinf=0.0)
    sources, source = int(series.source.max()) + 1, series.source
    for k in range(3):
        out[:, k] /= np.maximum(spread(out[series.at, k], source, sources), TINY)[source[rows]]
    out[:, 3] *= ROOM / np.log(STUCK_DATES)
    return np.minimum(out, ROOM)


def judge(cols: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``judged`` after equal deliveries of a date that follow each other are made one, as they share its result."""
    n = len(cols["date"])
    fresh = np.ones(n, dtype=bool)
    if n > 1:
        fresh[1:] = False
        for x in cols.values():
            fresh[1:] |= (x[1:] != x[:-1]) & ~((x[1:] != x[1:]) & (x[:-1] != x[:-1]))
    if fresh.all():
        return judged(cols)
    back = np.cumsum(fresh) - 1
    return {field: (score[back], flag[back]) for field, (score, flag) in judged({c: x[fresh] for c, x in cols.items()}).items()}


def judged(cols: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per field, the score of every row's reading and whether it is implausible.

    ``cols``: source (0, 1, ... ascending), key (a hash per row's source), date,
    and the fields, ordered by source, date and arrival.
    """
    source, date = cols["source"], cols["date"]
    s = Series(source, date)
    at, rows, sources = s.at, s.of, int(source.max()) + 1
    cuts = starts(source)
    keys = cols["key"][cuts[:-1]].astype(np.uint64)
    ret, prc, shrout = cols["ret"], cols["prc"], cols["shrout"]
    pf = filled(_log(cols["cfacpr"])[at], s)
    raw = _log(cols["cfacshr"])[at]
    sf = np.where(np.isnan(raw), pf, raw)
    price = _log(np.abs(prc)) - pf[rows]
    shares = _log(shrout) + sf[rows]
    move = np.log1p(np.where(ret > -1, ret, np.nan))
    pv, sv, mv = price[at], shares[at], move[at]
    ok_p = ~np.isnan(pv)
    prior = s.before(ok_p)
    step = np.where(prior >= 0, pv - pv[prior], np.nan)
    usual_p = spread(step, s.source, sources)[s.source]
    least_p = np.maximum(5 * usual_p, 0.25)
    least_s = np.full(len(at), 0.1)

    def outside(own: np.ndarray, x: np.ndarray, bad: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows that leave the sound levels before and after alike, or share the reading of a bad date."""
        sound = ~bad & ~np.isnan(x)
        b, a = s.before(sound), s.next(sound)
        low, high = np.where(b >= 0, x[b], np.nan)[rows], np.where(a >= 0, x[a], np.nan)[rows]
        off = own - low
        far = (np.abs(off) > least[rows]) & (np.abs(own - high) > least[rows]) & (np.abs(high - low) < 0.35 * np.abs(off))
        same = bad[rows] & (np.abs(own - x[rows]) < 0.2)
        return far | same

    bad_p = excursions(pv, s, least_p, mv)
    bad_s = excursions(sv, s, least_s, None)
    out_p, out_s = outside(price, pv, bad_p, least_p), outside(shares, sv, bad_s, least_s)

    held = np.abs(prc[at])
    run_p, again_p, often_p = runs(np.where(held > 0, held, np.nan), s)
    run_r, again_r, often_r = runs(np.where(ret[at] == 0, np.nan, ret[at]), s)
    stuck_p = again_p & (run_p >= STUCK_DATES) & (often_p < OFTEN)
    stuck_r = again_r & (run_r >= STUCK_DATES) & (often_r < OFTEN)
    held_p = stuck_p[rows] & (np.abs(prc) == held[rows])
    held_r = stuck_r[rows] & (ret == ret[at][rows])

    # what the sound prices say of each date's return
    sound = ok_p & ~bad_p & ~stuck_p
    here = np.where(sound, np.arange(len(at)), s.next(sound))
    back = s.before(sound)
    known = (here >= 0) & (back >= 0)
    span = np.where(known, here - back, 1)
    halted = known & (s.date[here] - s.date[back] > 4 * span + 6)
    told = np.where(known, (pv[here] - pv[back]) / span, 0.0)
    gap = move - told[rows]
    # after a halt a return may be that of one date or that of the whole halt
    gap = np.where(halted[rows] & (np.abs(move) < np.abs(gap)), move, gap)
    usual_r = spread(mv, s.source, sources)[s.source]
    least_r = np.clip(6 * usual_r, 0.12, 0.3)
    least_r = np.where(known, np.where((span > 1) | halted, 1.5 * least_r, least_r), np.maximum(least_r, 0.6))
    last = np.arange(len(at)) == s.after - 1
    out_r = (np.abs(gap) > least_r[rows]) & ~((last & ~ok_p)[rows] & (ret < 0))

    normal = (s.after - s.first >= LEAST_DATES)[rows]  # fewer dates show no behaviour to depart from
    none, valid = np.zeros(len(at)), np.zeros(len(source), dtype=bool)
    valid[at] = True
    result = {}
    for name, own, x, run, drawn, found, limit in (
        ("ret", ret, ret[at], run_r, valid & ~again_r[rows], out_r | held_r, ret < -1),
        ("prc", price, pv, run_p, valid & ~again_p[rows], out_p | held_p, prc == 0),
        ("shrout", shares, sv, none, valid, out_s, shrout <= 0),
    ):
        features = _features(x, run, rows, s, own, gap if name == "ret" else None)
        goes_on = (features[:, 0] == ROOM) & (features[:, 1] < 4)
        score = scores(features, cuts, keys, drawn & ~goes_on)  # of a run, or a stay at an odd level, one date is drawn: it is odd however long it lasts
        result[name] = (score, limit | (found & normal & (score >= SUSPECT)))
    return result


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    keys = [integers(table, c, -(1 << 62)) for c in ("permno", "lineno", "block", "part")]
    cuts = starts(*keys)
    source = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    with np.errstate(over="ignore"):  # parts of a group share their trees
        key = mixed(keys[0].astype(np.uint64)) ^ mixed(keys[1].astype(np.uint64) + np.uint64(77)) ^ mixed(keys[2].astype(np.uint64) + np.uint64(991))
    cols = {c: numbers(table, c) for c in ("ret", "prc", "shrout", "cfacpr", "cfacshr")}
    return cols | {"source": source, "key": key, "date": integers(table, "date")}


GROUP = ["permno", "lineno", "block", "part"]


def _kernel(everything: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, GROUP):
            with np.errstate(all="ignore"):
                result = judge(_arrays(table))
            own = integers(table, "own").astype(bool)
            obs = integers(table, "obs_id")
            for field, (score, flag) in result.items():
                at = own if everything else own & flag
                if not at.any():
                    continue
                columns = [pa.array(obs[at]), pa.array([field]).take(pa.array(np.zeros(int(at.sum()), dtype=np.int32))), pa.array(score[at])]
                names = ["obs_id", "field", "score"]
                if everything:
                    columns.append(pa.array(flag[at]))
                    names.append("flagged")
                yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=65536)

    return run


def _parts(rows: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with a part, 0 but for groups of more than ``hot_rows`` rows.

    A reading depends on the valid deliveries of its group and on itself, so
    the deliveries of a hot group are spread over parts, each of which also
    gets the valid deliveries as context.
    """
    key = GROUP[:3]
    hot = cut(rows.groupBy(*key).count().where(F.col("count") > hot_rows).select(*key, F.ceil(F.col("count") / hot_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0))
    told = hot.select(*(F.col(k).alias(f"hot_{k}") for k in key), "parts")
    match = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in key))
    marked = rows.join(told, match, "left").drop(*(f"hot_{k}" for k in key))
    spread_ = marked.withColumn("part", F.coalesce(F.pmod(F.xxhash64("obs_id"), "parts"), F.lit(0)).cast("int")).drop("parts")
    held = [c for c in rows.columns if c not in (*key, "own", "date")]
    latest = marked.where("parts is not null").groupBy(*key, "date", "parts").agg(F.max(F.struct("loadts", "obs_id", *(c for c in held if c not in ("loadts", "obs_id")))).alias("v"))
    context = latest.select(*key, "date", *(F.col(f"v.{c}").alias(c) for c in held), F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return spread_.unionByName(context)


def readings(dsf: DataFrame, everything: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Implausible readings of a daily file: obs_id, field ('ret', 'prc', 'shrout'), score.

    With ``everything`` each reading comes out, with its score and ``flagged``.
    Every delivery is judged against the valid deliveries of its listing
    (permno, lineno). Missing values are never flagged. Rows with a null date
    or key form listings of their own; a listing with a single row can only
    break a physical limit.
    """
    day = F.coalesce(F.unix_date("date"), F.lit(0))
    block = lambda d: F.floor(d / BLOCK_DAYS).cast("int")
    low, high = block(day - MARGIN_DAYS), block(day + MARGIN_DAYS)
    values = ["ret", "prc", "shrout", "cfacpr", "cfacshr"]
    rows = dsf.select("permno", "lineno", "obs_id", "date", *values, "loadts", block(day).alias("home"), F.explode(F.sequence(low, high)).alias("block")).withColumn("own", F.col("home") == F.col("block")).drop("home")
    rows = _parts(rows, hot_rows).repartition(*GROUP).sortWithinPartitions(*GROUP, "date", "loadts", "obs_id").select(*GROUP, "own", "obs_id", "date", *values)
    return rows.mapInArrow(_kernel(everything), "obs_id bigint, field string, score double" + ", flagged boolean" * everything)
