"""Moments and allocation of all assets over the window up to every rebalance, with their SQL.

The functions of the same names in block_queries and extra_queries are one
window of 13 assets, for tests by hand; these are the registered queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.linalg import bisection_nodes
from panelforge.operators import allocation, moments
from panelforge.plans import dense_sql, views
from panelforge.plans.block_queries import ALPHA, _r
from panelforge.session import cut

BY = ["pos"]
_x = views.trailing_windows


def _weighted(spark, folder) -> DataFrame:
    return moments.decay_weights(_x(spark, folder), ALPHA, views.WINDOW)


def c14_pairs(spark, folder):
    return _r(moments.pair_moments(_x(spark, folder), BY).select("pos", "i", "k", "n", F.col("wab").alias("xy")), 9, "xy")


def i11_covariance(spark, folder):
    return _r(moments.covariance(_x(spark, folder), BY), 12, "s")


def i12_linear(spark, folder):
    return _r(moments.linear_shrinkage(_x(spark, folder), BY), 10, "s", "shrink")


def i15_effective(spark, folder):
    return _r(moments.effective_size(_weighted(spark, folder), BY), 9, "n_eff", "total")


def i16_weighted(spark, folder):
    return _r(moments.weighted_covariance(_weighted(spark, folder), BY), 12, "s")


def i17_target(spark, folder):
    out = moments.constant_correlation(moments.weighted_covariance(_weighted(spark, folder), BY), BY)
    return _r(out.select("pos", "i", "k", "f", "rbar"), 10, "f", "rbar")


def i18_intensity(spark, folder):
    return _r(moments.shrinkage_intensity(_weighted(spark, folder), BY), 7, "pi", "rho", "gamma", "kappa", "delta", "n_eff", "rbar")


def i19_decayed(spark, folder):
    return _r(moments.decayed_shrinkage(_x(spark, folder), ALPHA, views.WINDOW, BY), 10, "s")


def i20_equal_weights(spark, folder):
    return _r(moments.decayed_shrinkage(_x(spark, folder), 1.0, views.WINDOW, BY), 10, "s")


def i21_correlation(spark, folder):
    return _r(moments.correlation(moments.covariance(_x(spark, folder), BY), BY), 9, "r")


def i28_distance(spark, folder):
    return _r(moments.correlation_distance(moments.covariance(_x(spark, folder), BY), BY), 8, "d")


def i17_exact_pairs(spark, folder):
    """Each asset's nearest other one in correlation, at every rebalance."""
    d = moments.correlation_distance(moments.covariance(_x(spark, folder), BY), BY).where("i <> k")
    return d.groupBy("pos", "i").agg(F.min(F.struct(F.round("d", 8).alias("d"), "k")).alias("x")).select("pos", "i", "x.k", "x.d")


def _bisected(s: DataFrame, volatility: bool = False) -> DataFrame:
    """Bisection weights of every rebalance, assets in ascending order as leaves; how a list is halved depends on its length."""
    leaves = cut(s.where("i = k").select("pos", "i", (F.row_number().over(Window.partitionBy("pos").orderBy("i")) - 1).alias("leaf_pos"), F.count("*").over(Window.partitionBy("pos")).alias("n")))
    sizes = [r["n"] for r in leaves.select("n").distinct().orderBy("n").collect()]  # at most one a number of assets
    if not sizes or sizes == [1]:
        return leaves.select("pos", "i", F.lit(1.0).alias("w"))
    alone = [leaves.where("n = 1").select("pos", "i", F.lit(1.0).alias("w"))] if 1 in sizes else []
    each = [allocation.bisection_weights(s, leaves.where(F.col("n") == n), n, BY, volatility).select("pos", "i", "w") for n in sizes if n > 1]
    return reduce(DataFrame.unionByName, alone + each)


def i35_hierarchical(spark, folder):
    return _r(_bisected(cut(moments.covariance(_x(spark, folder), BY))), 9, "w")


def i36_equal_volatility(spark, folder):
    return _r(_bisected(cut(moments.covariance(_x(spark, folder), BY)), volatility=True), 9, "w")


def i38_contributions(spark, folder):
    s = cut(moments.covariance(_x(spark, folder), BY))
    return _r(allocation.risk_contributions(s, _bisected(s), BY), 8, "rc")


QUERIES = {
    f.__name__: f
    for f in (
        c14_pairs, i11_covariance, i12_linear, i15_effective, i16_weighted, i17_target, i18_intensity, i19_decayed, i20_equal_weights, i21_correlation, i28_distance,
        i17_exact_pairs, i35_hierarchical, i36_equal_volatility, i38_contributions,
    )
}
_T = views.WINDOW
X = f"{dense_sql.ALL}, xa as (select x.pos, k.permno as i, x.n as p, t, x from x join kept k on k.pos = x.pos and k.i = x.i)"
RAW = f"{X}, m as (select a.pos, a.i, b.i as k, any_value(a.p) as p, count(*) as n, sum(a.x) as wa, sum(b.x) as wb, sum(a.x * b.x) as wab from xa a join xa b using (pos, t) group by a.pos, a.i, b.i)"
S1 = f"{RAW}, s as (select pos, i, k, p, (wab - wa * wb / n) / (n - 1) as s from m)"
S0 = f"{RAW}, s as (select pos, i, k, p, (wab - wa * wb / n) / n as s from m)"
CORR = f"{S1}, own as (select pos, i, s from s where i = k), r as (select s.pos, s.i, s.k, case when s.i = s.k then 1.0::double else greatest(-1, least(1, s.s / (sqrt(a.s) * sqrt(b.s)))) end as r from s join own a on a.pos = s.pos and a.i = s.i join own b on b.pos = s.pos and b.i = s.k)"


def _weighted_sql(weight: str) -> str:
    """CTEs wx and s of the weighted windows, then the shrinkage to equal correlations: f, it."""
    return f"""{X}, wx as (select *, {weight} as w from xa), y as (select pos, p, t, i, w, x - sum(w * x) over (partition by pos, i) as y from wx),
s as (select a.pos, a.i, b.i as k, sum(a.w * a.y * b.y) as s, sum(a.w * a.y * a.y * b.y * b.y) as q, sum(a.w * a.y * a.y * a.y * b.y) as c from y a join y b using (pos, t) group by a.pos, a.i, b.i),
own as (select pos, i, s from s where i = k), tg as (select s.*, a.s as s_ii, b.s as s_kk, sqrt(a.s) * sqrt(b.s) as g from s join own a on a.pos = s.pos and a.i = s.i join own b on b.pos = s.pos and b.i = s.k),
f as (select *, case when i = k then s else rbar * g end as f from (select *, avg(s / g) filter (where i <> k) over (partition by pos) as rbar from tg)),
sums as (select pos, sum(q - s * s) as pi, sum(case when i = k then q - s * s end) as pi_own, sum(case when i <> k then sqrt(s_kk) / sqrt(s_ii) * (c - s_ii * s) end) as crossed, sum((f - s) * (f - s)) as gamma, max(rbar) as rbar from f group by pos),
ne as (select pos, 1 / sum(w * w) as n_eff, sum(w) as total from wx where i = 1 group by pos),
it as (select *, (pi - rho) / gamma as kappa, greatest(0, least(1, (pi - rho) / gamma / n_eff)) as delta from (select *, pi_own + rbar * crossed as rho from sums join ne using (pos)))"""


DECAYED = _weighted_sql(f"(1 - {ALPHA}::double) / (1 - power({ALPHA}::double, {_T})) * power({ALPHA}::double, {_T - 1} - t)")
EVEN = _weighted_sql(f"1.0::double / {_T}")


def _halves(volatility: bool, digits: str = "round(w / sum(w) over (partition by pos), 9)") -> str:
    sides = ", ".join(f"({n}, {a}, '{s}', {lo}, {hi})" for n in range(2, 26) for a, (low, mid, high) in enumerate(bisection_nodes(n)) for s, lo, hi in (("l", low, mid), ("r", mid, high)))
    inverse, risk = ("1 / sqrt(s)", "sqrt(sum(a.q * b.q * s))") if volatility else ("1 / s", "sum(a.q * b.q * s)")
    return f"""{S1}, sides(p, node, side, lo, hi) as (values {sides}),
mem as (select pos, node, side, i, inv / sum(inv) over (partition by pos, node, side) as q from (select pos, i, p, {inverse} as inv, row_number() over (partition by pos order by i) - 1 as leaf from s where i = k) o join sides on sides.p = o.p and leaf >= lo and leaf < hi),
risk as (select a.pos, a.node, a.side, {risk} as v from mem a join mem b using (pos, node, side) join s on s.pos = a.pos and s.i = a.i and s.k = b.i group by a.pos, a.node, a.side),
share as (select pos, node, side, 1 - v / sum(v) over (partition by pos, node) as share from risk), wt as (select pos, i, product(share) as w from mem join share using (pos, node, side) group by pos, i),
hw as (select pos, i, {digits} as w from wt)"""


SQL = {
    "c14_pairs": f"with {RAW} select pos, i, k, n, round(wab, 9) as xy from m",
    "i11_covariance": f"with {S1} select pos, i, k, round(s, 12) as s from s",
    "i12_linear": f"""with {S0}, tr as (select pos, sum(case when i = k then s end) / any_value(p) as mu, sum(s * s) as ss, any_value(p) as p from s group by pos), nq as (select pos, sum(q * q) as qq from (select pos, t, sum(c * c) as q from (select pos, t, x - avg(x) over (partition by pos, i) as c from xa) group by pos, t) group by pos),
sh as (select pos, mu, least((qq - {_T} * ss) / ({_T} * {_T}), ss - p * mu * mu) / (ss - p * mu * mu) as shrink from tr join nq using (pos))
select pos, i, k, round(shrink * (case when i = k then mu else 0 end) + (1 - shrink) * s, 10) as s, round(shrink, 10) as shrink from s join sh using (pos)""",
    "i15_effective": f"with {DECAYED} select pos, round(n_eff, 9) as n_eff, round(total, 9) as total from ne",
    "i16_weighted": f"with {DECAYED} select pos, i, k, round(s, 12) as s from s",
    "i17_target": f"with {DECAYED} select pos, i, k, round(f, 10) as f, round(rbar, 10) as rbar from f",
    "i18_intensity": f"with {DECAYED} select pos, {', '.join(f'round({c}, 7) as {c}' for c in ('pi', 'rho', 'gamma', 'kappa', 'delta', 'n_eff', 'rbar'))} from it",
    "i19_decayed": f"with {DECAYED} select pos, i, k, round((1 - delta) * s + delta * f, 10) as s from f join it using (pos)",
    "i20_equal_weights": f"with {EVEN} select pos, i, k, round((1 - delta) * s + delta * f, 10) as s from f join it using (pos)",
    "i21_correlation": f"with {CORR} select pos, i, k, round(r, 9) as r from r",
    "i28_distance": f"with {CORR} select pos, i, k, round(case when i = k then 0 else sqrt(greatest(0.0::double, 0.5::double * (1 - r))) end, 8) as d from r",
    "i17_exact_pairs": f"with {CORR}, dd as (select pos, i, k, round(sqrt(greatest(0.0::double, 0.5::double * (1 - r))), 8) as d from r where i <> k) select pos, i, k, d from dd qualify row_number() over (partition by pos, i order by d, k) = 1",
    "i35_hierarchical": f"with {_halves(False)} select pos, i, w from hw",
    "i36_equal_volatility": f"with {_halves(True)} select pos, i, w from hw",
    "i38_contributions": f"with {_halves(False, 'w / sum(w) over (partition by pos)')}, rc as (select s.pos, s.i, sum(a.w * b.w * s.s) as rc from s join hw a on a.pos = s.pos and a.i = s.i join hw b on b.pos = s.pos and b.i = s.k group by s.pos, s.i) select pos, i, round(rc / sum(rc) over (partition by pos), 8) as rc from rc",
}
