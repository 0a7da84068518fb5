"""Moments, allocation, triggers, statistics and backtests on the order-line panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.linalg import bisection_nodes, student_quantile
from panelforge.operators import allocation, backtest, inference, moments, trigger, universe
from panelforge.plans import views
from panelforge.plans.views import P, TOTAL, block_sql
from panelforge.session import cut
from panelforge.sources import table

ALPHA, N = 0.98, 13
RULE = universe.UniverseRule(n_assets=views.ASSETS, min_history=views.HISTORY, cap_lag=views.LAG, every=views.EVERY)
LOW = 104
LAST = "(select max(pos) from p)"
BLOCK = block_sql()


def _x(spark, folder):
    return views.matrix_block(spark, folder)


def _r(df: DataFrame, digits: int = 9, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# moments ---------------------------------------------------------------------------------------
RAW = f"{BLOCK}, m as (select a.i, b.i as k, count(*) as n, sum(a.x) as wa, sum(b.x) as wb, sum(a.x * b.x) as wab from x a join x b using (t) group by 1, 2)"
S1 = f"{RAW}, s as (select i, k, (wab - wa * wb / n) / (n - 1) as s from m)"
S0 = f"{RAW}, s as (select i, k, (wab - wa * wb / n) / n as s from m)"
WX = f"{BLOCK}, wx as (select *, (1 - {ALPHA}::double) / (1 - power({ALPHA}::double, {views.WINDOW})) * power({ALPHA}::double, {views.WINDOW - 1} - t) as w from x)"
EW = f"{WX}, y as (select t, i, w, x - sum(w * x) over (partition by i) as y from wx), s as (select a.i, b.i as k, sum(a.w * a.y * b.y) as s, sum(a.w * a.y * a.y * b.y * b.y) as q, sum(a.w * a.y * a.y * a.y * b.y) as c from y a join y b using (t) group by 1, 2)"
TARGET = "own as (select i, s from s where i = k), tg as (select s.*, a.s as s_ii, b.s as s_kk, sqrt(a.s) * sqrt(b.s) as g from s join own a on a.i = s.i join own b on b.i = s.k), rb as (select avg(s / g) as rbar from tg where i <> k), f as (select tg.*, rbar, case when i = k then s else rbar * g end as f from tg, rb)"
INTENSITY = "pi as (select sum(q - s * s) as pi, sum(case when i = k then q - s * s end) as pi_own, sum(case when i <> k then sqrt(s_kk) / sqrt(s_ii) * (c - s_ii * s) end) as crossed, sum((f - s) * (f - s)) as gamma, max(rbar) as rbar from f), ne as (select 1 / sum(w * w) as n_eff from wx where i = 1), it as (select pi, pi_own + rbar * crossed as rho, gamma, (pi - pi_own - rbar * crossed) / gamma as kappa, greatest(0, least(1, (pi - pi_own - rbar * crossed) / gamma / n_eff)) as delta, n_eff, rbar from pi, ne)"


def c14_pairs(spark, folder):
    return _r(moments.pair_moments(_x(spark, folder)).select("i", "k", "n", F.col("wab").alias("xy")), 9, "xy")


def i11_covariance(spark, folder):
    return _r(moments.covariance(_x(spark, folder)), 12, "s")


def i12_linear(spark, folder):
    return _r(moments.linear_shrinkage(_x(spark, folder)), 10, "s", "shrink")


I12 = f"""with {S0}, tr as (select sum(case when i = k then s end) / {N} as mu, sum(s * s) as ss from s), nq as (select sum(q * q) as qq from (select t, sum(c * c) as q from (select t, x - avg(x) over (partition by i) as c from x) group by t)),
sh as (select mu, least((qq - {views.WINDOW} * ss) / ({views.WINDOW} * {views.WINDOW}), ss - {N} * mu * mu) / (ss - {N} * mu * mu) as shrink from tr, nq)
select i, k, round(shrink * (case when i = k then mu else 0 end) + (1 - shrink) * s, 10) as s, round(shrink, 10) as shrink from s, sh"""


def i14_weights(spark, folder):
    x = spark.range(views.WINDOW).select(F.col("id").alias("t"))
    return _r(moments.decay_weights(x, ALPHA, views.WINDOW), 12, "w")


def i15_effective(spark, folder):
    return _r(moments.effective_size(moments.decay_weights(_x(spark, folder), ALPHA, views.WINDOW)), 9, "n_eff", "total")


def i16_weighted(spark, folder):
    return _r(moments.weighted_covariance(moments.decay_weights(_x(spark, folder), ALPHA, views.WINDOW)), 12, "s")


def i17_target(spark, folder):
    out = moments.constant_correlation(moments.weighted_covariance(moments.decay_weights(_x(spark, folder), ALPHA, views.WINDOW)))
    return _r(out.select("i", "k", "f", "rbar"), 10, "f", "rbar")


def i18_intensity(spark, folder):
    return _r(moments.shrinkage_intensity(moments.decay_weights(_x(spark, folder), ALPHA, views.WINDOW)), 7, "pi", "rho", "gamma", "kappa", "delta", "n_eff", "rbar")


def i19_decayed(spark, folder):
    return _r(moments.decayed_shrinkage(_x(spark, folder), ALPHA, views.WINDOW), 10, "s")


def i20_equal_weights(spark, folder):
    """The limit of equal weights: the covariance with divisor T, shrunk to equal correlations."""
    return _r(moments.decayed_shrinkage(_x(spark, folder), 1.0, views.WINDOW), 10, "s")


I20 = f"with {EW.replace(WX, BLOCK + f', wx as (select *, 1.0::double / {views.WINDOW} as w from x)')}, {TARGET}, {INTENSITY} select i, k, round((1 - delta) * s + delta * f, 10) as s from f, it"


def i21_correlation(spark, folder):
    return _r(moments.correlation(moments.covariance(_x(spark, folder))), 9, "r")


CORR = f"{S1}, own as (select i, s from s where i = k), r as (select s.i, s.k, case when s.i = s.k then 1.0::double else greatest(-1, least(1, s.s / (sqrt(a.s) * sqrt(b.s)))) end as r from s join own a on a.i = s.i join own b on b.i = s.k)"


def i28_distance(spark, folder):
    return _r(moments.correlation_distance(moments.covariance(_x(spark, folder))), 8, "d")


def i23_edges(spark, folder):
    """The noise edge for several windows and variances."""
    g = spark.range(1).select(F.explode(F.array(*(F.lit(w) for w in (52, 104, 252, 504)))).alias("days"))
    return g.select("days", F.round(F.pow(1 + F.sqrt(F.lit(100.0) / F.col("days")), F.lit(2)), 9).alias("edge"))


def _labels(spark, folder):
    return table(spark, folder, "embeddings", "vec_id", "label").select(F.lit(0).alias("run"), F.col("label").alias("a"), F.pmod("vec_id", F.lit(10)).alias("b"))


def i32_rand(spark, folder):
    return _r(moments.partition_scores(_labels(spark, folder), ["run"]), 9, "ari", "vi")


CELLS = "cells as (select {by}, a, b, n_ab, sum(n_ab) over (partition by {by}, a) as n_a, sum(n_ab) over (partition by {by}, b) as n_b, sum(n_ab) over (partition by {by}) as n from (select {by}, a, b, count(*)::double as n_ab from lab group by all))"
SCORES = """{cells}, sums as (select {by}, max(n) as n, sum(n_ab * (n_ab - 1) / 2) as ij, sum(n_ab * (n_a - 1) / 2) as ai, sum(n_ab * (n_b - 1) / 2) as bj,
  sum(-n_ab / n * ln(n_a / n)) as ha, sum(-n_ab / n * ln(n_b / n)) as hb, sum(n_ab / n * ln(n_ab * n / (n_a * n_b))) as mi from cells group by {by}),
scores as (select {by}, cast(n as bigint) as n, case when abs((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)) < 1e-12 then 1.0::double else (ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)) end as ari, greatest(0.0::double, ha + hb - 2 * mi) as vi from sums)"""


def _scores_sql(by: str) -> str:
    return SCORES.format(cells=CELLS.format(by=by), by=by)


I32 = f"with lab as (select 0 as run, label as a, vec_id % 10 as b from embeddings), {_scores_sql('run')} select run, n, round(ari, 9) as ari, round(vi, 9) as vi from scores"


def d10_contingency(spark, folder):
    return _labels(spark, folder).groupBy("a", "b").agg(F.count("*").alias("n"))


# the universe and what is held ---------------------------------------------------------------------
def _universe(spark, folder):
    """Panel, members and rebalances to the panel's last position."""
    p = cut(views.asset_panel(spark, folder))  # assets by weeks, read by every branch below
    members = p.select("permno").distinct().select("permno", F.lit("1990-01-01").cast("date").alias("mbrstartdt"), F.lit("2030-01-01").cast("date").alias("mbrenddt"))
    marks = universe.rebalances(p.select("pos", "date").distinct(), LOW, views.last_position(p), views.EVERY)
    return p, members, marks


def _snapshot(spark, folder):
    p, members, marks = _universe(spark, folder)
    return p, marks, cut(universe.snapshots(p, members, marks, RULE))


HELD = f"""{P}, marks as (select distinct pos, date from p where pos >= {LOW} and (pos - {LOW}) % {views.EVERY} = 0), names1 as (select distinct permno from p),
cand as (select n.permno, m.pos, m.date, (select count(ret) from p where p.permno = n.permno and p.pos <= m.pos - 1) as history, (select arg_max(mcap, p.pos) from p where p.permno = n.permno and p.pos <= m.pos - {views.LAG} and mcap is not null) as cap,
  exists (select 1 from p where p.permno = n.permno and p.pos = m.pos and ret is not null) as alive from names1 n, marks m),
snap as (select pos, date, row_number() over (partition by pos order by cap desc nulls last, permno) as rank, permno, cap from cand where history >= {views.HISTORY} and alive qualify rank <= {views.ASSETS})"""


def f01_top_by_lag(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    return snap.select("pos", "rank", "permno", F.round("cap", 4).alias("cap"))


def i34_equal(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    return _r(allocation.equal_weights(snap.select("pos", "permno"), ["pos"]), 12, "w")


def b05_history(spark, folder):
    """Share of known returns in the window of each rebalance and security; those above 95 % stay."""
    p, marks, snap = _snapshot(spark, folder)
    window = snap.select("pos", "permno").withColumn("at", F.explode(F.sequence(F.col("pos") - views.WINDOW + 1, F.col("pos"))))
    seen = window.join(p.select("permno", F.col("pos").alias("at"), "ret"), ["permno", "at"], "left")
    return seen.groupBy("pos", "permno").agg(F.avg(F.col("ret").isNotNull().cast("double")).alias("share")).where("share >= 0.95").select("pos", "permno", F.round("share", 9).alias("share"))


B05 = f"with {HELD} select pos, permno, round(share, 9) as share from (select s.pos, s.permno, avg(case when p.ret is null then 0.0::double else 1.0::double end) as share from snap s join (select distinct pos as wk from p) g on g.wk between s.pos - {views.WINDOW - 1} and s.pos left join p on p.permno = s.permno and p.pos = g.wk group by 1, 2) where share >= 0.95"


def b06_breadth(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    return snap.groupBy("pos").agg(F.count("*").alias("n")).where("n >= 10")


def e16_every(spark, folder):
    return _universe(spark, folder)[2].select("pos")


def _daily(spark, folder):
    """Two strategies: all held alike, and a tilt by the rank of lagged value."""
    p, marks, snap = _snapshot(spark, folder)
    even = allocation.equal_weights(snap.select("pos", "permno"), ["pos"]).select(F.lit("even").alias("strategy"), "pos", "permno", "w")
    tilt = allocation.tilted_weights(snap.select("pos", F.col("permno").alias("i"), F.col("cap").alias("fwd")), ["pos"], 0.5).select(F.lit("tilt").alias("strategy"), "pos", F.col("i").alias("permno"), "w")
    weights = cut(even.unionByName(tilt))
    every = marks.select("pos").withColumn("strategy", F.explode(F.array(F.lit("even"), F.lit("tilt"))))
    rates = p.select("pos").distinct().withColumn("rf", F.lit(0.02 / views.YEAR))
    daily, moves = backtest.run(weights, every, p, rates, ["strategy"], lag=1, last=views.last_position(p), bps=10.0)
    return p, weights, daily.withColumn("rf", F.lit(0.02 / views.YEAR)), moves, every


RF = "0.02::double / 52"
WEIGHTS = f"""{HELD}, w as (
  select 'even' as strategy, pos, permno, 1.0::double / count(*) over (partition by pos) as w from snap
  union all
  select 'tilt', pos, permno, 0.5::double / count(*) over (partition by pos) + 0.5::double * (r - 1) / sum(r - 1) over (partition by pos) from (select *, row_number() over (partition by pos order by cap, permno) as r from snap)
), win as (select * from (select strategy, pos, pos + 1 as start, coalesce(lead(pos) over (partition by strategy order by pos) , {LAST}) as "end" from marks, (values ('even'), ('tilt')) st(strategy)) where start <= "end"),
hold as (select w.strategy, w.pos, start, "end", g.day, w.permno, w.w, p.ret, max(case when p.ret is null then 1 else 0 end) over run as gone
  from w join win using (strategy, pos) join (select distinct pos as day from p) g on g.day between start and "end" left join p on p.permno = w.permno and p.pos = g.day window run as (partition by w.strategy, w.pos, w.permno order by g.day rows unbounded preceding)),
val as (select *, w * product(case when gone = 1 then 1 + {RF} else 1 + ret end) over run as value, product(1 + {RF}) over run as cash from hold window run as (partition by strategy, pos, permno order by day rows unbounded preceding)),
tot as (select strategy, pos, start, day, sum(value) + (1 - sum(w)) * max(cash) as total from val group by 1, 2, 3, 4),
gr as (select *, total / coalesce(lag(total) over (partition by strategy, pos order by day), 1) - 1 as gross from tot),
drift as (select v.strategy, v.pos, v.permno, case when gone = 1 then 0 else value / total end as w from val v join tot using (strategy, pos, day) where v.day = v."end"),
old as (select d.strategy, n.next as pos, permno, w as was from drift d join (select strategy, pos, lead(pos) over (partition by strategy order by pos) as next from marks, (values ('even'), ('tilt')) st(strategy)) n using (strategy, pos) where next is not null),
mv as (select coalesce(w.strategy, old.strategy) as strategy, coalesce(w.pos, old.pos) as pos, sum(abs(coalesce(w, 0) - coalesce(was, 0))) as dw from w full join old on w.strategy = old.strategy and w.pos = old.pos and w.permno = old.permno where coalesce(w.pos, old.pos) in (select pos from win) group by 1, 2),
daily as (select gr.*, case when day = start then (1 + gross) * (1 - dw * 10 / 1e4::double) - 1 else gross end as net from gr join mv using (strategy, pos))
"""


def i46_windows(spark, folder):
    p, _, marks = _universe(spark, folder)
    return backtest.holding_windows(marks.select(F.lit("all").alias("strategy"), "pos"), ["strategy"], 1, views.last_position(p)).drop("strategy")


I46 = f"""with {HELD} select * from (select pos, pos + 1 as start, coalesce(lead(pos) over (order by pos), {LAST}) as "end" from marks) where start <= "end\""""


def i47_hold(spark, folder):
    _, _, daily, _, _ = _daily(spark, folder)
    return _r(daily.select("strategy", "pos", "day", "gross"), 9, "gross")


def i48_turnover(spark, folder):
    _, _, _, moves, _ = _daily(spark, folder)
    return _r(moves, 9, "turnover", "cost")


def c10_aligned(spark, folder):
    """Rebalances by how many holdings were bought, sold and kept."""
    _, weights, _, _, every = _daily(spark, folder)
    order = Window.partitionBy("strategy").orderBy("pos")
    nxt = every.withColumn("next", F.lead("pos").over(order)).where("next is not null")
    old = weights.join(nxt, ["strategy", "pos"]).select("strategy", F.col("next").alias("pos"), "permno", F.col("w").alias("was"))
    both = weights.join(old, ["strategy", "pos", "permno"], "full")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return both.groupBy("strategy", "pos").agg(n(F.col("was").isNull()).alias("bought"), n(F.col("w").isNull()).alias("sold"), n(F.col("w").isNotNull() & F.col("was").isNotNull()).alias("kept"))


C10 = f"""with {WEIGHTS} select coalesce(w.strategy, old.strategy) as strategy, coalesce(w.pos, old.pos) as pos, cast(sum(case when was is null then 1 else 0 end) as bigint) as bought, cast(sum(case when w.w is null then 1 else 0 end) as bigint) as sold, cast(sum(case when w.w is not null and was is not null then 1 else 0 end) as bigint) as kept
from w full join old on w.strategy = old.strategy and w.pos = old.pos and w.permno = old.permno group by 1, 2"""


def i53_summary(spark, folder):
    """Both strategies' metrics, best Sharpe ratio first."""
    _, _, daily, moves, _ = _daily(spark, folder)
    out = backtest.metrics(daily, ["strategy"], views.YEAR).join(moves.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover")), "strategy")
    return _r(out, 7, "ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar", "avg_turnover").orderBy(F.desc("sharpe"))


METRICS = f"""cv as (select *, sum(ln(1 + net)) over (partition by strategy order by day rows unbounded preceding) as wealth from daily),
fl as (select *, exp(wealth - max(wealth) over (partition by strategy order by day rows unbounded preceding)) - 1 as fall from cv),
me as (select strategy, count(*) as n_days, exp(sum(ln(1 + net)) * 52 / count(*)) - 1 as ann_return, stddev_samp(net) * sqrt(52) as ann_vol, avg(net - {RF}) / stddev_samp(net - {RF}) * sqrt(52) as sharpe, min(fall) as max_drawdown from fl group by strategy)"""
I53 = f"""with {WEIGHTS}, {METRICS}, tu as (select strategy, avg(dw / 2) as avg_turnover from mv group by strategy)
select strategy, n_days, round(ann_return, 7) as ann_return, round(ann_vol, 7) as ann_vol, round(sharpe, 7) as sharpe, round(max_drawdown, 7) as max_drawdown, round(ann_return / abs(max_drawdown), 7) as calmar, round(avg_turnover, 7) as avg_turnover from me join tu using (strategy)"""


def i54_difference(spark, folder):
    _, _, daily, _, _ = _daily(spark, folder)
    m = backtest.metrics(daily, ["strategy"], views.YEAR)
    return m.agg(F.round(F.max(F.when(F.col("strategy") == "tilt", F.col("sharpe"))) - F.max(F.when(F.col("strategy") == "even", F.col("sharpe"))), 7).alias("sharpe_difference"))


I54 = f"with {WEIGHTS}, {METRICS} select round(max(case when strategy = 'tilt' then sharpe end) - max(case when strategy = 'even' then sharpe end), 7) as sharpe_difference from me"


def i55_reconciliation(spark, folder):
    """First held days recomputed from weights and returns alone: the median difference and its status."""
    p, weights, daily, _, _ = _daily(spark, folder)
    first = daily.withColumn("n", F.row_number().over(Window.partitionBy("strategy", "pos").orderBy("day"))).where("n = 1").select("strategy", "pos", "day", "gross")
    own = weights.join(first, ["strategy", "pos"]).join(p.select("permno", F.col("pos").alias("day"), "ret"), ["permno", "day"], "left")
    rate = F.lit(0.02 / views.YEAR)
    again = own.groupBy("strategy", "pos").agg(F.max("gross").alias("gross"), (F.sum(F.col("w") * F.coalesce("ret", rate)) + (1 - F.sum("w")) * rate).alias("own"))
    return again.groupBy("strategy").agg(F.count("*").alias("n"), F.when(F.median(F.abs(F.col("gross") - F.col("own"))) < 1e-10, "OK").otherwise("OFF").alias("status"))


I55 = f"""with {WEIGHTS}, fd as (select strategy, pos, start, gross from gr where day = start),
own as (select f.strategy, f.pos, any_value(gross) as gross, sum(w.w * coalesce(p.ret, {RF})) + (1 - sum(w.w)) * {RF} as own from fd f join w using (strategy, pos) left join p on p.permno = w.permno and p.pos = f.start group by 1, 2)
select strategy, count(*) as n, case when median(abs(gross - own)) < 1e-10 then 'OK' else 'OFF' end as status from own group by strategy"""


def i40_tilt(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    out = allocation.tilted_weights(snap.select("pos", F.col("permno").alias("i"), F.col("cap").alias("fwd")), ["pos"], 0.25)
    return out.select("pos", F.col("i").alias("permno"), F.round("w", 12).alias("w"))


I40 = f"with {HELD} select pos, permno, round(0.75::double / count(*) over (partition by pos) + 0.25::double * (r - 1) / sum(r - 1) over (partition by pos), 12) as w from (select *, row_number() over (partition by pos order by cap, permno) as r from snap)"


def e10_ranks(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    return snap.select("pos", "permno", (F.row_number().over(Window.partitionBy("pos").orderBy("cap", "permno")) - 1).cast("bigint").alias("r"))


def _leaves(spark):
    return spark.range(N).select((F.col("id") + 1).alias("i"), F.col("id").cast("int").alias("leaf_pos"))


def i35_hierarchical(spark, folder):
    return _r(allocation.bisection_weights(moments.covariance(_x(spark, folder)), _leaves(spark), N), 9, "w")


def i36_equal_volatility(spark, folder):
    return _r(allocation.bisection_weights(moments.covariance(_x(spark, folder)), _leaves(spark), N, volatility=True), 9, "w")


def _bisection_sql(volatility: bool) -> str:
    sides = ", ".join(f"({a}, '{s}', {lo}, {hi})" for a, (low, mid, high) in enumerate(bisection_nodes(N)) for s, lo, hi in (("l", low, mid), ("r", mid, high)))
    inverse, risk = ("1 / sqrt(s)", "sqrt(sum(a.q * b.q * s))") if volatility else ("1 / s", "sum(a.q * b.q * s)")
    return f"""with {S1}, sides(node, side, lo, hi) as (values {sides}), mem as (select node, side, i, inv / sum(inv) over (partition by node, side) as q from (select i, {inverse} as inv from s where i = k) o join sides on i - 1 >= lo and i - 1 < hi),
risk as (select node, side, {risk} as v from mem a join mem b using (node, side) join s on s.i = a.i and s.k = b.i group by node, side),
share as (select r.node, r.side, 1 - r.v / sum(r.v) over (partition by node) as share from risk r), wt as (select i, product(share) as w from mem join share using (node, side) group by i)
select i, round(w / sum(w) over (), 9) as w from wt"""


def i38_contributions(spark, folder):
    s = moments.covariance(_x(spark, folder))
    w = allocation.bisection_weights(s, _leaves(spark), N)
    return _r(allocation.risk_contributions(s, w), 8, "rc")


def i44_policies(spark, folder):
    inputs = trigger.trigger_inputs(views.total_value(spark, folder), ["run"])
    out = None
    for policy in ("never", "periodic:3", "trigger"):
        one = trigger.refits(inputs, ["run"], policy).select(F.lit(policy).alias("policy"), "pos", "refit")
        out = one if out is None else out.unionByName(one)
    return out


TRIG = f"""{TOTAL}, lv as (select pos, avg(x) over (order by pos rows 4 preceding) as level from total), df as (select pos, level, level - lag(level) over (order by pos) as d from lv),
tr as (select *, case when count(d) over past >= 6 then stddev_samp(d) over past end as sigma from df window past as (order by pos rows between 12 preceding and 1 preceding))"""
I44 = f"""with {TRIG}, n as (select *, row_number() over (order by pos) - 1 as i from tr)
select 'never' as policy, pos, i = 0 as refit from n union all select 'periodic:3', pos, i % 4 = 0 from n union all select 'trigger', pos, i = 0 or coalesce(abs(d) > sigma, false) from n"""


def e03_trailing(spark, folder):
    inputs = trigger.trigger_inputs(views.total_value(spark, folder), ["run"])
    return inputs.select("pos", F.round("level", 7).alias("level"), F.round("d", 7).alias("d"), F.round("sigma", 7).alias("sigma"), trigger.fired(1.0).alias("fired"))


E03 = f"with {TRIG} select pos, round(level, 7) as level, round(d, 7) as d, round(sigma, 7) as sigma, coalesce(abs(d) > sigma, false) as fired from tr"


def _triggers(spark, folder):
    inputs = trigger.trigger_inputs(views.total_value(spark, folder), ["run"])
    out = None
    for gamma in (0.5, 1.0, 1.5, 2.0):
        one = trigger.trigger_set(inputs, ["run"], gamma).select(F.lit(gamma).alias("gamma"), "j")
        out = one if out is None else out.unionByName(one)
    return out


FIRED = f"{TRIG}, el as (select *, row_number() over (order by pos) - 1 as j from tr where sigma is not null), fired as (select gamma::double as gamma, j from el, (values (0.5), (1.0), (1.5), (2.0)) g(gamma) where abs(d) > gamma * sigma)"


def i104_masks(spark, folder):
    return _triggers(spark, folder)


def eligible(spark, folder) -> int:
    """Positions at which the trigger can fire: those with a known sigma."""
    return trigger.trigger_inputs(views.total_value(spark, folder), ["run"]).where("sigma is not null").count()


def i68_overlap(spark, folder):
    return _r(inference.schedule_overlap(_triggers(spark, folder), ["gamma"], eligible(spark, folder)), 9, "j_star")


I68 = f"""with {FIRED}, t as (select gamma, count(*) as n from fired group by gamma), ph as (select gamma, q, j % q as r, count(*) as c from fired, range(2, 13) s(q) group by all),
jc as (select gamma, q, r, c::double / (n + floor(((select count(*) from tr where sigma is not null) - 1 - r) / q::double) + 1 - c) as jac from ph join t using (gamma))
select gamma, round(jac, 9) as j_star, cast(q as integer) as q, cast(r as integer) as r from jc qualify row_number() over (partition by gamma order by jac desc, q, r) = 1"""


def c16_schedules(spark, folder):
    """All 77 phases of the schedules and how many positions each has."""
    g = spark.range(2, 13).select(F.col("id").alias("q")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    return g.select("q", F.col("r").cast("bigint").alias("r"), (F.floor((F.lit(349) - F.col("r")) / F.col("q")) + 1).cast("bigint").alias("n"))


def e06_gaps(spark, folder):
    return inference.gaps(_triggers(spark, folder), ["gamma"])


def i70_timing(spark, folder):
    return _r(inference.timing_variation(_triggers(spark, folder), ["gamma"]), 9, "cv", "modal")


I70 = f"""with {FIRED}, gp as (select gamma, j - lag(j) over (partition by gamma order by j) as gap from fired qualify gap is not null), sh as (select gamma, count(*) as n_gaps, stddev_samp(gap) / avg(gap) as cv from gp group by gamma),
mo as (select gamma, max(c)::double / sum(c) as modal from (select gamma, gap, count(*) as c from gp group by all) group by gamma) select gamma, n_gaps, round(case when n_gaps >= 2 then cv end, 9) as cv, round(case when n_gaps >= 2 then modal end, 9) as modal from sh join mo using (gamma)"""


def i82_floor(spark, folder):
    """The least modal share that so many positions allow."""
    n = _triggers(spark, folder).groupBy("gamma").agg(F.count("*").alias("n")).where("n > 1")
    return n.select("gamma", "n", F.round(F.greatest(F.lit(0), 2 * F.col("n") - eligible(spark, folder) - 1) / (F.col("n") - 1), 9).alias("floor"))


I82 = f"with {FIRED} select gamma, count(*) as n, round(greatest(0, 2 * count(*) - (select count(*) from tr where sigma is not null) - 1)::double / (count(*) - 1), 9) as floor from fired group by gamma having count(*) > 1"


# structural change: quartiles of value as labels ---------------------------------------------------
def _quartiles(spark, folder):
    _, _, snap = _snapshot(spark, folder)
    order = Window.partitionBy("pos").orderBy("cap", "permno")
    return snap.select("pos", "permno", F.ntile(4).over(order).alias("label")).withColumn("reb", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("pos")))


def vi_at_lag(spark, folder, lag: int) -> DataFrame:
    """reb, n, ari, vi between the labels of a rebalance and of ``lag`` earlier, on at least ten common assets."""
    q = _quartiles(spark, folder)
    later = q.select("reb", "permno", F.col("label").alias("b"))
    earlier = q.select((F.col("reb") + lag).alias("reb"), "permno", F.col("label").alias("a"))
    return moments.partition_scores(later.join(earlier, ["reb", "permno"]), ["reb"]).where("n >= 10")


def c13_matched(spark, folder):
    return _r(vi_at_lag(spark, folder, 1), 9, "ari", "vi")


def i91_horizons(spark, folder):
    """Mean structural change at several horizons."""
    out = None
    for lag in (1, 2, 5, 8):
        one = vi_at_lag(spark, folder, lag).agg(F.count("*").alias("n"), F.round(F.avg("vi"), 9).alias("mean_vi")).select(F.lit(lag).alias("lag"), "n", "mean_vi")
        out = one if out is None else out.unionByName(one)
    return out


QUART = f"{HELD}, qt as (select pos, permno, ntile(4) over (partition by pos order by cap, permno) as label, dense_rank() over (order by pos) as reb from snap)"


def _lag_sql(lag: int) -> str:
    return f"with {QUART}, lab as (select l.reb, e.label as a, l.label as b from qt l join qt e on e.permno = l.permno and e.reb = l.reb - {lag}), {_scores_sql('reb')} select cast(reb as integer) as reb, n, ari, vi from scores where n >= 10"


C13 = f"select reb, n, round(ari, 9) as ari, round(vi, 9) as vi from ({_lag_sql(1)})"
I91 = " union all ".join(f"select {lag} as lag, count(*) as n, round(avg(vi), 9) as mean_vi from ({_lag_sql(lag)})" for lag in (1, 2, 5, 8))


def _structural(spark, folder):
    """t = 0.., x = change of structure, fired: whether the market's value moved by more than a sigma."""
    vi = vi_at_lag(spark, folder, 1).select("reb", "vi")
    at = _quartiles(spark, folder).select("reb", "pos").distinct()
    mark = trigger.trigger_inputs(views.total_value(spark, folder), ["run"]).select("pos", trigger.fired(1.0).alias("fired"))
    rows = vi.join(at, "reb").join(mark, "pos")
    return cut(rows.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("reb")) - 1).cast("bigint").alias("t"), F.round("vi", 9).alias("x"), "fired", F.lit(0).alias("run")))  # rounded, so that equal values stay equal


STRUCT = f"{QUART}, lab as (select l.reb, e.label as a, l.label as b from qt l join qt e on e.permno = l.permno and e.reb = l.reb - 1), {_scores_sql('reb')}, {TRIG[TRIG.index('total as'):]}, st as (select row_number() over (order by reb) - 1 as t, round(vi, 9) as x, coalesce(abs(d) > sigma, false) as fired from (select reb, vi from scores where n >= 10) join (select distinct reb, pos from qt) using (reb) join tr using (pos))"


def i71_shift(spark, folder):
    return _r(inference.median_shift(_structural(spark, folder), ["run"]), 9, "d")


I71 = f"with {STRUCT} select 0 as run, round(median(x) filter (where fired) - median(x) filter (where not fired), 9) as d from st"


def e17_autocorrelation(spark, folder):
    return _r(inference.autocorrelations(_structural(spark, folder), ["run"], 12), 8, "rho")


E17 = f"with {STRUCT}, c as (select t, x - avg(x) over () as c from st) select 0 as run, cast(k as integer) as k, round((select sum(a.c * b.c) from c a join c b on b.t = a.t + k) / (select sum(c * c) from c), 8) as rho from range(1, 13) g(k)"


def i72_block_length(spark, folder):
    rows = _structural(spark, folder)
    return inference.block_length(rows.select("t", "x"), rows.count())


def i73_bootstrap(spark, folder):
    rows = _structural(spark, folder)
    return _r(inference.block_bootstrap(rows, rows.count(), 4, 200, "i73"), 9, "d", "p_value")


I73 = f"""with {STRUCT}, nn as (select count(*) as n from st), d0 as (select median(x) filter (where fired) - median(x) filter (where not fired) as d from st),
pk as (select b, (('0x' || substr(md5('i73|' || b || '|' || blk), 1, 12))::bigint % n + o) % n as t from range(200) r(b), range(100) bl(blk), range(4) oo(o), nn where blk * 4 + o < n),
db as (select b, median(x) filter (where fired) - median(x) filter (where not fired) as d_b from pk join st using (t) group by b)
select round(any_value(d), 9) as d, round((1 + sum(case when d_b - d >= d then 1 else 0 end))::double / (count(*) + 1), 9) as p_value, count(*) as kept from db, d0 where d_b is not null"""


# gates on a matrix of replications: users by event types ---------------------------------------------
MARGIN = 0.10


def _matrix(spark, folder):
    """rep, strategy, sharpe: the ratio of mean and deviation of a user's values by type of event."""
    e = table(spark, folder, "events", "user_id", "event_type", "value")
    return e.groupBy(F.col("user_id").alias("rep"), F.col("event_type").alias("strategy")).agg(F.count("value").alias("n"), (F.avg("value") / F.stddev_samp("value")).alias("sharpe")).where("n >= 2 and sharpe is not null and sharpe < 1e6")


MATRIX = "mx as (select user_id as rep, event_type as strategy, count(value) as n, avg(value) / nullif(stddev_samp(value), 0) as sharpe from events group by 1, 2 having count(value) >= 2 and avg(value) / nullif(stddev_samp(value), 0) < 1e6)"


def _differences(spark, folder):
    m = _matrix(spark, folder)
    base = m.where("strategy = 'view'").select("rep", F.col("sharpe").alias("base"))
    return m.where("strategy <> 'view'").join(base, "rep").select("strategy", "rep", (F.col("base") - F.col("sharpe")).alias("d"))


DIFF = f"{MATRIX}, dd as (select a.strategy, a.rep, b.sharpe - a.sharpe as d from mx a join mx b on b.rep = a.rep and b.strategy = 'view' where a.strategy <> 'view')"


def i75_bounds(spark, folder):
    return _r(inference.paired_bounds(_differences(spark, folder), ["strategy"], MARGIN), 7, "mean", "upper", "lower")


def student_sql(sizes: str) -> str:
    """CTEs tq: n and the one-sided 95 percent quantile of n - 1 degrees, for the n of ``sizes``: bisection on the finite sums of the distribution for whole degrees."""
    odd = "2 / pi() * (th + case when df > 1 then sin(th) * list_sum(list_transform(range((df - 1) // 2), lambda j: exp(lgamma(j + 1.0::double) - lgamma(j + 1.5::double)) * sqrt(pi()) / 2 * power(cos(th), 2 * j + 1))) else 0 end)"
    even = "sin(th) * list_sum(list_transform(range(df // 2), lambda j: exp(lgamma(j + 0.5::double) - lgamma(j + 1.0::double)) / sqrt(pi()) * power(cos(th), 2 * j)))"
    return f"""tb(n, lo, hi, turn) as (
  select n, 0.0::double, 700.0::double, 0 from (select distinct n from {sizes} where n > 1)
  union all
  select n, case when inside < 0.9 then mid else lo end, case when inside < 0.9 then hi else mid end, turn + 1
  from (select *, case when df % 2 = 1 then {odd} else {even} end as inside from (select *, (lo + hi) / 2 as mid, n - 1 as df, atan((lo + hi) / 2 / sqrt(n - 1)) as th from tb where turn < 60))
), tq as (select n, (lo + hi) / 2 as tq from tb where turn = 60)"""


def _bounds_sql(source: str) -> str:
    return f"""sb as (select strategy, count(*) as n, avg(d) as mean, stddev_samp(d) as sd from {source} group by strategy), {student_sql("sb")},
bd as (select strategy, mean, mean + tq * sd / sqrt(n) as upper, mean - tq * sd / sqrt(n) as lower, n from sb join tq using (n))
select strategy, round(mean, 7) as mean, round(upper, 7) as upper, round(lower, 7) as lower, n, case when upper <= {MARGIN}::double then 'PASS' when lower > {MARGIN}::double then 'FAIL' else 'INCONCLUSIVE' end as verdict from bd"""


I75 = f"with recursive {DIFF}, {_bounds_sql('dd')}"


def i76_controls(spark, folder):
    """Differences moved to a mean beyond the margin: every verdict must be FAIL."""
    return _r(inference.paired_bounds(inference.location_shift(_differences(spark, folder), ["strategy"], 0.5), ["strategy"], MARGIN), 7, "mean", "upper", "lower")


I76 = f"with recursive {DIFF}, ls as (select strategy, d - avg(d) over (partition by strategy) + 0.5::double as d from dd), {_bounds_sql('ls')}"


def i93_gate(spark, folder):
    """Mean differences with 1.96 standard errors, and what they say."""
    d = _differences(spark, folder).groupBy("strategy").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"))
    low, high = F.col("mean") - 1.96 * F.col("se"), F.col("mean") + 1.96 * F.col("se")
    return d.select("strategy", "n", F.round(low, 7).alias("low"), F.round(high, 7).alias("high"), F.when(high <= MARGIN, "PASS").when(low > MARGIN, "FAIL").otherwise("INCONCLUSIVE").alias("verdict"))


I93 = f"with {DIFF}, g as (select strategy, count(*) as n, avg(d) as mean, stddev_samp(d) / sqrt(count(d)) as se from dd group by strategy) select strategy, n, round(mean - 1.96::double * se, 7) as low, round(mean + 1.96::double * se, 7) as high, case when mean + 1.96 * se <= {MARGIN} then 'PASS' when mean - 1.96 * se > {MARGIN} then 'FAIL' else 'INCONCLUSIVE' end as verdict from g"


def i105_rollup(spark, folder):
    cells = i93_gate(spark, folder)
    worst = F.max(F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "INCONCLUSIVE", 1).otherwise(0))
    return cells.agg(F.count("*").alias("cells"), F.when(worst == 2, "FAIL").when(worst == 1, "INCONCLUSIVE").otherwise("PASS").alias("overall"))


I105 = f"select count(*) as cells, case when bool_or(verdict = 'FAIL') then 'FAIL' when bool_or(verdict = 'INCONCLUSIVE') then 'INCONCLUSIVE' else 'PASS' end as overall from ({I93})"


def i78_activation(spark, folder):
    """Whether enough replications show enough events."""
    e = table(spark, folder, "events", "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("rate"))
    out = e.agg(F.round(F.median("rate"), 9).alias("median_rate"), F.round(F.avg((F.col("n") >= 3).cast("double")), 9).alias("active"))
    return out.withColumn("sufficient", (F.col("median_rate") >= 0.05) & (F.col("active") >= 0.9))


I78 = "select round(median(rate), 9) as median_rate, round(avg(case when n >= 3 then 1.0::double else 0.0::double end), 9) as active, median(rate) >= 0.05 and avg(case when n >= 3 then 1.0 else 0.0 end) >= 0.9 as sufficient from (select user_id, count(*) as n, avg(case when event_type = 'purchase' then 1.0::double else 0.0::double end) as rate from events group by user_id)"


def i79_spearman(spark, folder):
    rows = _structural(spark, folder).join(views.total_value(spark, folder).select(F.col("pos").alias("t"), F.round("x", 6).alias("y")), "t")
    return _r(inference.spearman(rows, ["run"], "x", "y"), 8, "rho")


I79 = f"with {STRUCT}, j as (select st.x, round(total.x, 6) as y from st join total on total.pos = st.t), rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as ra, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rb from j) select 0 as run, round(corr(ra, rb), 8) as rho from rk"


def e11_average_rank(spark, folder):
    e = table(spark, folder, "embeddings", "vec_id", "label").withColumn("g", F.lit(0))
    return e.select("vec_id", inference.average_rank("label", ["g"]).alias("r"))


def i74_holm(spark, folder):
    """p-values made of hashed numbers, adjusted within families; one of each family is missing."""
    g = spark.range(40).select((F.col("id") % 4).alias("family"), F.col("id").alias("key"))
    p = F.when(F.col("key") % 10 != 9, F.pmod(inference.hashed(F.lit("holm"), F.col("key").cast("string")), F.lit(10000)) / 100000)
    return _r(inference.holm(g.withColumn("p", p), ["family"]), 9, "p", "p_holm")


I74 = """with g as (select id % 4 as family, id as key, case when id % 10 <> 9 then (('0x' || substr(md5('holm|' || id), 1, 12))::bigint % 10000) / 100000.0::double end as p from range(40) r(id)),
s as (select *, least(1.0::double, (count(p) over (partition by family) - row_number() over (partition by family, p is null order by p, key) + 1) * p) as step from g)
select family, key, round(p, 9) as p, round(case when p is not null then max(step) over (partition by family, p is null order by p, key rows unbounded preceding) end, 9) as p_holm from s"""


# folds, selections and set operations -------------------------------------------------------------
def i57_folds(spark, folder):
    rows = backtest.folds(0, 356, views.WINDOW + views.HISTORY, views.FOLDS, views.PURGE)
    return spark.createDataFrame(rows, "fold int, train_lo int, train_hi int, test_lo int, test_hi int")


I57 = "select cast(i + 1 as integer) as fold, 0 as train_lo, cast(156 + i * 50 - 5 as integer) as train_hi, cast(156 + i * 50 as integer) as test_lo, cast(case when i = 3 then 356 else 156 + i * 50 + 49 end as integer) as test_hi from range(4) r(i)"


def i58_leakage(spark, folder):
    """Gap and overlap of the training and test positions of each fold."""
    f = i57_folds(spark, folder)
    train = f.withColumn("pos", F.explode(F.sequence("train_lo", "train_hi"))).select("fold", "pos")
    test = f.withColumn("pos", F.explode(F.sequence("test_lo", "test_hi"))).select("fold", "pos")
    both = train.join(test, ["fold", "pos"]).groupBy("fold").agg(F.count("*").alias("overlap"))
    out = f.join(both, "fold", "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("bigint")))
    return out.select("fold", (F.col("test_lo") - F.col("train_hi") - 1).alias("gap"), "overlap", ((F.col("test_lo") - F.col("train_hi") - 1 >= views.PURGE) & (F.col("overlap") == 0)).alias("ok"))


def f04_selection(spark, folder):
    """The candidate nearest to 1 of those with enough events, the larger of two."""
    n = _triggers(spark, folder).groupBy("gamma").agg(F.count("*").alias("n")).where("n >= 12")
    return n.orderBy(F.abs(F.col("gamma") - 1.0), F.desc("gamma")).limit(1)


F04 = f"with {FIRED} select gamma, count(*) as n from fired group by gamma having count(*) >= 12 order by abs(gamma - 1), gamma desc limit 1"


def f07_first_reaching(spark, folder):
    """The first gamma at which fewer than 60 events are left, and the one before."""
    n = _triggers(spark, folder).groupBy("gamma").agg(F.count("*").alias("n"))
    return n.withColumn("prev", F.lag("gamma").over(Window.partitionBy(F.lit(0)).orderBy("gamma"))).where("n < 60").orderBy("gamma").limit(1).select("gamma", "prev")


F07 = f"with {FIRED}, c as (select gamma, count(*) as n from fired group by gamma), l as (select *, lag(gamma) over (order by gamma) as prev from c) select gamma, prev from l where n < 60 order by gamma limit 1"


def g03_sets(spark, folder):
    """Common, lost, new and all positions of two trigger sets, and their overlap."""
    t = _triggers(spark, folder)
    a, b = t.where("gamma = 0.5").select("j"), t.where("gamma = 1.0").select("j")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n")
    return count(a.intersect(b), "common").unionByName(count(a.subtract(b), "lost")).unionByName(count(a.unionByName(b).distinct(), "either")).unionByName(count(a.exceptAll(b).unionByName(b.exceptAll(a)), "one"))


G03 = f"""with {FIRED}, a as (select j from fired where gamma = 0.5), b as (select j from fired where gamma = 1.0)
select 'common' as kind, count(*) as n from (select j from a intersect select j from b) union all select 'lost', count(*) from (select j from a except select j from b) union all select 'either', count(*) from (select j from a union select j from b)
union all select 'one', count(*) from ((select j from a except all select j from b) union all (select j from b except all select j from a))"""


def c15_grid(spark, folder):
    """Targets by conditions by deltas by replications, with their seeds."""
    g = spark.range(8).select(F.col("id").alias("rep"))
    for name, values in (("target", (0.5, 1.0, 1.5)), ("cond", ("R", "U")), ("delta", (0.0, 0.1, 0.2))):
        g = g.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return g.withColumn("seed", (F.lit(7_000_000) + (F.col("target") * 100).cast("bigint") * 10_000 + (F.col("delta") * 100).cast("bigint") * 100 + F.col("rep")).cast("bigint"))


C15 = "select rep, target::double as target, cond, delta::double as delta, cast(7000000 + cast(target * 100 as bigint) * 10000 + cast(delta * 100 as bigint) * 100 + rep as bigint) as seed from range(8) r(rep), (values (0.5), (1.0), (1.5)) t(target), (values ('R'), ('U')) c(cond), (values (0.0), (0.1), (0.2)) d(delta)"


def i62_shifted(spark, folder):
    """A signal panel moved by 100 positions around the calendar, the missing cells kept."""
    p = views.asset_panel(spark, folder)
    moved = p.select("permno", F.pmod(F.col("pos") + 100, F.lit(views.last_position(p) + 1)).alias("pos"), F.col("ret").alias("signal"))
    return p.where("ret is not null").join(moved, ["permno", "pos"]).select("permno", "pos", "signal")


I62 = f"with {P} select a.permno, a.pos, b.ret as signal from p a join p b on b.permno = a.permno and (b.pos + 100) % ({LAST} + 1) = a.pos where a.ret is not null"


def i61_shuffled(spark, folder):
    """Returns dealt anew among the assets of each date by hashed ranks, then demeaned by asset."""
    p = views.asset_panel(spark, folder).where("ret is not null").select("permno", "pos", "ret")
    key = inference.hashed(F.lit("deal"), F.col("pos").cast("string"), F.col("permno").cast("string"))
    dealt = p.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy(key, "permno"))).select("pos", "r", "ret")
    seat = p.withColumn("r", F.row_number().over(Window.partitionBy("pos").orderBy("permno"))).select("pos", "r", "permno")
    out = seat.join(dealt, ["pos", "r"])
    return out.select("permno", "pos", F.round(F.col("ret") - F.avg("ret").over(Window.partitionBy("permno")), 9).alias("ret"))


I61 = f"""with {P}, q as (select permno, pos, ret from p where ret is not null), dealt as (select pos, ret, row_number() over (partition by pos order by ('0x' || substr(md5('deal|' || pos || '|' || permno), 1, 12))::bigint, permno) as r from q),
seat as (select pos, permno, row_number() over (partition by pos order by permno) as r from q) select permno, pos, round(ret - avg(ret) over (partition by permno), 9) as ret from seat join dealt using (pos, r)"""

QUERIES = {
    f.__name__: f
    for f in (
        i14_weights, i23_edges, i32_rand, d10_contingency,
        f01_top_by_lag, i34_equal, b05_history, b06_breadth, e16_every, i46_windows, i47_hold, i48_turnover, c10_aligned, i53_summary, i54_difference, i55_reconciliation, i40_tilt, e10_ranks,         i44_policies, e03_trailing, i104_masks, i68_overlap, c16_schedules, e06_gaps, i70_timing, i82_floor, c13_matched, i91_horizons, i71_shift, e17_autocorrelation, i72_block_length, i73_bootstrap,
        i75_bounds, i76_controls, i93_gate, i105_rollup, i78_activation, i79_spearman, e11_average_rank, i74_holm, i57_folds, i58_leakage, f04_selection, f07_first_reaching, g03_sets, c15_grid, i62_shifted, i61_shuffled,
    )
}
SQL = {
    "i14_weights": f"select t, round((1 - {ALPHA}::double) / (1 - power({ALPHA}::double, {views.WINDOW})) * power({ALPHA}::double, {views.WINDOW - 1} - t), 12) as w from range({views.WINDOW}) r(t)",
    "i23_edges": "select days, round(power(1 + sqrt(100.0::double / days), 2), 9) as edge from (values (52), (104), (252), (504)) v(days)",
    "i32_rand": I32,
    "d10_contingency": "select label as a, vec_id % 10 as b, count(*) as n from embeddings group by 1, 2",
    "f01_top_by_lag": f"with {HELD} select pos, cast(rank as integer) as rank, permno, round(cap, 4) as cap from snap",
    "i34_equal": f"with {HELD} select pos, permno, round(1.0::double / count(*) over (partition by pos), 12) as w from snap",
    "b05_history": B05,
    "b06_breadth": f"with {HELD} select pos, count(*) as n from snap group by pos having count(*) >= 10",
    "e16_every": f"with {HELD} select pos from marks",
    "i46_windows": I46,
    "i47_hold": f"with {WEIGHTS} select strategy, pos, day, round(gross, 9) as gross from daily",
    "i48_turnover": f"with {WEIGHTS} select strategy, pos, round(dw / 2, 9) as turnover, round(dw * 10 / 1e4::double, 9) as cost from mv",
    "c10_aligned": C10,
    "i53_summary": I53,
    "i54_difference": I54,
    "i55_reconciliation": I55,
    "i40_tilt": I40,
    "e10_ranks": f"with {HELD} select pos, permno, row_number() over (partition by pos order by cap, permno) - 1 as r from snap",
    "i44_policies": I44,
    "e03_trailing": E03,
    "i104_masks": f"with {FIRED} select gamma, j from fired",
    "i68_overlap": I68,
    "c16_schedules": "select q, r, cast(floor((349 - r) / q::double) + 1 as bigint) as n from range(2, 13) a(q), range(12) b(r) where r < q",
    "e06_gaps": f"with {FIRED} select gamma, j, j - lag(j) over (partition by gamma order by j) as gap from fired qualify gap is not null",
    "i70_timing": I70,
    "i82_floor": I82,
    "c13_matched": C13,
    "i91_horizons": I91,
    "i71_shift": I71,
    "e17_autocorrelation": E17,
    "i73_bootstrap": I73,
    "i75_bounds": I75,
    "i76_controls": I76,
    "i93_gate": I93,
    "i105_rollup": I105,
    "i78_activation": I78,
    "i79_spearman": I79,
    "e11_average_rank": "select vec_id, rank() over (order by label) + (count(*) over (partition by label) - 1) / 2.0::double as r from embeddings",
    "i74_holm": I74,
    "i57_folds": I57,
    "i58_leakage": f"select fold, test_lo - train_hi - 1 as gap, cast(0 as bigint) as overlap, true as ok from ({I57})",
    "f04_selection": F04,
    "f07_first_reaching": F07,
    "g03_sets": G03,
    "c15_grid": C15,
    "i62_shifted": I62,
    "i61_shuffled": I61,
}
#: SQL of the functions on one window of 13 assets, which are not registered.
BLOCK_SQL = {
    "c14_pairs": f"with {RAW} select i, k, n, round(wab, 9) as xy from m",
    "i11_covariance": f"with {S1} select i, k, round(s, 12) as s from s",
    "i12_linear": I12,
    "i15_effective": f"with {WX} select round(1 / sum(w * w), 9) as n_eff, round(sum(w), 9) as total from wx where i = 1",
    "i16_weighted": f"with {EW} select i, k, round(s, 12) as s from s",
    "i17_target": f"with {EW}, {TARGET} select i, k, round(f, 10) as f, round(rbar, 10) as rbar from f",
    "i18_intensity": f"with {EW}, {TARGET}, {INTENSITY} select {', '.join(f'round({c}, 7) as {c}' for c in ('pi', 'rho', 'gamma', 'kappa', 'delta', 'n_eff', 'rbar'))} from it",
    "i19_decayed": f"with {EW}, {TARGET}, {INTENSITY} select i, k, round((1 - delta) * s + delta * f, 10) as s from f, it",
    "i20_equal_weights": I20,
    "i21_correlation": f"with {CORR} select i, k, round(r, 9) as r from r",
    "i28_distance": f"with {CORR} select i, k, round(case when i = k then 0 else sqrt(greatest(0.0::double, 0.5::double * (1 - r))) end, 8) as d from r",
    "i35_hierarchical": _bisection_sql(False),
    "i36_equal_volatility": _bisection_sql(True),
    "i38_contributions": f"with wts as ({_bisection_sql(False).replace('round(w / sum(w) over (), 9)', 'w / sum(w) over ()')}), {S1}, rc as (select s.i, sum(a.w * b.w * s.s) as rc from s join wts a on a.i = s.i join wts b on b.i = s.k group by s.i) select i, round(rc / sum(rc) over (), 8) as rc from rc",
}
