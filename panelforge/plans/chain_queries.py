"""The whole chain on the daily file: panel, universe, estimates, trigger, strategies and holdings, with the SQL of what needs no eigenvalues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import walk
from panelforge.operators import allocation, backtest, estimation, panel, trigger, universe
from panelforge.plans import panel_queries
from panelforge.session import cut
from panelforge.sources import table

#: Sizes of the studied setting: assets held at most, history, lag of market values and step in days; days of an estimate, days of a year.
RULE = universe.UniverseRule(n_assets=100, min_history=252, cap_lag=21, every=21)
WINDOW, YEAR = 504, 252


def _universe(spark, folder):
    p, member, marks = panel_queries.setting(spark, folder, RULE, WINDOW, None)
    rates = cut(panel.aligned_rate(p.select("pos", "date").distinct(), table(spark, folder, "rf")))
    return p, marks, rates, cut(universe.snapshots(p, member, marks, RULE))


def _held(p: DataFrame, marks: DataFrame, rates: DataFrame, weights: DataFrame, names: list[str]):
    every = marks.select("pos").withColumn("strategy", F.explode(F.array(*map(F.lit, names))))
    return backtest.run(weights.select("strategy", "pos", "permno", "w"), every, p, rates.select("pos", "rf"), ["strategy"])


def _even(spark, folder):
    p, marks, rates, snap = _universe(spark, folder)
    even = allocation.equal_weights(snap.select("pos", "permno"), ["pos"]).withColumn("strategy", F.lit("EW"))
    return _held(p, marks, rates, cut(even), ["EW"])


def i49_universe(spark, folder):
    """The hundred largest eligible securities of every month."""
    _, _, _, snap = _universe(spark, folder)
    return snap.select("pos", F.date_format("date", "yyyy-MM-dd").alias("date"), "rank", "permno", F.round("cap", 4).alias("cap"))


def i49_daily(spark, folder):
    """Daily returns of equal weights on it, before and after costs."""
    daily, _ = _even(spark, folder)
    return daily.select("pos", "day", F.round("gross", 9).alias("gross"), F.round("net", 9).alias("net"))


def i49_moves(spark, folder):
    """Turnover and cost of every rebalance of equal weights."""
    _, moves = _even(spark, folder)
    return moves.select("pos", F.round("turnover", 9).alias("turnover"), F.round("cost", 9).alias("cost"))


def i49_chain(spark, folder):
    """All strategies on one estimation of each date: metrics, turnover, refits and events."""
    p, marks, rates, snap = _universe(spark, folder)
    shared = cut(estimation.shared_pass(estimation.windows(p, snap, WINDOW), WINDOW))
    ar = estimation.absorption(shared, estimation.frozen_k(shared)).withColumn("run", F.lit(0))
    inputs = cut(trigger.trigger_inputs(ar, ["run"]).withColumn("fired", trigger.fired(1.0)))
    weights = cut(estimation.strategy_weights(shared, inputs, walk.STRATEGIES))
    daily, moves = _held(p, marks.join(shared.select("pos"), "pos", "left_semi"), rates, weights, list(walk.STRATEGIES))
    daily = daily.join(rates.select(F.col("pos").alias("day"), "rf"), "day", "left")
    fits = weights.where("refit").select("strategy", "pos").distinct().groupBy("strategy").agg(F.count("*").alias("refits"))
    events = inputs.agg(F.sum(F.col("fired").cast("bigint")).alias("events"))
    out = backtest.metrics(daily, ["strategy"], YEAR).join(moves.groupBy("strategy").agg(F.avg("turnover").alias("turnover")), "strategy").join(fits, "strategy", "left")
    return out.withColumn("refits", F.coalesce("refits", F.lit(0).cast("bigint"))).crossJoin(F.broadcast(events))  # one row


LAST = "(select max(pos) from cal)"
UNIVERSE = panel_queries.universe_sql(RULE, WINDOW, LAST)
HELD = f"""{UNIVERSE}, w as (select pos, permno, 1.0::double / count(*) over (partition by pos) as w from snap),
rate as (select pos, coalesce(last_value(case when isnan(rf) then null else rf end ignore nulls) over (order by pos rows unbounded preceding), 0) as rf from cal left join rf using (date)),
win as (select * from (select pos, pos + 1 as start, coalesce(lead(pos) over (order by pos), {LAST}) as stop from marks) where start <= stop),
hold as (select w.pos, start, stop, r.pos as day, w.permno, w.w, p.ret, r.rf, max(case when p.ret is null then 1 else 0 end) over run as gone
  from w join win using (pos) join rate r on r.pos between start and stop left join p on p.permno = w.permno and p.pos = r.pos window run as (partition by w.pos, w.permno order by r.pos rows unbounded preceding)),
val as (select *, w * product(case when gone = 1 then 1 + rf else 1 + ret end) over run as value, product(1 + rf) over run as cash from hold window run as (partition by pos, permno order by day rows unbounded preceding)),
tot as (select pos, start, day, sum(value) + (1 - sum(w)) * max(cash) as total from val group by 1, 2, 3),
gr as (select *, total / coalesce(lag(total) over (partition by pos order by day), 1) - 1 as gross from tot),
drift as (select v.pos, v.permno, case when gone = 1 then 0 else value / total end as w from val v join tot using (pos, day) where v.day = stop),
old as (select n.next as pos, permno, w as was from drift d join (select pos, lead(pos) over (order by pos) as next from win) n using (pos) where next is not null),
mv as (select coalesce(w.pos, old.pos) as pos, sum(abs(coalesce(w, 0) - coalesce(was, 0))) as dw from (select * from w where pos in (select pos from win)) w full join old on w.pos = old.pos and w.permno = old.permno group by 1)"""

QUERIES = {f.__name__: f for f in (i49_universe, i49_daily, i49_moves, i49_chain)}
SQL = {
    "i49_universe": f"{UNIVERSE} select pos, strftime(date, '%Y-%m-%d') as date, cast(rank as integer) as rank, permno, round(cap, 4) as cap from snap",
    "i49_daily": f"{HELD} select pos, day, round(gross, 9) as gross, round(case when day = start then (1 + gross) * (1 - dw * 10 / 1e4::double) - 1 else gross end, 9) as net from gr join mv using (pos)",
    "i49_moves": f"{HELD} select pos, round(dw / 2, 9) as turnover, round(dw * 10 / 1e4::double, 9) as cost from mv",
}
