"""Further rows of the inventory: a generator, guards, and small pieces in forms of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import moments, panel
from panelforge.plans import block_queries, views
from panelforge.plans.block_queries import FIRED, HELD, TRIG
from panelforge.plans.panel_queries import PANEL_SQL, _panel
from panelforge.sources import sinks, synthetic, table, tables


class RegionLocked(PermissionError):
    """A position of the held-back region was asked for."""


def guard_region(positions: DataFrame, first_locked: int) -> DataFrame:
    """``positions``, or an error if any lies at or beyond ``first_locked``."""
    if not positions.where(F.col("pos") >= first_locked).isEmpty():
        raise RegionLocked(f"positions from {first_locked} on are held back")
    return positions


def a04_first_readable(spark, folder):
    """The first of several sources of which a row can be read."""
    found = sinks.first_readable(spark, [f"{folder}/{n}.parquet" for n in ("dsf_v2", "dsf", "names")])
    return spark.createDataFrame([(found.rsplit("/", 1)[1] if found else None,)], "source string")


ASKED = [*tables.SCHEMAS, "msf", "lineitem", "orders", "events"]


def a05_access(spark, folder):
    """Which tables of the folder can be read."""
    return spark.createDataFrame(sinks.access(spark, folder, ASKED), "tab string, status string")


A05 = "select tab, case when table_name is null then 'NOT THERE' else 'READABLE' end as status from (values " + ", ".join(f"('{n}')" for n in ASKED) + ") a(tab) left join (select distinct table_name from information_schema.tables) t on table_name = tab"


def a08_synthetic(spark, folder):
    """Rows, securities and deviations by year of generated tables."""
    made = synthetic.tables(spark, "2018-01-01", "2019-12-31", pool=60, index=30)
    return made["dsf"].groupBy(F.year("date").alias("yr")).agg(F.count("*").alias("n"), F.countDistinct("permno").alias("securities"), F.round(F.stddev_samp("ret"), 6).alias("deviation"))


def b07_region(spark, folder):
    """The development positions, after a guard."""
    return guard_region(_panel(spark, folder).select("pos").distinct().where("pos < 1500"), 1500).agg(F.count("*").alias("n"), F.max("pos").alias("last"))


B07 = f"with {PANEL_SQL} select count(*) as n, max(pos) as last from cal where pos < 1500"


def c06_theta(spark, folder):
    """Month-end rows in each names spell that holds on their date."""
    dsf = table(spark, folder, "dsf", "obs_id", "permno", "date")
    last = Window.partitionBy("permno", F.last_day("date")).orderBy(F.desc("date"), F.desc("obs_id"))
    monthly = dsf.where("date is not null").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    spells = table(spark, folder, "names", "name_id", "permno", "namedt", "nameendt")
    return monthly.join(spells, "permno").where("date between namedt and nameendt").select("obs_id", "name_id")


C06 = """select obs_id, name_id from (select obs_id, permno, date from dsf where date is not null qualify row_number() over (partition by permno, last_day(date) order by date desc, obs_id desc) = 1)
join names using (permno) where date between namedt and nameendt"""


def d03_members(spark, folder):
    """Distinct members at each month's end, by calendar month."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit("2018-01-01").cast("date"), F.lit("2024-12-01").cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("d"))
    live = panel.in_force(months, "d", table(spark, folder, "membership"), "mbrstartdt", "mbrenddt")
    return live.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.countDistinct("permno").alias("n"))


D03 = "select strftime(d, '%Y-%m') as month, count(distinct permno) as n from (select last_day(cast(unnest(generate_series(date '2018-01-01', date '2024-12-01', interval 1 month)) as date)) as d) join membership on d between mbrstartdt and mbrenddt group by 1"


def d07_moments(spark, folder):
    """Mean, deviation and standard error of each user's values."""
    e = table(spark, folder, "events", "user_id", "value")
    return e.groupBy("user_id").agg(F.count("value").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.round(F.stddev_samp("value"), 9).alias("sd"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 9).alias("se"))


D07 = "select user_id, count(value) as n, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as sd, round(stddev_samp(value) / sqrt(count(value)), 9) as se from events group by user_id"


def d08_modal_gap(spark, folder):
    """Gaps of each trigger set with their counts and shares."""
    g = block_queries.e06_gaps(spark, folder).groupBy("gamma", "gap").agg(F.count("*").alias("n"))
    return g.select("gamma", "gap", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gamma")), 9).alias("share"))


D08 = f"with {FIRED}, g as (select gamma, j - lag(j) over (partition by gamma order by j) as gap from fired qualify gap is not null) select gamma, gap, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by gamma), 9) as share from g group by gamma, gap"


def d14_fractions(spark, folder):
    """Shares of positive returns and of large ones by security."""
    p = views.asset_panel(spark, folder).where("ret is not null")
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    return p.groupBy("permno").agg(share(F.col("ret") > 0).alias("up"), share(F.abs("ret") > 0.05).alias("large"))


D14 = f"with {views.P} select permno, round(avg(case when ret > 0 then 1.0::double else 0.0::double end), 9) as up, round(avg(case when abs(ret) > 0.05 then 1.0::double else 0.0::double end), 9) as large from p where ret is not null group by permno"


def e05_eligible(spark, folder):
    """Positions with a known sigma, numbered among themselves."""
    inputs = block_queries.trigger.trigger_inputs(views.total_value(spark, folder), ["run"]).where("sigma is not null")
    return inputs.select("pos", (F.row_number().over(Window.partitionBy("run").orderBy("pos")) - 1).cast("bigint").alias("j"))


E05 = f"with {TRIG} select pos, row_number() over (order by pos) - 1 as j from tr where sigma is not null"


def e09_filled(spark, folder):
    """Market values carried forward over missing weeks, of every security and week."""
    p = views.asset_panel(spark, folder)
    grid = p.select("permno").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(views.last_position(p)).cast("bigint"))))
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(p.select("permno", "pos", "mcap"), ["permno", "pos"], "left").select("permno", "pos", F.round(F.last("mcap", ignorenulls=True).over(w), 4).alias("mcap"))


E09 = f"with {views.P}, g as (select permno, g.pos from (select distinct permno from p), (select distinct pos from p) g) select permno, pos, round(last_value(mcap ignore nulls) over (partition by permno order by pos rows unbounded preceding), 4) as mcap from g left join p using (permno, pos)"


def e12_turnover(spark, folder):
    """Names that differ between neighbouring selections, by twice the larger of them."""
    _, _, snap = block_queries._snapshot(spark, folder)
    reb = snap.select("pos", "permno").withColumn("k", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("pos")))
    new, old = reb.select("k", "pos", "permno", F.lit(1).alias("new")), reb.select((F.col("k") + 1).alias("k"), "permno", F.lit(1).alias("old"))
    both = new.drop("pos").join(old, ["k", "permno"], "full").groupBy("k").agg(F.sum(F.when(F.col("new").isNull() | F.col("old").isNull(), 1).otherwise(0)).alias("d"), F.count("new").alias("a"), F.count("old").alias("b"))
    return new.select("k", "pos").distinct().join(both, "k").where("k > 1").select("pos", F.round(F.col("d") / (2 * F.greatest("a", "b", F.lit(1))), 9).alias("turnover"))


E12 = f"""with {HELD}, r as (select pos, permno, dense_rank() over (order by pos) as k from snap), b as (select coalesce(n.k, o.k + 1) as k, n.permno as np, o.permno as op from r n full join r o on n.k = o.k + 1 and n.permno = o.permno)
select pos, round(sum(case when np is null or op is null then 1 else 0 end)::double / (2 * greatest(count(np), count(op), 1)), 9) as turnover from b join (select distinct k, pos from r) using (k) where k > 1 group by pos"""


def f05_smallest(spark, folder):
    """The smallest window that each number of assets allows."""
    n = spark.createDataFrame([(100,), (337,), (400,), (500,)], "n int")
    w = n.withColumn("days", F.explode(F.array(F.lit(504), F.lit(756)))).where(F.col("n") / F.col("days") <= 0.67)
    return w.groupBy("n").agg(F.min("days").alias("days"))


F05 = "select n, min(w) as days from (values (100), (337), (400), (500)) a(n), (values (504), (756)) b(w) where n / w::double <= 0.67 group by n"


def g07_jaccard(spark, folder):
    """Overlap of every pair of trigger sets."""
    t = block_queries._triggers(spark, folder).persist()  # a few hundred positions
    size = t.groupBy("gamma").agg(F.count("*").alias("n"))
    a, b = t.select(F.col("gamma").alias("g1"), "j"), t.select(F.col("gamma").alias("g2"), "j")
    both = a.join(b, "j").where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("both"))
    n1, n2 = size.select(F.col("gamma").alias("g1"), F.col("n").alias("n1")), size.select(F.col("gamma").alias("g2"), F.col("n").alias("n2"))
    return both.join(n1, "g1").join(n2, "g2").select("g1", "g2", F.round(F.col("both") / (F.col("n1") + F.col("n2") - F.col("both")), 9).alias("jaccard"))


G07 = f"with {FIRED}, s as (select gamma, count(*) as n from fired group by gamma), b as (select a.gamma as g1, b.gamma as g2, count(*) as c from fired a join fired b using (j) where a.gamma < b.gamma group by 1, 2) select g1, g2, round(c::double / (x.n + y.n - c), 9) as jaccard from b join s x on x.gamma = g1 join s y on y.gamma = g2"


def h05_later(spark, folder):
    """Membership spells with the day five days after their end, and whether the next begins by then."""
    w = Window.partitionBy("permno").orderBy("mbrstartdt", "mbr_id")
    m = table(spark, folder, "membership").where("mbrstartdt is not null and mbrenddt is not null")
    return m.select("mbr_id", F.date_format(F.date_add("mbrenddt", 5), "yyyy-MM-dd").alias("limit_day"), F.coalesce(F.lead("mbrstartdt").over(w) <= F.date_add("mbrenddt", 5), F.lit(False)).alias("joined"))


H05 = "select mbr_id, strftime(mbrenddt + 5, '%Y-%m-%d') as limit_day, coalesce(lead(mbrstartdt) over (partition by permno order by mbrstartdt, mbr_id) <= mbrenddt + 5, false) as joined from membership where mbrstartdt is not null and mbrenddt is not null"


def h08_rounding(spark, folder):
    """Halves rounded to even, then clipped."""
    x = spark.range(40).select((F.col("id") / 2 - 3).alias("x"))
    return x.select("x", F.least(F.greatest(F.bround("x"), F.lit(1.0)), F.lit(12.0)).alias("r"))


H08 = "select id / 2.0::double - 3 as x, least(greatest(round_even(id / 2.0::double - 3, 0), 1.0::double), 12.0::double) as r from range(40) t(id)"


def h15_quantiles(spark, folder):
    """One-sided 95 percent quantiles of Student's t by sample size."""
    return spark.createDataFrame([(n, round(block_queries.student_quantile(0.95, n - 1), 8)) for n in range(2, 31)], "n int, tq double")


H15 = f"with recursive sizes as (select n from range(2, 31) r(n)), {block_queries.student_sql('sizes')} select cast(n as integer) as n, round(tq, 8) as tq from tq"


def i17_exact_pairs(spark, folder):
    """Neighbours in correlation: each asset's nearest other one."""
    d = moments.correlation_distance(moments.covariance(views.matrix_block(spark, folder))).where("i <> k")
    return d.groupBy("i").agg(F.min(F.struct(F.round("d", 8).alias("d"), "k")).alias("x")).select("i", "x.k", "x.d")


I17B = f"with {block_queries.CORR} select i, k, round(sqrt(greatest(0.0::double, 0.5::double * (1 - r))), 8) as d from r where i <> k qualify row_number() over (partition by i order by round(sqrt(greatest(0.0::double, 0.5::double * (1 - r))), 8), k) = 1"


def i51_sharpe(spark, folder):
    """Excess Sharpe ratio, annual return and volatility of each security."""
    p = views.asset_panel(spark, folder).where("ret is not null")
    ex = F.col("ret") - 0.02 / views.YEAR
    out = p.groupBy("permno").agg(F.count("*").alias("n"), (F.avg(ex) / F.stddev_samp(ex) * views.YEAR**0.5).alias("sharpe"), (F.product(1 + F.col("ret"))).alias("w"), (F.stddev_samp("ret") * views.YEAR**0.5).alias("vol"))
    return out.select("permno", "n", F.round("sharpe", 7).alias("sharpe"), F.round(F.pow("w", views.YEAR / F.col("n")) - 1, 7).alias("ann_return"), F.round("vol", 7).alias("ann_vol"))


I51 = f"with {views.P} select permno, count(*) as n, round(avg(ret - 0.02::double / 52) / stddev_samp(ret - 0.02::double / 52) * sqrt(52), 7) as sharpe, round(power(product(1 + ret), 52.0::double / count(*)) - 1, 7) as ann_return, round(stddev_samp(ret) * sqrt(52), 7) as ann_vol from p where ret is not null group by permno"


def i52_drawdown(spark, folder):
    """Worst fall and Calmar ratio of each security."""
    p = views.asset_panel(spark, folder).where("ret is not null").select(F.col("permno").alias("strategy"), F.col("pos").alias("day"), F.col("ret").alias("net"), F.lit(0.0).alias("rf"))
    out = block_queries.backtest.metrics(p, ["strategy"], views.YEAR)
    return out.select(F.col("strategy").alias("permno"), F.round("max_drawdown", 7).alias("max_drawdown"), F.round("calmar", 6).alias("calmar"))


I52 = f"""with {views.P}, c as (select permno, pos, ret, sum(ln(1 + ret)) over (partition by permno order by pos rows unbounded preceding) as w from p where ret is not null), f as (select *, exp(w - max(w) over (partition by permno order by pos rows unbounded preceding)) - 1 as fall from c)
select permno, round(min(fall), 7) as max_drawdown, round((exp(sum(ln(1 + ret)) * 52 / count(*)) - 1) / abs(min(fall)), 6) as calmar from f group by permno"""

def h09_masked(spark, folder):
    """Sums of quotients and logs by flag, those that do not exist counted as 0."""
    lines = table(spark, folder, "lineitem", "l_returnflag", "l_tax", "l_discount")
    quotient, log = F.try_divide("l_tax", "l_discount"), F.when(F.col("l_tax") > 0, F.ln("l_tax"))
    masked = lambda c: F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    return lines.groupBy("l_returnflag").agg(F.round(F.sum(masked(quotient)), 4).alias("quotients"), F.round(F.sum(masked(log)), 4).alias("logs"), F.count_if(quotient.isNull()).alias("undefined"))


H09 = "select l_returnflag, round(sum(case when l_discount = 0 then 0 else l_tax / l_discount end), 4) as quotients, round(sum(case when l_tax > 0 then ln(l_tax) else 0 end), 4) as logs, count(*) filter (where l_discount = 0) as undefined from lineitem group by 1"


def h11_inserted(spark, folder):
    """The lines of each order, with a 0 put in behind the dearest."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("held"), F.max_by(F.col("l_linenumber").cast("int"), F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("dear"))
    return own.select("l_orderkey", F.array_join(F.array_insert("held", F.array_position("held", F.col("dear")).cast("int") + 1, F.lit(0)), ",").alias("held"))


H11 = """select l_orderkey, array_to_string(list_concat(list_concat(held[1:spot], [0]), held[spot + 1:]), ',') as held
from (select l_orderkey, held, list_position(held, dear) as spot from (select l_orderkey, list(l_linenumber order by l_linenumber) as held, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) as dear from lineitem group by 1))"""


def h13_json(spark, folder):
    """Membership spells as JSON with sorted keys, and its hash."""
    m = table(spark, folder, "membership", "mbr_id", "permno", "mbrstartdt")
    body = F.to_json(F.struct("mbr_id", F.date_format("mbrstartdt", "yyyy-MM-dd").alias("mbrstartdt"), "permno"), {"ignoreNullFields": "false"})
    return m.select("mbr_id", body.alias("body"), F.sha2(body, 256).alias("hash"))


H13 = """select mbr_id, body, sha256(body) as hash from (select mbr_id, '{"mbr_id":' || mbr_id || ',"mbrstartdt":' || coalesce('"' || strftime(mbrstartdt, '%Y-%m-%d') || '"', 'null') || ',"permno":' || coalesce(permno::varchar, 'null') || '}' as body from membership)"""

QUERIES = {
    f.__name__: f
    for f in (
        a04_first_readable, a05_access, a08_synthetic, h09_masked, h11_inserted, h13_json, b07_region, c06_theta, d03_members, d07_moments, d08_modal_gap, d14_fractions, e05_eligible, e09_filled, e12_turnover, f05_smallest, g07_jaccard, h05_later, h08_rounding, h15_quantiles,
        i51_sharpe, i52_drawdown,
    )
}
SQL = {
    "a04_first_readable": "select 'dsf.parquet' as source", "a05_access": A05, "h09_masked": H09, "h11_inserted": H11, "h13_json": H13, "b07_region": B07, "c06_theta": C06, "d03_members": D03, "d07_moments": D07, "d08_modal_gap": D08, "d14_fractions": D14, "e05_eligible": E05, "e09_filled": E09,
    "e12_turnover": E12, "f05_smallest": F05, "g07_jaccard": G07, "h05_later": H05, "h08_rounding": H08, "h15_quantiles": H15, "i51_sharpe": I51, "i52_drawdown": I52,
}
