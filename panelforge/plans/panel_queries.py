"""Scans, predicates, joins, aggregations and windows on the raw security tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import panel, spells, universe
from panelforge.session import cut
from panelforge.sources import table

END = "2024-12-31"
RULE = universe.UniverseRule(n_assets=10, min_history=40, cap_lag=21, every=63)

#: The panel in SQL, for the queries below.
PANEL_SQL = """
d as (
  select obs_id, permno, lineno, date, case when isnan(ret) then null else ret end as ret, case when isnan(prc) then null else prc end as prc,
    case when isnan(shrout) then null else shrout end as shrout, loadts
  from dsf where permno in (select permno from names where shrcd in (10, 11) and exchcd in (1, 2, 3))
), gone as (
  select permno, dlstdt as date, dlstcd,
    case when dlret is not null and not isnan(dlret) then dlret when dlstcd between 500 and 599 or dlstcd in (400, 401) then -0.3::double else 0::double end as dlret,
    case when dlret is not null and not isnan(dlret) then 'observed' when dlstcd between 500 and 599 or dlstcd in (400, 401) then 'performance' else 'other' end as source
  from delist where permno in (select permno from d)
), spliced as (
  select coalesce(d.permno, gone.permno) as permno, coalesce(d.date, gone.date) as date, obs_id, lineno, loadts, prc, shrout, dlret, dlstcd, source, obs_id is not null as had_row,
    case when dlret is not null then (1 + coalesce(ret, 0)) * (1 + dlret) - 1 else ret end as ret, abs(prc) * shrout as mcap
  from d full join gone on d.permno = gone.permno and d.date = gone.date
), rets as (
  select permno, date, ret from spliced where ret is not null and date is not null
  qualify row_number() over (partition by permno, date order by loadts desc nulls last, lineno desc nulls last, obs_id desc nulls last, ret desc) = 1
), caps as (
  select permno, date, mcap from spliced where mcap is not null and date is not null
  qualify row_number() over (partition by permno, date order by loadts desc nulls last, lineno desc nulls last, obs_id desc nulls last, mcap desc) = 1
), cal as (
  select row_number() over (order by date) - 1 as pos, date from (select distinct date from rets)
), p as (
  select permno, pos, date, ret, mcap from (select * from rets full join caps using (permno, date)) join cal using (date)
)
"""
WITH = f"with {PANEL_SQL}"


def _dsf(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "dsf", *columns)


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "names")


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    dsf = _dsf(spark, folder, "obs_id", "permno", "lineno", "date", "ret", "prc", "shrout", "loadts")
    return panel.build_panel(dsf, _names(spark, folder), table(spark, folder, "delist"))


def _spliced(spark: SparkSession, folder: str) -> DataFrame:
    dsf = panel.ever_valid(_dsf(spark, folder, "obs_id", "permno", "date", "ret"), _names(spark, folder))
    return panel.splice_delistings(dsf, table(spark, folder, "delist"))


def _days(p: DataFrame) -> DataFrame:
    return p.select("pos", "date").distinct()


def text(c: str):
    return F.date_format(c, "yyyy-MM-dd")


# scans ---------------------------------------------------------------------------------------
def a01_scan(spark, folder):
    """Rows of each raw table."""
    out = None
    for name in ("dsf", "names", "membership", "delist", "rf"):
        one = table(spark, folder, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("tab"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


A01 = " union all ".join(f"select '{t}' as tab, count(*) as n_rows from {t}" for t in ("dsf", "names", "membership", "delist", "rf"))


def a06_two_stage(spark, folder):
    """A monthly pre-screen gives ids, by which the daily scan is reduced."""
    dsf = _dsf(spark, folder, "permno", "date", "prc", "shrout")
    ids = _screened(spark, folder, 5)
    return dsf.join(ids, "permno", "left_semi").groupBy("permno").agg(F.count("*").alias("n_rows"))


def a07_vintages(spark, folder):
    """Two vintages under one schema: one names its columns otherwise and lacks one."""
    dsf = _dsf(spark, folder, "permno", "date", "ret", "cfacshr")
    old = dsf.where("year(date) < 2021")
    new = dsf.where("year(date) >= 2021").select(F.col("permno").alias("securityid"), F.col("date").alias("caldt"), F.col("ret").alias("dlyret"))
    both = old.unionByName(new.select(F.col("securityid").alias("permno"), F.col("caldt").alias("date"), F.col("dlyret").alias("ret")), allowMissingColumns=True)
    both = both.withColumn("cfacshr", F.coalesce("cfacshr", F.lit(1.0)))
    return both.groupBy(F.year("date").alias("yr")).agg(F.count("ret").alias("n_ret"), F.round(F.avg("cfacshr"), 9).alias("mean_factor"))


A07 = """
select cast(year(date) as integer) as yr, count(case when isnan(ret) then null else ret end) as n_ret,
  round(avg(case when year(date) < 2021 then coalesce(case when isnan(cfacshr) then null else cfacshr end, 1) else 1 end), 9) as mean_factor
from dsf group by 1
"""


# predicates ----------------------------------------------------------------------------------
def b01_ever_valid(spark, folder):
    return panel.ever_valid(_dsf(spark, folder, "obs_id", "permno"), _names(spark, folder)).select("obs_id")


B01 = "select obs_id from dsf where permno in (select permno from names where shrcd in (10, 11) and exchcd in (1, 2, 3))"


def b02_valid_on_date(spark, folder):
    return panel.valid_on_date(_dsf(spark, folder, "obs_id", "permno", "date"), _names(spark, folder)).groupBy("obs_id").agg(F.count("*").alias("n_spells"))


B02 = """select obs_id, count(*) as n_spells from dsf join names using (permno)
where shrcd in (10, 11) and exchcd in (1, 2, 3) and date between namedt and nameendt group by obs_id"""


def b03_market_value(spark, folder):
    return _dsf(spark, folder, "obs_id", "prc", "shrout").select("obs_id", F.round(panel.market_value(), 4).alias("mcap"))


B03 = "select obs_id, round(abs(prc) * shrout, 4) as mcap from dsf"


def b04_positive_value(spark, folder):
    return _dsf(spark, folder, "obs_id", "prc", "shrout").where(panel.market_value() > 0).select("obs_id")


B04 = "select obs_id from dsf where abs(prc) * shrout > 0 and not isnan(prc) and not isnan(shrout)"


def b08_finite(spark, folder):
    return spark.read.parquet(f"{folder}/dsf.parquet").where(panel.finite("ret")).groupBy(F.year("date").alias("yr")).agg(F.count("*").alias("n"), F.round(F.min("ret"), 9).alias("low"))


B08 = "select cast(year(date) as integer) as yr, count(*) as n, round(min(ret), 9) as low from dsf where ret is not null and not isnan(ret) and not isinf(ret) group by 1"


def b09_fill(spark, folder):
    held = panel.ever_valid(_dsf(spark, folder, "permno"), _names(spark, folder))
    return panel.filled_delistings(table(spark, folder, "delist"), held).select("delist_id", "dlret", "source")


B09 = f"""with {PANEL_SQL} select delist_id, case when dlret is not null and not isnan(dlret) then dlret when dlstcd between 500 and 599 or dlstcd in (400, 401) then -0.3::double else 0::double end as dlret,
  case when dlret is not null and not isnan(dlret) then 'observed' when dlstcd between 500 and 599 or dlstcd in (400, 401) then 'performance' else 'other' end as source
from delist where permno in (select permno from d)"""


def b10_members(spark, folder):
    """Member spells that hold on each month's first rebalance date."""
    days = _dsf(spark, folder, "date").where("date is not null").groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("date"))
    member = table(spark, folder, "membership")
    return panel.in_force(days, "date", member, "mbrstartdt", "mbrenddt").groupBy("date").agg(F.countDistinct("permno").alias("n_members"))


B10 = """select date, count(distinct permno) as n_members from (select min(date) as date from dsf where date is not null group by date_trunc('month', date)) x
join membership on date between mbrstartdt and mbrenddt group by date"""


def b11_inside_names(spark, folder):
    names = _names(spark, folder).withColumn("nameendt", F.coalesce("nameendt", F.lit(END).cast("date")))
    return panel.inside_spells(_dsf(spark, folder, "obs_id", "permno", "date"), names, "namedt", "nameendt").select("obs_id")


B11 = f"select obs_id from dsf where exists (select 1 from names n where n.permno = dsf.permno and date between namedt and coalesce(nameendt, date '{END}'))"


def b12_codes(spark, folder):
    return table(spark, folder, "delist").where(F.col("dlstcd").isin(400, 401, 560, 574)).groupBy("dlstcd").agg(F.count("*").alias("n"))


B12 = "select dlstcd, count(*) as n from delist where dlstcd in (400, 401, 560, 574) group by dlstcd"


# joins ---------------------------------------------------------------------------------------
def c01_splice(spark, folder):
    return _spliced(spark, folder).where("dlret is not null").select("permno", "date", F.round("ret", 9).alias("ret"), "source", "had_row")


C01 = f"{WITH} select permno, date, round(ret, 9) as ret, source, had_row from spliced where dlret is not null"


def c02_held(spark, folder):
    return table(spark, folder, "delist", "delist_id", "permno").join(_dsf(spark, folder, "permno"), "permno", "left_semi").select("delist_id")


C02 = "select delist_id from delist where permno in (select permno from dsf)"


def _links(spark, folder):
    """Constituents, securities and names of a link route, made of the names table."""
    names = _names(spark, folder)
    idx = table(spark, folder, "membership").select(F.lpad(F.pmod("permno", F.lit(100000)).cast("string"), 6, "0").alias("gvkey"), F.format_string("%02d ", F.pmod("mbr_id", F.lit(2)) + 1).alias("iid"), F.col("mbrstartdt").alias("from_dt"), F.coalesce("mbrenddt", F.lit(END).cast("date")).alias("thru_dt"))
    held = names.where("ticker is not null and trim(ticker) <> ''")
    sec = held.groupBy("permno").agg(F.max("ticker").alias("tic")).select(F.lpad(F.pmod("permno", F.lit(100000)).cast("string"), 6, "0").alias("gvkey"), F.lit("01").alias("iid"), F.upper(F.rpad(F.concat(F.trim("tic"), F.col("permno").cast("string")), 9, "x")).alias("cusip"), "tic")
    crsp = held.groupBy("permno").agg(F.max("ticker").alias("tic"), F.min("ticker").alias("old")).select("permno", F.substring(F.upper(F.rpad(F.concat(F.trim("tic"), F.col("permno").cast("string")), 9, "x")), 1, 8).alias("cusip"), F.when(F.pmod("permno", F.lit(3)) > 0, F.substring(F.upper(F.rpad(F.concat(F.trim("old"), F.col("permno").cast("string")), 9, "x")), 1, 8)).alias("ncusip"))
    return idx.withColumn("iid", F.trim("iid")), sec.withColumn("cusip8", F.upper(F.substring(F.trim("cusip"), 1, 8))), crsp


def _linked(spark, folder):
    idx, sec, crsp = _links(spark, folder)
    a = idx.join(sec.select("gvkey", "iid", "cusip8", "tic"), ["gvkey", "iid"], "left")
    both = crsp.select("permno", F.col("ncusip").alias("cusip8"), F.lit(0).alias("pref")).unionByName(crsp.select("permno", F.col("cusip").alias("cusip8"), F.lit(1).alias("pref"))).where("cusip8 is not null")
    first = Window.partitionBy("cusip8").orderBy("pref", "permno")
    walk = both.withColumn("n", F.row_number().over(first)).where("n = 1").select("cusip8", "permno", "pref")
    return a.join(walk, "cusip8", "left")


LINK_SQL = f"""
idx as (select lpad(cast(permno % 100000 as varchar), 6, '0') as gvkey, trim(printf('%02d ', mbr_id % 2 + 1)) as iid, mbrstartdt as from_dt, coalesce(mbrenddt, date '{END}') as thru_dt from membership),
held as (select * from names where ticker is not null and trim(ticker) <> ''),
crsp as (select permno, max(ticker) as tic, min(ticker) as old from held group by permno),
sec as (select lpad(cast(permno % 100000 as varchar), 6, '0') as gvkey, '01' as iid, tic, upper(substring(rpad(trim(tic) || cast(permno as varchar), 9, 'x'), 1, 8)) as cusip8 from crsp),
handles as (
  select permno, case when permno % 3 > 0 then upper(substring(rpad(trim(old) || cast(permno as varchar), 9, 'x'), 1, 8)) end as cusip8, 0 as pref from crsp
  union all select permno, upper(substring(rpad(trim(tic) || cast(permno as varchar), 9, 'x'), 1, 8)), 1 from crsp),
walk as (select cusip8, permno, pref from handles where cusip8 is not null qualify row_number() over (partition by cusip8 order by pref, permno) = 1),
linked as (select idx.*, sec.cusip8, sec.tic, walk.permno, walk.pref from idx left join sec using (gvkey, iid) left join walk on walk.cusip8 = sec.cusip8)
"""


def c03_constituents(spark, folder):
    idx, sec, _ = _links(spark, folder)
    return idx.join(sec.select("gvkey", "iid", "tic"), ["gvkey", "iid"], "left").select("gvkey", "iid", "from_dt", "tic")


C03 = f"with {LINK_SQL} select gvkey, iid, from_dt, tic from linked"


def c04_crosswalk(spark, folder):
    return _linked(spark, folder).where("permno is not null").select("gvkey", "iid", "from_dt", "permno", "pref")


C04 = f"with {LINK_SQL} select gvkey, iid, from_dt, permno, pref from linked where permno is not null"


def c05_unmatched(spark, folder):
    idx, sec, _ = _links(spark, folder)
    return idx.join(sec, ["gvkey", "iid"], "left_anti").groupBy("iid").agg(F.count("*").alias("n"))


C05 = f"with {LINK_SQL} select iid, count(*) as n from idx where not exists (select 1 from sec where sec.gvkey = idx.gvkey and sec.iid = idx.iid) group by iid"


def c07_memberships(spark, folder):
    """Members on each month-end date of the calendar."""
    p = _panel(spark, folder)
    ends = _days(p).groupBy(F.last_day("date").alias("m")).agg(F.max("date").alias("date"))
    member = table(spark, folder, "membership")
    live = panel.in_force(ends, "date", member, "mbrstartdt", "mbrenddt")
    return live.groupBy("date").agg(F.countDistinct("permno").alias("n_members"), F.count("*").alias("n_spells"))


C07 = f"""{WITH} select date, count(distinct permno) as n_members, count(*) as n_spells
from (select max(date) as date from cal group by last_day(date)) join membership on date between mbrstartdt and mbrenddt group by date"""


def c08_as_of(spark, folder):
    """The last calendar position at or before each delisting date."""
    days = _days(_panel(spark, folder))
    asked = table(spark, folder, "delist").select(F.col("dlstdt").alias("date")).where("date is not null").distinct()
    return panel.as_of_position(asked, days)


C08 = f"{WITH} select x.date, coalesce((select max(pos) from cal where cal.date <= x.date), -1) as pos from (select distinct dlstdt as date from delist where dlstdt is not null) x"


def c09_last_cap(spark, folder):
    p = _panel(spark, folder)
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("permno", "pos", F.round(F.last("mcap", ignorenulls=True).over(w), 4).alias("last_cap"))


C09 = f"{WITH} select permno, pos, round(last_value(mcap ignore nulls) over (partition by permno order by pos rows unbounded preceding), 4) as last_cap from p"


def c11_rate(spark, folder):
    days = _days(_panel(spark, folder))
    return panel.aligned_rate(days, table(spark, folder, "rf"))


C11 = f"{WITH} select pos, date, coalesce(last_value(case when isnan(rf) then null else rf end ignore nulls) over (order by pos rows unbounded preceding), 0) as rf from cal left join rf using (date)"


def c12_common(spark, folder):
    """Mean difference of two securities on the dates that both have, per pair of neighbours by permno."""
    p = _panel(spark, folder).where("ret is not null").select("permno", "pos", "ret")
    nxt = panel.following(p.select("permno").distinct(), "permno", "other")
    a = p.join(nxt, "permno")
    b = p.select(F.col("permno").alias("other"), "pos", F.col("ret").alias("ret2"))
    return a.join(b, ["other", "pos"]).groupBy("permno", "other").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ret") - F.col("ret2")), 9).alias("diff"))


C12 = f"""{WITH}, nxt as (select permno, lead(permno) over (order by permno) as other from (select distinct permno from p where ret is not null))
select a.permno, other, count(*) as n, round(avg(a.ret - b.ret), 9) as diff from nxt join p a using (permno) join p b on b.permno = nxt.other and b.pos = a.pos
where a.ret is not null and b.ret is not null group by 1, 2"""


def c17_annual_changes(spark, folder):
    m = table(spark, folder, "membership")
    adds = m.groupBy(F.year("mbrstartdt").alias("yr")).agg(F.count("*").alias("adds")).where("yr is not null")
    drops = m.groupBy(F.year("mbrenddt").alias("yr")).agg(F.count("*").alias("drops")).where("yr is not null")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return adds.join(drops, "yr", "full").select("yr", zero("adds").alias("adds"), zero("drops").alias("drops"), (zero("adds") + zero("drops")).alias("changes"))


C17 = """select cast(yr as integer) as yr, coalesce(adds, 0) as adds, coalesce(drops, 0) as drops, coalesce(adds, 0) + coalesce(drops, 0) as changes
from (select year(mbrstartdt) as yr, count(*) as adds from membership where mbrstartdt is not null group by 1) full join (select year(mbrenddt) as yr, count(*) as drops from membership where mbrenddt is not null group by 1) using (yr)"""


# aggregations --------------------------------------------------------------------------------
def d01_last_value(spark, folder):
    return _panel(spark, folder).where("ret is not null").select("permno", "date", F.round("ret", 9).alias("ret"))


D01 = f"{WITH} select permno, date, round(ret, 9) as ret from rets"


def d02_history(spark, folder):
    p = _panel(spark, folder)
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("permno", "pos", F.count("ret").over(w).alias("history"))


D02 = f"{WITH} select permno, pos, count(ret) over (partition by permno order by pos rows unbounded preceding) as history from p"


def d05_medians(spark, folder):
    p = _panel(spark, folder)
    return p.groupBy(F.year("date").alias("yr")).agg(F.round(F.median("ret"), 9).alias("mid"), F.round(F.percentile("ret", F.lit(0.95)), 9).alias("high"), F.round(F.stddev_samp("ret"), 9).alias("sd"), F.round(F.avg((F.col("ret") > 0).cast("double")), 9).alias("up"))


D05 = f"{WITH} select cast(year(date) as integer) as yr, round(median(ret), 9) as mid, round(quantile_cont(ret, 0.95), 9) as high, round(stddev_samp(ret), 9) as sd, round(avg(case when ret > 0 then 1.0::double when ret is not null then 0.0::double end), 9) as up from p group by 1"


def d09_compound(spark, folder):
    return _panel(spark, folder).where("ret > -1").groupBy("permno").agg(F.round(F.product(1 + F.col("ret")) - 1, 6).alias("total"), F.count("*").alias("n"))


D09 = f"{WITH} select permno, round(product(1 + ret) - 1, 6) as total, count(*) as n from p where ret > -1 group by permno"


def d11_sources(spark, folder):
    return _spliced(spark, folder).where("dlret is not null").groupBy("source").agg(F.count("*").alias("n"))


D11 = f"{WITH} select source, count(*) as n from spliced where dlret is not null group by source"


def d12_pivot(spark, folder):
    p = table(spark, folder, "names").groupBy("exchcd").pivot("shrcd", [10, 11]).agg(F.count(F.lit(1)))
    return p.select("exchcd", *(F.coalesce(F.col(str(c)), F.lit(0).cast("bigint")).alias(f"s{c}") for c in (10, 11)))


D12 = "select exchcd, count(*) filter (where shrcd = 10) as s10, count(*) filter (where shrcd = 11) as s11 from names group by exchcd"


def d13_first_rows(spark, folder):
    w = Window.partitionBy("permno").orderBy(F.col("recdt").asc_nulls_last(), "name_id")
    return table(spark, folder, "names").withColumn("n", F.row_number().over(w)).where("n = 1").select("permno", "name_id")


D13 = "select permno, name_id from names qualify row_number() over (partition by permno order by recdt nulls last, name_id) = 1"


def _screened(spark, folder, k):
    dsf = _dsf(spark, folder, "obs_id", "permno", "date", "prc", "shrout").withColumn("mcap", panel.market_value()).where("mcap > 0")
    last = Window.partitionBy("permno", F.last_day("date")).orderBy(F.col("date").desc(), F.col("obs_id").desc())
    monthly = dsf.withColumn("n", F.row_number().over(last)).where("n = 1").select("permno", F.last_day("date").alias("month"), "date", "mcap", "obs_id")
    valid = panel.valid_on_date(monthly, _names(spark, folder))
    top = Window.partitionBy("month").orderBy(F.col("mcap").desc(), "permno", "obs_id")
    return valid.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("permno").distinct()


SCREEN = """
monthly as (select permno, last_day(date) as month, date, abs(prc) * shrout as mcap, obs_id from dsf where abs(prc) * shrout > 0 and not isnan(prc * shrout)
  qualify row_number() over (partition by permno, last_day(date) order by date desc, obs_id desc) = 1),
screened as (select distinct permno from (select permno from monthly join (select permno, namedt, nameendt from names where shrcd in (10, 11) and exchcd in (1, 2, 3)) using (permno)
  where date between namedt and nameendt qualify row_number() over (partition by month order by mcap desc, permno, obs_id) <= {k}))
"""


def d15_screen(spark, folder):
    return _screened(spark, folder, 5)


D15 = f"with {SCREEN.format(k=5)} select permno from screened"
A06 = f"with {SCREEN.format(k=5)} select permno, count(*) as n_rows from dsf where permno in (select permno from screened) group by permno"


def d16_coverage(spark, folder):
    p = _panel(spark, folder)
    held = table(spark, folder, "membership").where("mbrstartdt <= mbrenddt").join(p.select("permno").distinct(), "permno", "left_semi")
    found = panel.coverage(held, p, _days(p), "mbrstartdt", "mbrenddt", ["mbr_id"])
    return found.select("mbr_id", F.round("coverage", 9).alias("coverage"), "n_dates")


D16 = f"""{WITH} select mbr_id, round(avg(case when rets.permno is null then 0.0::double else 1.0::double end), 9) as coverage, count(*) as n_dates
from membership m join cal on cal.date between mbrstartdt and mbrenddt left join rets on rets.permno = m.permno and rets.date = cal.date
where m.permno in (select permno from p) group by mbr_id"""


def d17_worst_span(spark, folder):
    """Per security the worst compound return over 63 rows ahead (fewer at the end)."""
    p = _panel(spark, folder).where("ret > -1")
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(0, 62)
    span = p.withColumn("span", F.exp(F.sum(F.log1p("ret")).over(w)) - 1)
    return span.groupBy("permno").agg(F.round(F.min("span"), 6).alias("worst"))


D17 = f"{WITH} select permno, round(min(span), 6) as worst from (select permno, exp(sum(ln(1 + ret)) over (partition by permno order by pos rows between current row and 62 following)) - 1 as span from p where ret > -1) group by permno"


# windows and the universe ----------------------------------------------------------------------
def e07_wealth(spark, folder):
    p = _panel(spark, folder).where("ret > -1")
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    curve = p.withColumn("wealth", F.sum(F.log1p("ret")).over(w))
    fall = curve.withColumn("fall", F.exp(F.col("wealth") - F.max("wealth").over(w)) - 1)
    return fall.groupBy("permno").agg(F.round(F.min("fall"), 6).alias("max_drawdown"))


E07 = f"""{WITH}, c as (select permno, pos, sum(ln(1 + ret)) over (partition by permno order by pos rows unbounded preceding) as wealth from p where ret > -1)
select permno, round(min(fall), 6) as max_drawdown from (select permno, exp(wealth - max(wealth) over (partition by permno order by pos rows unbounded preceding)) - 1 as fall from c) group by permno"""


def e08_spells(spark, folder):
    names = panel.common_shares(_names(spark, folder))
    return spells.periods(names, ["permno"], F.col("namedt"), F.coalesce("nameendt", F.lit(END).cast("date")), tolerance=5)


def _merged_sql(source: str, start: str, end: str, gap: int, where: str = "true") -> str:
    return f"""
m1 as (select permno, {start} as a, {end} as b, max({end}) over (partition by permno order by {start}, {end} rows between unbounded preceding and 1 preceding) as reach from {source} where {start} <= {end} and permno is not null and {where}),
m2 as (select *, sum(case when reach is null or a > reach + {gap} then 1 else 0 end) over (partition by permno order by a, b rows unbounded preceding) as run from m1),
merged as (select permno, min(a) as startdt, max(b) as enddt from m2 group by permno, run)"""


E08 = f"with {_merged_sql('names', 'namedt', f'''coalesce(nameendt, date '{END}')''', 5, 'shrcd in (10, 11) and exchcd in (1, 2, 3)')} select * from merged"


def i05_link_membership(spark, folder):
    linked = _linked(spark, folder).where("permno is not null")
    return spells.periods(linked, ["permno"], F.col("from_dt"), F.col("thru_dt"), tolerance=1)


I05 = f"with {LINK_SQL}, {_merged_sql('linked', 'from_dt', 'thru_dt', 1)} select * from merged"


def i05_audit(spark, folder):
    got = F.col("permno").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return _linked(spark, folder).agg(F.count("*").alias("n"), count(got).alias("matched"), count(got & (F.col("pref") == 0)).alias("via_history"), count(got & (F.col("pref") == 1)).alias("via_header"))


I05_AUDIT = f"with {LINK_SQL} select count(*) as n, count(permno) as matched, count(*) filter (where permno is not null and pref = 0) as via_history, count(*) filter (where permno is not null and pref = 1) as via_header from linked"


def e13_forward(spark, folder):
    p = _panel(spark, folder).where("ret > -1")
    w = Window.partitionBy("permno").orderBy("pos").rowsBetween(0, 62)
    return p.select("permno", "pos", F.round(F.exp(F.sum(F.log1p("ret")).over(w)) - 1, 6).alias("ahead"))


E13 = f"{WITH} select permno, pos, round(exp(sum(ln(1 + ret)) over (partition by permno order by pos rows between current row and 62 following)) - 1, 6) as ahead from p where ret > -1"


def i01_panel(spark, folder):
    p = _panel(spark, folder)
    return p.select("permno", "pos", "date", F.round("ret", 9).alias("ret"), F.round("mcap", 4).alias("mcap"))


I01 = f"{WITH} select permno, pos, date, round(ret, 9) as ret, round(mcap, 4) as mcap from p"


def setting(spark, folder, rule: universe.UniverseRule, low: int, high: int | None):
    """The panel, the spells as common shares, and the rebalances from ``low`` to ``high`` or to the last position."""
    p = cut(_panel(spark, folder))
    member = spells.periods(panel.common_shares(_names(spark, folder)), ["permno"], F.col("namedt"), F.coalesce("nameendt", F.lit(END).cast("date")), tolerance=5)
    member = member.select("permno", F.col("startdt").alias("mbrstartdt"), F.col("enddt").alias("mbrenddt"))
    last = p.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0] if high is None else high
    return p, member, universe.rebalances(_days(p), low, last, rule.every)


def _setting(spark, folder):
    return setting(spark, folder, RULE, 250, None)


def universe_sql(rule: universe.UniverseRule, low: int, high: int | str) -> str:
    return f"""
with {PANEL_SQL}, {_merged_sql('names', 'namedt', f'''coalesce(nameendt, date '{END}')''', 5, 'shrcd in (10, 11) and exchcd in (1, 2, 3)')},
marks as (select pos, date from cal where pos between {low} and {high} and (pos - {low}) % {rule.every} = 0),
ids as (select distinct permno from p),
cand as (
  select ids.permno, marks.pos, marks.date,
    (select count(ret) from p where p.permno = ids.permno and p.pos <= marks.pos - 1) as history,
    (select arg_max(mcap, p.pos) from p where p.permno = ids.permno and p.pos <= marks.pos - {rule.cap_lag} and mcap is not null) as cap,
    exists (select 1 from p where p.permno = ids.permno and p.pos = marks.pos and ret is not null) as alive
  from ids, marks where exists (select 1 from merged m where m.permno = ids.permno and marks.date between m.startdt and m.enddt)
), elig as (select *, history >= {rule.min_history} as seasoned, history >= {rule.min_history} and alive as eligible from cand),
snap as (select pos, date, row_number() over (partition by pos order by cap desc nulls last, permno) as rank, permno, cap from elig where eligible qualify rank <= {rule.n_assets})
"""


UNIVERSE = universe_sql(RULE, 250, "(select max(pos) from cal)")


def i06_snapshots(spark, folder):
    p, member, marks = _setting(spark, folder)
    return universe.snapshots(p, member, marks, RULE).select("pos", "date", "rank", "permno", F.round("cap", 4).alias("cap"))


I06 = f"{UNIVERSE} select pos, date, cast(rank as integer) as rank, permno, round(cap, 4) as cap from snap"


def i07_sizes(spark, folder):
    p, member, marks = _setting(spark, folder)
    return universe.realised_sizes(p, member, marks, RULE).withColumn("turnover", F.round("turnover", 9))


I07 = f"""{UNIVERSE}, held as (select pos, list(permno) as held, lag(list(permno)) over (order by pos) as before from snap group by pos),
moved as (select pos, len(held) as n_selected, case when before is not null then (len(list_filter(held, lambda x: not list_contains(before, x))) + len(list_filter(before, lambda x: not list_contains(held, x))))::double / (2 * greatest(len(held), len(before), 1)) end as turnover from held)
select e.pos, e.date, count(*) as n_members, cast(sum(case when eligible then 1 else 0 end) as bigint) as n_eligible, coalesce(max(n_selected), 0) as n_selected, cast(sum(case when seasoned then 0 else 1 end) as bigint) as n_unseasoned, round(max(turnover), 9) as turnover
from elig e left join moved using (pos) group by e.pos, e.date"""


def i08_window(spark, folder):
    """The median realised size and the smallest of the windows that it allows."""
    p, member, marks = _setting(spark, folder)
    sizes = universe.realised_sizes(p, member, marks, RULE).agg(F.median("n_selected").alias("mid"))
    choices = F.explode(F.array(*(F.lit(w) for w in (12, 36, 104, 504)))).alias("window")
    return sizes.select("mid", choices).where(F.col("mid") / F.col("window") <= 0.67).groupBy("mid").agg(F.min("window").alias("window"))


I08 = f"""{UNIVERSE}, n as (select pos, count(*) as k from snap group by pos), s as (select pos, coalesce(k, 0) as k from (select distinct pos from elig) left join n using (pos)), m as (select cast(median(k) as double) as mid from s)
select mid, cast(min(w) as integer) as "window" from m, (values (12), (36), (104), (504)) x(w) where mid / w <= 0.67::double group by mid"""


def i09_checks(spark, folder):
    """Reconstruction checks: each with what it measured and its status."""
    p = cut(_panel(spark, folder))
    days = _days(p)
    member = table(spark, folder, "membership").where("mbrstartdt <= mbrenddt")
    ends = days.groupBy(F.last_day("date").alias("m")).agg(F.max("date").alias("date"))
    size = ends.join(member, F.col("date").between(F.col("mbrstartdt"), F.col("mbrenddt"))).groupBy("date").agg(F.countDistinct("permno").alias("n"))
    one = size.agg(F.min("n").cast("double").alias("value")).select(F.lit("index size").alias("check"), "value", F.when(F.col("value") >= 1, "PASS").otherwise("FAIL").alias("status"))
    churn = c17_annual_changes(spark, folder)
    two = churn.agg(F.median("changes").alias("value")).select(F.lit("index turnover").alias("check"), "value", F.when(F.col("value") > 0, "PASS").otherwise("FAIL").alias("status"))
    spliced = _spliced(spark, folder).where("dlret is not null")
    three = spliced.agg(F.count("*").cast("double").alias("value")).select(F.lit("delisting splice").alias("check"), "value", F.when(F.col("value") > 0, "PASS").otherwise("WARN").alias("status"))
    held = member.join(p.select("permno").distinct(), "permno", "left_semi")
    thin = panel.coverage(held, p, days, "mbrstartdt", "mbrenddt", ["mbr_id"]).agg(F.round(F.avg((F.col("coverage") < 0.9).cast("double")), 9).alias("value"))
    four = thin.select(F.lit("coverage").alias("check"), "value", F.when(F.col("value") < 0.05, "PASS").otherwise("FAIL").alias("status"))
    return one.unionByName(two).unionByName(three).unionByName(four)


I09 = f"""{WITH}, size as (select date, count(distinct permno) as n from (select max(date) as date from cal group by last_day(date)) join membership on date between mbrstartdt and mbrenddt group by date),
churn as ({C17}), cov as (select mbr_id, avg(case when rets.permno is null then 0.0::double else 1.0::double end) as c
from membership m join cal on cal.date between mbrstartdt and mbrenddt left join rets on rets.permno = m.permno and rets.date = cal.date where m.permno in (select permno from p) group by mbr_id)
select 'index size' as check, cast(min(n) as double) as value, case when min(n) >= 1 then 'PASS' else 'FAIL' end as status from size
union all select 'index turnover', cast(median(changes) as double), case when median(changes) > 0 then 'PASS' else 'FAIL' end from churn
union all select 'delisting splice', cast(count(*) as double), case when count(*) > 0 then 'PASS' else 'WARN' end from spliced where dlret is not null
union all select 'coverage', round(avg(case when c < 0.9 then 1.0::double else 0.0::double end), 9), case when avg(case when c < 0.9 then 1.0 else 0.0 end) < 0.05 then 'PASS' else 'FAIL' end from cov"""


def i10_failures(spark, folder):
    """Failed securities and whether their panel shows a loss of half in any 63 rows ahead."""
    worst = d17_worst_span(spark, folder)
    failed = table(spark, folder, "delist").where("dlstcd between 500 and 599").select("permno").distinct()
    return worst.join(failed, "permno", "left_semi").select("permno", "worst", (F.col("worst") <= -0.5).alias("booked"))


I10 = f"with w as ({D17}) select permno, worst, worst <= -0.5 as booked from w where permno in (select permno from delist where dlstcd between 500 and 599)"


# scalar functions ------------------------------------------------------------------------------
def h01_identifiers(spark, folder):
    return table(spark, folder, "names").where("ticker is not null").select("name_id", F.lpad(F.upper(F.trim("ticker")), 8, "0").alias("padded"), F.substring(F.upper(F.trim("comnam")), 1, 8).alias("prefix"))


H01 = "select name_id, lpad(upper(trim(ticker)), 8, '0') as padded, substring(upper(trim(comnam)), 1, 8) as prefix from names where ticker is not null"


def h02_format(spark, folder):
    return table(spark, folder, "names").where("comnam is not null").select("name_id", F.format_string("%06d-%s", "permno", F.regexp_extract("comnam", r"([A-Z]+) *$", 1)).alias("label"))


H02 = r"select name_id, format('{:06d}-{}', permno, regexp_extract(comnam, '([A-Z]+) *$', 1)) as label from names where comnam is not null"


def h03_dates(spark, folder):
    return table(spark, folder, "delist").where("dlstdt is not null").select("delist_id", F.year("dlstdt").alias("yr"), F.last_day("dlstdt").alias("month_end"), F.date_add("dlstdt", 5).alias("later"))


H03 = "select delist_id, cast(year(dlstdt) as integer) as yr, last_day(dlstdt) as month_end, dlstdt + 5 as later from delist where dlstdt is not null"


def h04_business_days(spark, folder):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2018-01-01").cast("date"), F.lit(END).cast("date"))).alias("date"))
    return days.where(F.dayofweek("date").between(2, 6)).groupBy(F.year("date").alias("yr")).agg(F.count("*").alias("n"))


H04 = f"select cast(year(d) as integer) as yr, count(*) as n from (select unnest(generate_series(date '2018-01-01', date '{END}', interval 1 day)) as d) where isodow(d) < 6 group by 1"


def h06_open_ends(spark, folder):
    return table(spark, folder, "names").select("name_id", F.coalesce("nameendt", F.lit(END).cast("date")).alias("nameendt"))


H06 = f"select name_id, coalesce(nameendt, date '{END}') as nameendt from names"


def h07_math(spark, folder):
    x = F.col("dlret")
    d = table(spark, folder, "delist").where((x >= -1) & (x < 10))
    return d.select("delist_id", F.round(F.least(F.greatest(F.sqrt(F.abs(x)), F.lit(0.1)), F.lit(0.9)), 9).alias("clipped"), F.round(F.log1p(x + 1), 9).alias("logged"), F.signum(x).alias("sign"), F.ceil(x * 10).cast("bigint").alias("tenths"), F.bround(F.abs(x) * 10).alias("even"))


H07 = "select delist_id, round(least(greatest(sqrt(abs(dlret)), 0.1::double), 0.9::double), 9) as clipped, round(ln(dlret + 2), 9) as logged, cast(sign(dlret) as double) as sign, cast(ceil(dlret * 10) as bigint) as tenths, round_even(abs(dlret) * 10, 0) as even from delist where dlret >= -1 and dlret < 10 and not isnan(dlret)"


def h10_arrays(spark, folder):
    a = table(spark, folder, "membership").groupBy("permno").agg(F.sort_array(F.collect_list("mbr_id")).alias("ids"))
    return a.select("permno", F.size("ids").cast("bigint").alias("n"), F.array_join(F.slice("ids", 1, 2), ",").alias("head"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


H10 = "select permno, len(ids) as n, array_to_string(ids[1:2], ',') as head, cast(list_sum(ids) as bigint) as total from (select permno, list_sort(list(mbr_id)) as ids from membership group by permno)"


def h12_labels(spark, folder):
    """Share code of each permno's newest record by way of a map."""
    n = table(spark, folder, "names").where("shrcd is not null").groupBy("permno").agg(F.max(F.struct("name_id", "shrcd")).alias("x"))
    m = n.groupBy(F.pmod("permno", F.lit(64)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("permno", "x.shrcd"))).alias("codes"))
    d = table(spark, folder, "delist", "delist_id", "permno").withColumn("part", F.pmod("permno", F.lit(64)))
    return d.join(m, "part").select("delist_id", F.try_element_at("codes", "permno").alias("shrcd")).where("shrcd is not null")


H12 = "select delist_id, shrcd from delist join (select permno, arg_max(shrcd, name_id) as shrcd from names where shrcd is not null group by permno) using (permno)"


def h14_sha(spark, folder):
    return table(spark, folder, "names").select("name_id", F.sha2(F.concat_ws("|", F.col("permno").cast("string"), "ticker"), 256).alias("digest"))


H14 = "select name_id, sha256(concat_ws('|', cast(permno as varchar), ticker)) as digest from names"


def h16_seeds(spark, folder):
    grid = spark.range(4).select(F.col("id").alias("env")).withColumn("rep", F.explode(F.expr("sequence(0L, 24L)")))
    return grid.select("env", "rep", (F.lit(20260101) + 1000 * F.col("env") + F.col("rep")).cast("bigint").alias("seed"))


H16 = "select env, rep, cast(20260101 + 1000 * env + rep as bigint) as seed from range(4) a(env), range(25) b(rep)"

QUERIES = {
    f.__name__: f
    for f in (
        a01_scan, a06_two_stage, a07_vintages, b01_ever_valid, b02_valid_on_date, b03_market_value, b04_positive_value, b08_finite, b09_fill, b10_members, b11_inside_names, b12_codes,
        c01_splice, c02_held, c03_constituents, c04_crosswalk, c05_unmatched, c07_memberships, c08_as_of, c09_last_cap, c11_rate, c12_common, c17_annual_changes,
        d01_last_value, d02_history, d05_medians, d09_compound, d11_sources, d12_pivot, d13_first_rows, d15_screen, d16_coverage, d17_worst_span,
        e07_wealth, e08_spells, e13_forward, i01_panel, i05_link_membership, i05_audit, i06_snapshots, i07_sizes, i08_window, i09_checks, i10_failures,
        h01_identifiers, h02_format, h03_dates, h04_business_days, h06_open_ends, h07_math, h10_arrays, h12_labels, h14_sha, h16_seeds,
    )
}
SQL = {
    "a01_scan": A01, "a06_two_stage": A06, "a07_vintages": A07, "b01_ever_valid": B01, "b02_valid_on_date": B02, "b03_market_value": B03, "b04_positive_value": B04, "b08_finite": B08, "b09_fill": B09, "b10_members": B10,
    "b11_inside_names": B11, "b12_codes": B12, "c01_splice": C01, "c02_held": C02, "c03_constituents": C03, "c04_crosswalk": C04, "c05_unmatched": C05, "c07_memberships": C07, "c08_as_of": C08, "c09_last_cap": C09,
    "c11_rate": C11, "c12_common": C12, "c17_annual_changes": C17, "d01_last_value": D01, "d02_history": D02, "d05_medians": D05, "d09_compound": D09, "d11_sources": D11, "d12_pivot": D12, "d13_first_rows": D13,
    "d15_screen": D15, "d16_coverage": D16, "d17_worst_span": D17, "e07_wealth": E07, "e08_spells": E08, "e13_forward": E13, "i01_panel": I01, "i05_link_membership": I05, "i05_audit": I05_AUDIT,
    "i06_snapshots": I06, "i07_sizes": I07, "i08_window": I08, "i09_checks": I09, "i10_failures": I10, "h01_identifiers": H01, "h02_format": H02, "h03_dates": H03, "h04_business_days": H04, "h06_open_ends": H06,
    "h07_math": H07, "h10_arrays": H10, "h12_labels": H12, "h14_sha": H14, "h16_seeds": H16,
}

#: Dates leave as text.
DATES = {
    "b10_members": "date", "c01_splice": "date", "c03_constituents": "from_dt", "c04_crosswalk": "from_dt", "c07_memberships": "date", "c08_as_of": "date", "c11_rate": "date", "d01_last_value": "date",
    "e08_spells": "startdt enddt", "i01_panel": "date", "i05_link_membership": "startdt enddt", "i06_snapshots": "date", "i07_sizes": "date", "h03_dates": "month_end later", "h06_open_ends": "nameendt",
}


def _as_text(query, columns: list[str]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).withColumns({c: text(c) for c in columns})

    run.__doc__ = query.__doc__
    return run


for _name, _columns in DATES.items():
    QUERIES[_name] = _as_text(QUERIES[_name], _columns.split())
    SQL[_name] = f"select * replace ({', '.join(f"strftime({c}, '%Y-%m-%d') as {c}" for c in _columns.split())}) from ({SQL[_name]})"
