"""The training-data queries of the core, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import bitemporal, impute, orphans, rolling, spells, spikes
from panelforge.operators.latest import valid_rows
from panelforge.session import cut
from panelforge.sources import table

SAMPLE_END = "2024-12-31"


def text(day: str) -> F.Column:
    return F.date_format(day, "yyyy-MM-dd")


def p1_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Trailing 7 and 30 day totals of ret for each permno and calendar day."""
    dsf = table(spark, folder, "dsf", "obs_id", "permno", "lineno", "date", "ret", "loadts")
    day = valid_rows(dsf, "ret").groupBy(F.col("permno").alias("entity"), F.col("date").alias("day"))
    daily = day.agg(F.coalesce(F.sum("ret"), F.lit(0.0)).alias("sum"), F.count("ret").alias("n"), F.max("ret").alias("max"), F.min("ret").alias("min"))
    daily = daily.withColumn("max", F.coalesce("max", F.lit(float("-inf")))).withColumn("min", F.coalesce("min", F.lit(float("inf"))))
    bounds = daily.where("day is not null").groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    totals = rolling.rolling_totals(daily, bounds)
    named = [f"{x}_{w}" for w in (7, 30) for x in ("sum", "n", "avg", "max", "min")]
    return totals.select(F.col("entity").alias("permno"), text("day").alias("date"), *named)


P1_SQL = """
with valid as (
  select permno, date, case when isnan(ret) then null else ret end as ret
  from dsf where permno is not null and date is not null
  qualify row_number() over (partition by permno, lineno, date order by loadts desc nulls last, obs_id desc) = 1
), daily as (
  select permno, date, sum(ret) as s, count(ret) as n, max(ret) as hi, min(ret) as lo from valid group by all
), days as (
  select permno, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from daily group by permno
), rolled as (
  select permno, date,
    sum(s) over w7 as s7, coalesce(sum(n) over w7, 0) as n7, max(hi) over w7 as hi7, min(lo) over w7 as lo7,
    sum(s) over w30 as s30, coalesce(sum(n) over w30, 0) as n30, max(hi) over w30 as hi30, min(lo) over w30 as lo30
  from days left join daily using (permno, date)
  window w7 as (partition by permno order by date rows 6 preceding), w30 as (partition by permno order by date rows 29 preceding)
)
select permno, strftime(date, '%Y-%m-%d') as date,
  round(coalesce(s7, 0), 9) as sum_7, cast(n7 as bigint) as n_7, case when n7 > 0 then round(s7, 9) / n7 end as avg_7, hi7 as max_7, lo7 as min_7,
  round(coalesce(s30, 0), 9) as sum_30, cast(n30 as bigint) as n_30, case when n30 > 0 then round(s30, 9) / n30 end as avg_30, hi30 as max_30, lo30 as min_30
from rolled
"""


def fill_delistings(delist: DataFrame) -> DataFrame:
    """Every row of ``delist`` with dlret and dlstcd filled, and how.

    Disguised values (NaN, a dlret below -1 or not finite, a dlstcd outside 100
    to 699) count as missing. Rows are kept one for one, repeated ones too.
    Losses are compared on a log scale, as most are near 0 or near all. The
    parents are the hundred of dlstcd, the size of dlret and the year.
    """
    sound = delist.withColumn("dlret", F.when((F.col("dlret") >= -1) & (F.col("dlret") < float("inf")), F.col("dlret"))).withColumn("dlstcd", F.when(F.col("dlstcd").between(100, 699), F.col("dlstcd")))
    features = (
        sound.withColumn("kind", F.floor(F.col("dlstcd") / 100).cast("string"))
        .withColumn("code", F.col("dlstcd").cast("string"))
        .withColumn("loss", F.signum("dlret") * F.log1p(F.abs("dlret") / 0.02))
        .withColumn("size", F.when(F.col("dlret") < -0.2, "loss").when(F.col("dlret").isNotNull(), "kept"))
        .withColumn("year", F.year("dlstdt"))
    )
    model = impute.KPrototypes(["loss"], {"kind": 4.0, "code": 25.0, "size": 1.0}, k=40)
    return impute.fill_missing(features, {"dlret": "median", "dlstcd": "mode"}, model, ["kind", "size", "year"])


def p2_filled(spark: SparkSession, folder: str) -> DataFrame:
    """delist with dlret and dlstcd filled, and how."""
    out = fill_delistings(table(spark, folder, "delist"))
    return out.select("delist_id", "permno", text("dlstdt").alias("dlstdt"), "dlret_filled", "dlret_method", "dlstcd_filled", "dlstcd_method")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of delist that were filled."""
    filled = p2_filled(spark, folder)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_method").alias("method")) for c in ("dlret", "dlstcd")))).alias("x")
    return filled.select("delist_id", cells).where("x.method is not null").select("delist_id", "x.field")


P2_SQL = """
select delist_id, 'dlret' as field from delist where dlret is null or isnan(dlret) or not dlret >= -1 or isinf(dlret)
union all
select delist_id, 'dlstcd' as field from delist where dlstcd is null or dlstcd not between 100 and 699
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The implausible readings of dsf."""
    return spikes.readings(table(spark, folder, "dsf")).select("obs_id", "field")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Readings, flags and mean scores per field and year."""
    scored = spikes.readings(table(spark, folder, "dsf"), everything=True)
    return scored.groupBy("field").agg(F.count("*").alias("readings"), F.sum(F.col("flagged").cast("bigint")).alias("flagged"), F.round(F.avg("score"), 6).alias("mean_score"))


def _references(spark: SparkSession, folder: str) -> DataFrame:
    dsf = table(spark, folder, "dsf", "obs_id", "permno", "date", "loadts")
    delist = table(spark, folder, "delist", "delist_id", "permno", "dlstdt", "recdt")
    one = dsf.select(F.lit("dsf").alias("tab"), F.col("obs_id").alias("row_id"), F.col("permno").alias("key"), F.col("date").alias("day"), F.to_date("loadts").alias("arrival"))
    two = delist.select(F.lit("delist").alias("tab"), F.col("delist_id").alias("row_id"), F.col("permno").alias("key"), F.col("dlstdt").alias("day"), F.col("recdt").alias("arrival"))
    return one.unionByName(two)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "names", "permno", "namedt", "recdt", "wddt")
    return names.select(F.col("permno").alias("key"), F.col("namedt").alias("valid"), F.col("recdt").alias("known"), F.col("wddt").alias("gone"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of dsf and delist whose permno names does not support, with the reason."""
    rows = orphans.orphan_rows(_records(spark, folder), _references(spark, folder), "tab", "row_id")
    return rows.select("tab", "row_id", F.date_format("day", "yyyy-MM").alias("period"), "reason")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan rows per table, month and reason."""
    return p4_found(spark, folder).groupBy("tab", "period", "reason").agg(F.count("*").alias("n_rows"))


P4_SQL = """
with known as (
  select permno, count(*) as n, count(*) filter (where wddt is null) as live, min(namedt) as first_valid, min(recdt) as first_known
  from names where permno is not null group by permno
), refs as (
  select 'dsf' as tab, obs_id as row_id, permno, date as day, cast(loadts as date) as arrival from dsf
  union all
  select 'delist', delist_id, permno, dlstdt, recdt from delist
), judged as (
  select tab, row_id, strftime(day, '%Y-%m') as period,
    case when n is null then 'missing' when live = 0 then 'withdrawn' when day < first_valid then 'early' when first_known > arrival then 'late' end as reason
  from refs left join known using (permno) where refs.permno is not null
)
select tab, row_id, period, reason from judged where reason is not null
"""
P4_REPORT_SQL = f"select tab, period, reason, count(*) as n_rows from ({P4_SQL}) group by all"


def p4_state(spark: SparkSession, folder: str, first_load: str = "2021-12-31") -> DataFrame:
    """The orphan keys, from counts kept over two loads.

    The first load holds what was known by ``first_load``. The second holds the
    records, withdrawals and referring rows that came later, so a record of the
    first may be withdrawn in the second.
    """
    records, rows = _records(spark, folder), _references(spark, folder)
    early = lambda c: F.coalesce(F.col(c) <= F.lit(first_load).cast("date"), F.lit(True))
    gone = records.where("gone is not null")

    def load(held) -> DataFrame:
        return orphans.made(records.where(held("known"))).unionByName(orphans.withdrawn(gone.where(held("gone")))).unionByName(orphans.referred(rows.where(held("arrival"))))

    former = cut(orphans.merge_counts(load(early)))
    counts = orphans.merge_counts(former, load(lambda c: ~early(c)))
    return orphans.orphan_keys(counts).withColumnRenamed("key", "permno")


P4_STATE_SQL = """
with refs as (
  select permno, count(*) as refs from (select permno from dsf union all select permno from delist) where permno is not null group by permno
), known as (
  select permno, count(*) filter (where wddt is null) as live from names group by permno
)
select permno, refs, case when live is null then 'missing' else 'withdrawn' end as reason from refs left join known using (permno) where coalesce(live, 0) = 0
"""


def _as_known(spark: SparkSession, folder: str) -> DataFrame:
    dsf = table(spark, folder, "dsf", "obs_id", "permno", "date")
    # a record matters only for securities that have rows; names holds many more
    held = cut(dsf.groupBy("permno").agg(F.min(F.unix_date("date")).alias("first"), F.max(F.unix_date("date")).alias("last")))
    ends = held.agg(F.min("first"), F.max("last")).first()
    span = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    held = held.select("permno")
    names = table(spark, folder, "names").join(held, "permno", "left_semi")
    spells_ = table(spark, folder, "membership").join(held, "permno", "left_semi")
    c = F.col
    index = {
        "nam": bitemporal.rectangle_index(names, "permno", c("namedt"), c("nameendt"), c("recdt"), c("wddt"), "name_id", ["shrcd", "exchcd"], span),
        "mbr": bitemporal.rectangle_index(spells_, "permno", c("mbrstartdt"), c("mbrenddt"), c("recdt"), F.lit(None).cast("date"), "mbr_id", [], span),
    }
    return bitemporal.as_known(dsf, "permno", "date", index)


def p5_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Every dsf row with shrcd, exchcd and membership as known on its date."""
    rows = _as_known(spark, folder)
    return rows.select("obs_id", text("date").alias("date"), F.col("nam_then.id").alias("name_id"), F.col("nam_then.shrcd").alias("shrcd"), F.col("nam_then.exchcd").alias("exchcd"), F.col("mbr_then").isNotNull().alias("member"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The dsf rows for which later knowledge differs, with the records as then known."""
    rows = _as_known(spark, folder)
    same = F.col("nam_then.shrcd").eqNullSafe(F.col("nam_now.shrcd")) & F.col("nam_then.exchcd").eqNullSafe(F.col("nam_now.exchcd"))
    both = F.col("nam_then").isNull() == F.col("nam_now").isNull()
    member = F.col("mbr_then").isNull() == F.col("mbr_now").isNull()
    return rows.where(~same | ~both | ~member).select("obs_id", F.coalesce("nam_then.id", F.lit(0).cast("bigint")).alias("name_id"), F.coalesce("mbr_then.id", F.lit(0).cast("bigint")).alias("mbr_id"))


_VIEWS = """
with n_then as (
  select obs_id, name_id, shrcd, exchcd from dsf join names using (permno)
  where namedt <= date and (nameendt is null or nameendt >= date) and recdt <= date and (wddt is null or wddt > date)
  qualify row_number() over (partition by obs_id order by recdt desc, name_id desc) = 1
), n_now as (
  select obs_id, name_id, shrcd, exchcd from dsf join names using (permno)
  where namedt <= date and (nameendt is null or nameendt >= date) and wddt is null
  qualify row_number() over (partition by obs_id order by recdt desc nulls last, name_id desc) = 1
), m_then as (
  select obs_id, mbr_id from dsf join membership using (permno)
  where mbrstartdt <= date and (mbrenddt is null or mbrenddt >= date) and recdt <= date
  qualify row_number() over (partition by obs_id order by recdt desc, mbr_id desc) = 1
), m_now as (
  select distinct obs_id from dsf join membership using (permno)
  where mbrstartdt <= date and (mbrenddt is null or mbrenddt >= date)
)
"""
P5_SQL = (
    _VIEWS
    + """
select d.obs_id, coalesce(a.name_id, 0) as name_id, coalesce(m.mbr_id, 0) as mbr_id
from dsf d left join n_then a using (obs_id) left join n_now b using (obs_id) left join m_then m using (obs_id) left join m_now n on n.obs_id = d.obs_id
where a.shrcd is distinct from b.shrcd or a.exchcd is distinct from b.exchcd or (a.name_id is null) <> (b.name_id is null) or (m.mbr_id is null) <> (n.obs_id is null)
"""
)
P5_ASOF_SQL = (
    _VIEWS
    + """
select d.obs_id, strftime(d.date, '%Y-%m-%d') as date, a.name_id, a.shrcd, a.exchcd, m.mbr_id is not null as member
from dsf d left join n_then a using (obs_id) left join m_then m using (obs_id)
"""
)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of names and membership."""
    names = table(spark, folder, "names", "permno", "namedt", "nameendt")
    member = table(spark, folder, "membership", "permno", "mbrstartdt", "mbrenddt")
    both = names.select(F.lit("names").alias("tab"), "permno", F.col("namedt").alias("a"), F.coalesce("nameendt", F.lit(SAMPLE_END).cast("date")).alias("b")).unionByName(
        member.select(F.lit("membership").alias("tab"), "permno", F.col("mbrstartdt").alias("a"), F.col("mbrenddt").alias("b"))
    )
    found = spells.periods_and_gaps(both, ["tab", "permno"], F.col("a"), F.col("b"))
    return found.select("tab", "kind", "permno", text("startdt").alias("startdt"), text("enddt").alias("enddt"))


P7_SQL = f"""
with spells as (
  select 'names' as tab, permno, namedt as a, coalesce(nameendt, date '{SAMPLE_END}') as b from names
  union all
  select 'membership', permno, mbrstartdt, mbrenddt from membership
), marked as (
  select *, max(b) over (partition by tab, permno order by a, b rows between unbounded preceding and 1 preceding) as reach
  from spells where a <= b and permno is not null
), numbered as (
  select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by tab, permno order by a, b rows unbounded preceding) as run from marked
), runs as (
  select tab, permno, min(a) as a, max(b) as b from numbered group by tab, permno, run
), following as (
  select *, lead(a) over (partition by tab, permno order by a) as follows from runs
)
select tab, 'period' as kind, permno, strftime(a, '%Y-%m-%d') as startdt, strftime(b, '%Y-%m-%d') as enddt from following
union all
select tab, 'gap', permno, strftime(b + 1, '%Y-%m-%d'), strftime(follows - 1, '%Y-%m-%d') from following where follows is not null
"""

QUERIES = {f.__name__: f for f in (p1_rolling, p2_found, p2_filled, p3_found, p3_scores, p4_found, p4_report, p4_state, p5_found, p5_asof, p7_found)}
SQL = {"p1_rolling": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p4_state": P4_STATE_SQL, "p5_found": P5_SQL, "p5_asof": P5_ASOF_SQL, "p7_found": P7_SQL}
