"""Tests of triggers and of paired differences, relational where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.linalg import student_quantile

PERIODS = tuple(range(2, 13))


def hashed(*parts: Column) -> Column:
    """A 48-bit integer from a key: the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("bigint")


def schedule_overlap(fired: DataFrame, by: list[str], size: int, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """Per set of positions j in 0..size-1 its largest Jaccard overlap with 'every q-th from r': j_star, q, r.

    Equal overlaps give the smallest q, then r. A position meets one phase per
    period, so counts come from the positions themselves and no set is crossed
    with all schedules.
    """
    total = fired.groupBy(*by).agg(F.countDistinct("j").alias("n"))
    phase = fired.select(*by, "j").distinct().withColumn("q", F.explode(F.array(*map(F.lit, periods)))).withColumn("r", F.pmod("j", "q").cast("int"))
    inter = phase.groupBy(*by, "q", "r").agg(F.count("*").alias("both")).join(total, by)
    there = F.floor((F.lit(size) - 1 - F.col("r")) / F.col("q")) + 1
    overlap = inter.withColumn("jaccard", F.col("both") / (F.col("n") + there - F.col("both")))
    best = overlap.groupBy(*by).agg(F.max(F.struct("jaccard", (-F.col("q")).alias("q"), (-F.col("r")).alias("r"))).alias("x"))
    return best.select(*by, F.col("x.jaccard").alias("j_star"), (-F.col("x.q")).alias("q"), (-F.col("x.r")).alias("r"))


def gaps(fired: DataFrame, by: list[str]) -> DataFrame:
    """Distances between neighbouring positions."""
    return fired.withColumn("gap", F.col("j") - F.lag("j").over(Window.partitionBy(*by).orderBy("j"))).where("gap is not null").select(*by, "j", "gap")


def timing_variation(fired: DataFrame, by: list[str]) -> DataFrame:
    """Per set the variation of its gaps and the share of the commonest; null below two gaps."""
    g = gaps(fired, by)
    shape = g.groupBy(*by).agg(F.count("*").alias("n_gaps"), (F.stddev_samp("gap") / F.avg("gap")).alias("cv"))
    most = g.groupBy(*by, "gap").agg(F.count("*").alias("c")).groupBy(*by).agg((F.max("c") / F.sum("c")).alias("modal"))
    out = shape.join(most, by)
    return out.select(*by, "n_gaps", F.when(F.col("n_gaps") >= 2, F.col("cv")).alias("cv"), F.when(F.col("n_gaps") >= 2, F.col("modal")).alias("modal"))


def median_shift(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median of x where fired less where not; null if either is empty. Nulls of x are left out."""
    side = lambda c: F.median(F.when(c & F.col("x").isNotNull(), F.col("x")))
    return rows.groupBy(*by).agg((side(F.col("fired")) - side(~F.col("fired"))).alias("d"))


def autocorrelations(series: DataFrame, by: list[str], lags: int) -> DataFrame:
    """Per lag 1..lags the autocorrelation of x over t."""
    own = Window.partitionBy(*by)
    c = series.withColumn("c", F.col("x") - F.avg("x").over(own)).withColumn("ss", F.sum(F.col("c") ** 2).over(own))
    early = c.select(*by, "t", "c", "ss").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t") + F.col("k"))
    late = c.select(*by, "t", F.col("c").alias("c2"))
    return early.join(late, [*by, "t"]).groupBy(*by, "k").agg((F.sum(F.col("c") * F.col("c2")) / F.max("ss")).alias("rho"))


def block_length(series: DataFrame, n: int) -> DataFrame:
    """The automatic block length (Politis and White, 2004) of one series x over t = 0..n-1.

    Below eight values or without variance it is 1; at most half of n.
    """
    from math import ceil, log10

    spark = series.sparkSession
    if n < 8:
        return spark.range(1).select(F.lit(1).cast("bigint").alias("block_length"))
    runlength = max(5, ceil(log10(n) ** 0.5))
    lags = min(ceil(n**0.5) + runlength, n - 1)
    bound = 2 * (log10(n) / n) ** 0.5
    rho = autocorrelations(series.withColumn("run", F.lit(0)), ["run"], lags)
    ahead = Window.partitionBy("run").orderBy("k").rowsBetween(0, runlength - 1)
    small = rho.withColumn("most", F.max(F.abs("rho")).over(ahead)).where((F.col("most") < bound) & (F.col("k") <= lags - runlength))
    m = small.groupBy("run").agg(F.min("k").alias("m"))
    kept = rho.join(m, "run", "left").withColumn("top", F.least(2 * F.coalesce("m", F.lit(lags)), F.lit(lags))).where("k <= top")
    share = F.col("k") / F.col("top")
    lam = F.when(share <= 0.5, 1.0).otherwise(F.greatest(F.lit(0.0), 2 * (1 - share)))
    sums = kept.groupBy("run").agg((2 * F.sum(lam * F.col("k") * F.col("rho"))).alias("g"), (2 * F.sum(lam * F.col("rho")) + 1).alias("d"))
    b = F.pow(2 * F.col("g") ** 2 / (2 * F.col("d") ** 2), F.lit(1 / 3)) * n ** (1 / 3)
    length = F.when(F.col("d") == 0, 1.0).otherwise(F.bround(b))
    return sums.select(F.greatest(F.lit(1), F.least(F.coalesce(length, F.lit(1.0)), F.lit(max(1, n // 2)))).cast("bigint").alias("block_length"))


def block_bootstrap(rows: DataFrame, n: int, length: int, replicates: int, seed: str) -> DataFrame:
    """Circular block bootstrap of the median shift: d, p_value, kept.

    ``rows``: t = 0..n-1, x, fired. x and fired are drawn together, in blocks
    of ``length`` at hashed starts. p is one more than the replicates that
    exceed twice d, by one more than those kept; a replicate without both
    classes is not kept.
    """
    spark = rows.sparkSession
    blocks = -(-n // length)
    draws = spark.range(replicates).select(F.col("id").alias("b")).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    start = F.pmod(hashed(F.lit(seed), F.col("b").cast("string"), F.col("block").cast("string")), F.lit(n))
    picks = draws.withColumn("start", start).withColumn("o", F.explode(F.expr(f"sequence(0L, {length - 1}L)"))).where(F.col("block") * length + F.col("o") < n)
    sampled = picks.select("b", F.pmod(F.col("start") + F.col("o"), F.lit(n)).alias("t")).join(rows.select("t", "x", "fired"), "t")
    shifts = median_shift(sampled, ["b"]).where("d is not null").select(F.col("d").alias("d_b"))
    whole = median_shift(rows.withColumn("one", F.lit(1)), ["one"]).first()
    d = whole["d"] if whole else None
    return shifts.agg(F.lit(d).cast("double").alias("d"), ((1 + F.sum(F.when(F.col("d_b") - d >= d, 1).otherwise(0))) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("kept"))


def holm(p: DataFrame, by: list[str]) -> DataFrame:
    """Step-down adjusted p-values of each family; a p that is null or not finite stays null and is not counted."""
    ok = F.col("p").isNotNull() & ~F.isnan("p") & (F.abs("p") < float("inf"))
    order = Window.partitionBy(*by, "ok").orderBy("p", "key")
    ranked = p.withColumn("ok", ok).withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy(*by, "ok")))
    step = F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p"))
    return ranked.withColumn("step", step).withColumn("p_holm", F.when(F.col("ok"), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).select(*by, "key", "p", "p_holm")


def t_quantiles(n_most: int, confidence: float) -> list[tuple[int, float]]:
    return [(n, student_quantile(confidence, n - 1)) for n in range(2, n_most + 1)]


def paired_bounds(d: DataFrame, by: list[str], margin: float, confidence: float = 0.95, n_most: int = 2000) -> DataFrame:
    """One-sided bounds of a mean difference d and what they say of ``margin``: mean, upper, lower, n, verdict."""
    spark = d.sparkSession
    ok = d.where(F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf")))
    stats = ok.groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    sizes = [r["n"] for r in stats.select("n").distinct().collect()]
    known = spark.createDataFrame([(n, student_quantile(confidence, n - 1) if n > 1 else None) for n in sizes] or [(0, None)], "n int, tq double")
    half = F.col("tq") * F.col("sd") / F.sqrt("n")
    out = stats.join(F.broadcast(known), "n").withColumn("upper", F.col("mean") + half).withColumn("lower", F.col("mean") - half)
    verdict = F.when(F.col("upper") <= margin, "PASS").when(F.col("lower") > margin, "FAIL").otherwise("INCONCLUSIVE")
    return out.select(*by, "mean", "upper", "lower", F.col("n").cast("bigint").alias("n"), verdict.alias("verdict"))


def location_shift(d: DataFrame, by: list[str], delta: float) -> DataFrame:
    """Differences moved so that their mean is ``delta``."""
    return d.withColumn("d", F.col("d") - F.avg("d").over(Window.partitionBy(*by)) + delta)


def average_rank(column: str, by: list[str]) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(column))
    return first + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation; null where either has no variance."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("ra", average_rank(a, by)).withColumn("rb", average_rank(b, by))
    return r.groupBy(*by).agg(F.corr("ra", "rb").alias("rho"))
