"""Second moments in relational form: rows (t, i, x) in, pairs (i, k, s) out.

Pairs come from one self-join on the date, aggregated at once; nothing is
centred by a second pass, since centred moments follow from raw ones. A frame
may hold many windows at once: ``by`` names the columns that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import cut


def pair_moments(x: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Per pair i, k the weighted sums of 1, x_i, x_k and x_i x_k (weights 1 unless named)."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1.0)
    left = x.select(*by, "t", "i", F.col("x").alias("a"), w.alias("w"))
    right = x.select(*by, "t", F.col("i").alias("k"), F.col("x").alias("b"))
    return left.join(right, [*by, "t"]).groupBy(*by, "i", "k").agg(
        F.sum("w").alias("w"), F.count("*").alias("n"), F.sum(F.col("w") * F.col("a")).alias("wa"), F.sum(F.col("w") * F.col("b")).alias("wb"), F.sum(F.col("w") * F.col("a") * F.col("b")).alias("wab")
    )


def covariance(x: DataFrame, by: list[str] = (), ddof: int = 1) -> DataFrame:
    """Sample covariance by pair."""
    m = pair_moments(x, by)
    return m.select(*by, "i", "k", ((F.col("wab") - F.col("wa") * F.col("wb") / F.col("n")) / (F.col("n") - ddof)).alias("s"))


def linear_shrinkage(x: DataFrame, by: list[str] = ()) -> DataFrame:
    """Covariance shrunk to a scaled identity; adds the intensity ``shrink``.

    The summed squared distance of daily outer products from S is the sum of
    fourth powers of centred row norms less T times the squared norm of S.
    """
    by = list(by)
    s = covariance(x, by, ddof=0)
    scalars = s.groupBy(*by).agg(
        (F.sum(F.when(F.col("i") == F.col("k"), F.col("s"))) / F.sqrt(F.count("*"))).alias("mu"), F.sum(F.col("s") ** 2).alias("ss"), F.sqrt(F.count("*")).alias("n"), F.sum(F.when(F.col("i") == F.col("k"), F.col("s"))).alias("trace")
    )
    own = Window.partitionBy(*by, "i")
    norms = x.withColumn("c", F.col("x") - F.avg("x").over(own)).groupBy(*by, "t").agg(F.sum(F.col("c") ** 2).alias("q")).groupBy(*by).agg(F.sum(F.col("q") ** 2).alias("qq"), F.count("*").cast("double").alias("days"))
    key = by or ["__one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("__one", F.lit(1)))
    both = one(scalars).join(one(norms), key)
    d2 = F.col("ss") - F.col("n") * F.col("mu") ** 2
    b2 = F.least((F.col("qq") - F.col("days") * F.col("ss")) / F.col("days") ** 2, d2)
    both = both.withColumn("shrink", F.when(d2 > 0, b2 / d2).otherwise(0.0))
    out = one(s).join(both.select(*key, "mu", "shrink"), key)
    target = F.when(F.col("i") == F.col("k"), F.col("mu")).otherwise(0.0)
    return out.select(*by, "i", "k", (F.col("shrink") * target + (1 - F.col("shrink")) * F.col("s")).alias("s"), "shrink")


def decay_weights(x: DataFrame, alpha: float, days: int) -> DataFrame:
    """``x`` with ``w``: exponential weights over ``days`` rows, the newest t heaviest, summing to 1."""
    age = F.lit(days - 1) - F.col("t")
    w = F.lit(1.0 / days) if alpha == 1.0 else (1 - alpha) / (1 - alpha**days) * F.pow(F.lit(alpha), age)
    return x.withColumn("w", w)


def effective_size(x: DataFrame, by: list[str] = ()) -> DataFrame:
    """One by the sum of squared weights, and the sum of weights."""
    w = x.select(*by, "t", "w").distinct()
    return w.groupBy(*by).agg((1 / F.sum(F.col("w") ** 2)).alias("n_eff"), F.sum("w").alias("total"))


def weighted_covariance(x: DataFrame, by: list[str] = ()) -> DataFrame:
    """Covariance about the weighted mean, weights ``w`` summing to 1."""
    m = pair_moments(x, by, weight="w")
    return m.select(*by, "i", "k", (F.col("wab") - F.col("wa") * F.col("wb")).alias("s"))


def _scales(s: DataFrame, by: list[str]) -> DataFrame:
    """Pairs with the variances of both sides."""
    own = s.where("i = k")
    one = own.select(*by, "i", F.col("s").alias("s_ii"))
    two = own.select(*by, F.col("i").alias("k"), F.col("s").alias("s_kk"))
    return s.join(one, [*by, "i"]).join(two, [*by, "k"])


def correlation(s: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pairs (i, k, r) of a covariance, the diagonal 1, clipped to -1..1."""
    both = _scales(s, list(by))
    guard = lambda c: F.when(F.sqrt(c) > 0, F.sqrt(c)).otherwise(1e-12)
    r = F.when(F.col("i") == F.col("k"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / (guard("s_ii") * guard("s_kk")))))
    return both.select(*by, "i", "k", r.alias("r"))


def correlation_distance(s: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pairs (i, k, d): the root of half of one less the correlation."""
    return correlation(s, by).select(*by, "i", "k", F.when(F.col("i") == F.col("k"), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.col("r"))))).alias("d"))


def constant_correlation(s: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pairs with the target f of equal correlations, and the mean correlation rbar."""
    by = list(by)
    both = _scales(s, by).withColumn("g", F.sqrt(F.greatest("s_ii", F.lit(1e-300))) * F.sqrt(F.greatest("s_kk", F.lit(1e-300))))
    key = by or ["__one"]
    both = both if by else both.withColumn("__one", F.lit(1))
    mean = both.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("i") != F.col("k"), F.col("s") / F.col("g"))), F.lit(0.0)).alias("rbar"))
    out = both.join(mean, key)
    return out.select(*by, "i", "k", "s", "s_ii", "s_kk", F.when(F.col("i") == F.col("k"), F.col("s")).otherwise(F.col("rbar") * F.col("g")).alias("f"), "rbar")


def weighted_sums(x: DataFrame, by: list[str] = ()) -> DataFrame:
    """Pairs with the weighted means of y_i y_k (s), of its square (q) and of y_i^3 y_k (c), in one pass over days and pairs."""
    by = list(by)
    own = Window.partitionBy(*by, "i")
    y = x.withColumn("x", F.col("x") - F.sum(F.col("w") * F.col("x")).over(own))
    left = y.select(*by, "t", "i", F.col("x").alias("a"), "w")
    right = y.select(*by, "t", F.col("i").alias("k"), F.col("x").alias("b"))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    return left.join(right, [*by, "t"]).groupBy(*by, "i", "k").agg(F.sum(w * a * b).alias("s"), F.sum(w * a**2 * b**2).alias("q"), F.sum(w * a**3 * b).alias("c"))


def shrinkage_intensity(x: DataFrame, by: list[str] = (), sums: DataFrame | None = None) -> DataFrame:
    """pi, rho, gamma, kappa, delta, n_eff and rbar of weighted rows, in moment form.

    pi_ik is the weighted mean of y_i^2 y_k^2 less s_ik^2, and theta_ik that of
    y_i^3 y_k less s_ii s_ik, so no array over days and pairs is made.
    """
    by = list(by)
    sums = cut(weighted_sums(x, by)) if sums is None else sums  # a row a pair, read four times below
    target = constant_correlation(sums.select(*by, "i", "k", "s"), by)
    both = target.join(sums.select(*by, "i", "k", "q", "c"), [*by, "i", "k"])
    pi = F.col("q") - F.col("s") ** 2
    theta = F.col("c") - F.col("s_ii") * F.col("s")
    ratio = F.sqrt(F.greatest("s_kk", F.lit(1e-300))) / F.sqrt(F.greatest("s_ii", F.lit(1e-300)))
    off = F.col("i") != F.col("k")
    out = both.groupBy(*by).agg(
        F.sum(pi).alias("pi"), F.sum(F.when(~off, pi)).alias("pi_own"), F.sum(F.when(off, ratio * theta)).alias("cross"), F.sum((F.col("f") - F.col("s")) ** 2).alias("gamma"), F.max("rbar").alias("rbar")
    )
    n_eff = effective_size(x, by).select(*by, "n_eff")
    key = by or ["__one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("__one", F.lit(1)))
    out = one(out).join(one(n_eff), key)
    out = out.withColumn("rho", F.col("pi_own") + F.col("rbar") * F.col("cross"))  # both orders of a pair, each by half
    out = out.withColumn("kappa", F.when(F.col("gamma") > 0, (F.col("pi") - F.col("rho")) / F.col("gamma")).otherwise(0.0))
    return out.select(*by, "pi", "rho", "gamma", "kappa", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("kappa") / F.col("n_eff"))).alias("delta"), "n_eff", "rbar")


def decayed_shrinkage(x: DataFrame, alpha: float, days: int, by: list[str] = ()) -> DataFrame:
    """Exponentially weighted covariance shrunk to equal correlations."""
    by = list(by)
    weighted = decay_weights(x, alpha, days)
    sums = cut(weighted_sums(weighted, by))
    delta = shrinkage_intensity(weighted, by, sums).select(*by, "delta")
    target = constant_correlation(sums.select(*by, "i", "k", "s"), by)
    key = by or ["__one"]
    one = (lambda d: d) if by else (lambda d: d.withColumn("__one", F.lit(1)))
    out = one(target).join(one(delta), key)
    return out.select(*by, "i", "k", ((1 - F.col("delta")) * F.col("s") + F.col("delta") * F.col("f")).alias("s"))


def partition_scores(labels: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Per ``by`` the adjusted Rand index and variation of information of labels ``a`` and ``b``.

    Rows with a null label count for neither; equal partitions have ari 1 and vi 0.
    """
    joint = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n_ab"))
    wa, wb, whole = Window.partitionBy(*by, a), Window.partitionBy(*by, b), Window.partitionBy(*by)
    cells = joint.withColumn("n_a", F.sum("n_ab").over(wa)).withColumn("n_b", F.sum("n_ab").over(wb)).withColumn("n", F.sum("n_ab").over(whole))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    share = F.col("n_ab") / F.col("n")
    sums = cells.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(two("n_ab")).alias("ij"), F.sum(two("n_a") * F.col("n_ab") / F.col("n_a")).alias("ai"), F.sum(two("n_b") * F.col("n_ab") / F.col("n_b")).alias("bj"),
        F.sum(-share * F.ln(F.col("n_a") / F.col("n"))).alias("ha"), F.sum(-share * F.ln(F.col("n_b") / F.col("n"))).alias("hb"), F.sum(share * F.ln(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))).alias("mi"),
    )
    expected = F.when(F.col("n") > 1, F.col("ai") * F.col("bj") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0)
    spread = 0.5 * (F.col("ai") + F.col("bj")) - expected
    ari = F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("ij") - expected) / spread)
    return sums.select(*by, F.col("n").cast("bigint").alias("n"), ari.alias("ari"), F.greatest(F.lit(0.0), F.col("ha") + F.col("hb") - 2 * F.col("mi")).alias("vi"))
