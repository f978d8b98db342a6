"""Histograms and tests as columns and DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.plans.ranges import dealt, join_parts

STEPS = 400


def _log_gamma_half(n: Column) -> Column:
    """log of gamma(n / 2) for whole n."""
    odd = n % 2 == 1
    steps = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: ((n - k) % 2 == 0) & (k < n) & (k > 0))
    return F.aggregate(steps, F.when(odd, math.log(math.pi) / 2).otherwise(0.0), lambda a, k: a + F.log(k / 2.0))


def _even_tail(z: Column, df: Column) -> Column:
    """exp(-z) times the sum of z ** k / k! for k below df / 2: the tail for even degrees of freedom, term by term."""
    first = F.struct(F.exp(-z).alias("t"), F.exp(-z).alias("s"))
    more = F.filter(F.sequence(F.lit(0), F.greatest((df / 2).cast("int") - 1, F.lit(0))), lambda k: k > 0)
    return F.aggregate(more, first, lambda q, k: F.struct((q["t"] * z / k).alias("t"), (q["s"] + q["t"] * z / k).alias("s")), lambda q: q["s"])


def chi_squared_tail(x: Column, df: Column) -> Column:
    """Chance of a chi-squared value of at least ``x``; for small even degrees of freedom a finite sum, else the
    incomplete gamma function by its series for small values and by its continued fraction for large ones."""
    a, z = df / 2.0, x / 2.0
    scale = F.exp(-z + a * F.log(z) - _log_gamma_half(df.cast("int")))
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    first = F.struct((1 / a).alias("t"), (1 / a).alias("s"))
    series = F.aggregate(steps, first, lambda q, n: F.struct((q["t"] * z / (a + n)).alias("t"), (q["s"] + q["t"] * z / (a + n)).alias("s")), lambda q: q["s"]) * scale
    down = F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(down, z + 2.0 * STEPS + 1 - a, lambda f, n: z + 2.0 * n - 1 - a - n * (n - a) / f)
    # exp(-z) is a normal number up to 700, so no term of the sum is lost
    finite = (df % 2 == 0) & (df > 0) & (df <= 2 * STEPS) & (z <= 700)
    return F.when(x <= 0, 1.0).when(finite, _even_tail(z, df)).when(z < a + 1, 1 - series).otherwise(scale / fraction)


def stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")


def log_likelihood(complex_ll: Column, complex_n: Column, simple_ll: Column, simple_n: Column, level: float = 0.05) -> Column:
    """chi, df, p and whether it passes, for nested models; a simple model that fits better is an error."""
    chi, df = 2 * (complex_ll - simple_ll), complex_n - simple_n
    bad = F.when(chi < 0, F.raise_error(F.lit("the complex model fits worse"))).when(df <= 0, F.raise_error(F.lit("no degrees of freedom")))
    p = chi_squared_tail(chi, df)
    return F.when(bad.isNotNull(), None).otherwise(F.struct(chi.alias("chi"), df.alias("df"), p.alias("p"), (p < level).alias("passed")))


def chi_squared_test(counts: DataFrame, row: str, category: str, n: str, level: float = 0.05) -> DataFrame:
    """One row: chi, df, p, passed, stars, sample, phi of a table of two rows. An expected count below 1, or more
    than a fifth of them below 5, is an error (the row of the larger name holds the expected ones)."""
    cells = counts.select(row, category, F.col(n).cast("double").alias("_v"))
    by_row, by_col = cells.groupBy(row).agg(F.sum("_v").alias("_r")), cells.groupBy(category).agg(F.sum("_v").alias("_c"))
    total = cells.agg(F.sum("_v").alias("_t"), F.countDistinct(category).alias("_k"), F.countDistinct(row).alias("rows"), F.max(row).alias("last"))
    every = by_row.crossJoin(by_col).crossJoin(total).join(cells, [row, category], "left").fillna(0.0, ["_v"])
    right = F.when(F.col("_k") == 2, 0.25).otherwise(0.0)
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    low = F.when(F.col(row) == F.col("last"), F.col("_v"))
    one = every.agg(
        F.sum((F.abs(F.col("_v") - expected) - right) ** 2 / expected).alias("chi"), (F.max("_k") - 1).alias("df"), F.max("_t").alias("sample"),
        F.max("rows").alias("rows"), F.min(low).alias("least"), (F.sum((low < 5).cast("int")) / F.max("_k")).alias("few"),
    )
    wrong = F.when(F.col("rows") != 2, F.raise_error(F.lit("not two rows"))).when(F.col("least") < 1, F.raise_error(F.lit("expected counts below 1"))).when(F.col("few") > 0.2, F.raise_error(F.lit("over a fifth of the expected counts below 5")))
    p = chi_squared_tail(F.col("chi"), F.col("df"))
    return one.where(wrong.isNull()).select("chi", "df", p.alias("p"), (p < level).alias("passed"), stars(p).alias("stars"), "sample", F.sqrt(F.col("chi") / F.col("sample")).alias("phi"))


def binomial_chi(p: Column, sample: Column, observed: Column, level: float = 0.05) -> Column:
    """chi, p, phi and whether it passes: an observed count against a share of a sample, one degree of freedom."""
    chi = (observed - p * sample) ** 2 / (p * sample)
    tail = chi_squared_tail(chi, F.lit(1))
    return F.struct(chi.alias("chi"), tail.alias("p"), F.sqrt(chi / sample).alias("phi"), (tail < level).alias("passed"))


def welch(n1: Column, mean1: Column, sd1: Column, n2: Column, mean2: Column, sd2: Column) -> Column:
    """z and degrees of freedom of two means with population deviations."""
    a, b = sd1**2 * n1 / (n1 - 1) / n1, sd2**2 * n2 / (n2 - 1) / n2
    return F.when((sd1 == 0) & (sd2 == 0), F.raise_error(F.lit("standard deviations are 0")).cast("struct<z:double,df:double>")).otherwise(
        F.struct((F.abs(mean1 - mean2) / F.sqrt(a + b)).alias("z"), ((a + b) ** 2 / (a**2 / (n1 - 1) + b**2 / (n2 - 1))).alias("df"))
    )


def rank_sum(values: DataFrame, group: str, value: str) -> DataFrame:
    """(n1, n2, u, z, p): ranks of the group of the smaller name, equal values sharing the mean of their ranks; the
    tail of the normal distribution with the correction for ties. Values are counted before they are ranked."""
    low = values.agg(F.min(group)).first()[0]
    tied = values.groupBy(F.col(value).alias("x")).agg(F.sum((F.col(group) == F.lit(low)).cast("long")).alias("a"), F.count("*").alias("t"))
    parts = dealt(tied, "x")
    before = join_parts(parts, parts.groupBy("part").agg(F.sum("t").alias("t_before")), ["t_before"])
    inside = F.coalesce(F.sum("t").over(W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = before.withColumn("rank", F.col("t_before") + inside + (F.col("t") + 1) / 2.0)
    s = ranked.agg(F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n, u = F.col("n1") + F.col("n2"), F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1.0))))
    z = (F.abs(u - F.col("n1") * F.col("n2") / 2.0) - 0.5) / spread
    return s.select("n1", "n2", u.alias("u"), z.alias("z"), chi_squared_tail(F.greatest(z, F.lit(0.0)) ** 2, F.lit(1)).alias("p"))


def null_share(p: DataFrame, at: float) -> DataFrame:
    """(pi0): the share of null hypotheses by the values from ``at`` on, at most 1; none is an error."""
    pi0 = F.least(F.avg((F.col("p") >= at).cast("double")) / (1 - at), F.lit(1.0))
    return p.agg(pi0.alias("pi0")).select(F.when(F.col("pi0") > 0, F.col("pi0")).otherwise(F.raise_error(F.lit("no null hypothesis")).cast("double")).alias("pi0"))


def q_values(tests: DataFrame, p: str = "p", at: float = 0.5, level: float | None = None, robust: bool = False) -> DataFrame:
    """``tests`` with q and passed: p * pi0 * m / count(<= p), made monotone from the largest p, at most 1.

    Values are dealt into ranges; a range is ordered by itself, and one row of each meets the others."""
    summed = tests.agg(F.count(p).alias("m"), F.min(p).alias("lo"), F.max(p).alias("hi")).first()
    if summed.m and (summed.lo < 0 or summed.hi > 1):
        raise ValueError("p-values out of range")
    share = null_share(tests.select(F.col(p).alias("p")), at).first().pi0 if summed.m else 1.0
    parts = dealt(tests, p)
    counted = join_parts(parts, parts.groupBy("part").agg(F.count("*").alias("n_before")), ["n_before"])
    upto = F.col("n_before") + F.count("*").over(W.partitionBy("part").orderBy(p).rangeBetween(W.unboundedPreceding, W.currentRow))
    raw = F.col(p) * share * summed.m / upto
    raw = raw / (1 - (1 - F.col(p)) ** summed.m) if robust else raw
    raw = counted.withColumn("raw", F.least(raw, F.lit(1.0)))
    least = join_parts(raw, raw.groupBy("part").agg(F.min("raw").alias("later")), ["later"], after=True)
    q = F.least(F.min("raw").over(W.partitionBy("part").orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, W.currentRow)), F.coalesce("later", F.lit(1.0)))
    out = least.withColumn("q", q)
    return out.withColumn("passed", F.col("q") <= level if level is not None else F.lit(False)).drop("part", "n_before", "raw", "later")
