"""False-discovery control, combination, regression and evaluation as plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeflow.functions.special import lrt_boundary_p, lrt_mixture_p
from cladeflow.operators.prefix_sums import running_sums, suffix_min


def bh_qvalues(df: DataFrame, p: str, key: str, out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values over the whole table, ties by key. A NaN p makes every q
    NaN; null p are left out. Ranks come from running_sums, so there is no global window."""
    d = df.where(F.col(p).isNotNull())
    ranked = running_sums(d, [], [p, key], {"rank": F.lit(1)}, keep_part=True)
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("rank_all") / F.col("rank_run"))
    got = suffix_min(ranked, [], [p, key], "__raw", "__q")
    poisoned = d.agg(F.coalesce(F.max(F.isnan(p)), F.lit(False)).alias("__nan"))
    # one row
    got = got.join(F.broadcast(poisoned))
    return got.select(*df.columns, F.when(F.col("__nan"), F.lit(float("nan"))).otherwise(F.least(F.col("__q"), F.lit(1.0))).alias(out))


def bayes_fdr(df: DataFrame, pep: str, keys: list[str], monotone: bool = True, out: str = "q_value") -> DataFrame:
    """q = running mean of the posterior error probabilities in ascending order (ties by
    keys); with monotone, the least of it from there on."""
    run = running_sums(df.where(F.col(pep).isNotNull()), [], [pep, *keys], {"s": F.col(pep), "k": F.lit(1)}, kind="double", keep_part=True)
    run = run.withColumn("__m", F.col("s_run") / F.col("k_run"))
    if monotone:
        run = suffix_min(run, [], [pep, *keys], "__m", "__q")
    return run.select(*df.columns, F.col("__q" if monotone else "__m").alias(out))


def cauchy_combination(p: str) -> Column:
    """Aggregate: the Cauchy combination of p-values."""
    return F.lit(0.5) - F.atan(F.avg(F.tan((F.lit(0.5) - F.col(p)) * F.lit(np.pi)))) / F.lit(np.pi)


def simes(df: DataFrame, group: str, p: str, key: str) -> DataFrame:
    """group, simes: the least of n p / rank, ranks by running_sums."""
    r = running_sums(df.where(F.col(p).isNotNull()), [group], [p, key], {"rank": F.lit(1)})
    return r.groupBy(group).agg(F.least(F.lit(1.0), F.min(F.col(p) * F.col("rank_all") / F.col("rank_run"))).alias("simes"))


@F.pandas_udf(DoubleType())
def lrt_site_p(lrt: pd.Series) -> pd.Series:
    return pd.Series(lrt_mixture_p(lrt.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def lrt_gene_p(lrt: pd.Series) -> pd.Series:
    return pd.Series(lrt_boundary_p(lrt.to_numpy(float, na_value=np.nan)))


def moments(x: str, y: str) -> list[Column]:
    """Aggregates from which every ordinary least-squares figure follows; centred sums
    come from the built-in regr_ aggregates, which merge stably."""
    return [F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("xm"), F.regr_avgy(y, x).alias("ym"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]


def ols(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Per group: n, slope, intercept, r2, standard errors, residual variance and the
    x at which the line crosses zero. A group without spread in x has null slope."""
    m = df.groupBy(*group).agg(*moments(x, y))
    slope = F.try_divide("sxy", "sxx")
    m = m.withColumn("slope", slope).withColumn("intercept", F.col("ym") - F.col("slope") * F.col("xm"))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    m = m.withColumn("s2", F.try_divide(rss, F.col("n") - 2)).withColumn("r2", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    m = m.withColumn("se_slope", F.sqrt(F.try_divide("s2", "sxx"))).withColumn("se_mean", F.sqrt(F.try_divide("s2", F.col("n"))))
    return m.withColumn("origin", F.col("xm") - F.try_divide("ym", "slope"))


def fieller_open(fit: DataFrame, t: float) -> DataFrame:
    """Confidence set of the line's zero crossing; the whole axis where the slope is
    not different from zero (g >= 1). fit: from ols."""
    g = F.pow(F.lit(t) * F.col("se_slope") / F.col("slope"), 2)
    c = F.col("ym") / F.col("slope")
    disc = c * c - (1 - g) * (F.col("ym") ** 2 - F.pow(F.lit(t) * F.col("se_mean"), 2)) / (F.col("slope") ** 2)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    inf = float("inf")
    lo = F.when((g >= 1) | (disc < 0), F.lit(-inf)).otherwise(F.col("xm") - (c + root) / (1 - g))
    hi = F.when((g >= 1) | (disc < 0), F.lit(inf)).otherwise(F.col("xm") - (c - root) / (1 - g))
    return fit.withColumn("g", g).withColumn("low", lo).withColumn("high", hi)


def fieller_cases(fit: DataFrame, t: float) -> DataFrame:
    """The same set with its shape: BOUNDED, COMPLEMENT (outside low..high) or ALL_REALS,
    from the quadratic a z^2 + b z + c <= 0 in the distance z before the mean of x."""
    a = F.col("slope") ** 2 - F.pow(F.lit(t) * F.col("se_slope"), 2)
    b = -2 * F.col("slope") * F.col("ym")
    c = F.col("ym") ** 2 - F.pow(F.lit(t) * F.col("se_mean"), 2)
    disc = b * b - 4 * a * c
    kind = F.when(a > 0, "BOUNDED").when(disc > 0, "COMPLEMENT").otherwise("ALL_REALS")
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    z1, z2 = (-b - root) / (2 * a), (-b + root) / (2 * a)
    known = F.col("kind") != "ALL_REALS"
    return fit.withColumn("kind", kind).withColumn("low", F.when(known, F.col("xm") - F.greatest(z1, z2))).withColumn("high", F.when(known, F.col("xm") - F.least(z1, z2)))


def with_residuals(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rows with leverage, studentized residual (internal and external), leave-one-out slope and zero
    crossing: closed forms of the group's sums, which are joined back, one row per group."""
    fit = ols(df, group, x, y).select(*(F.col(g).alias(f"__{g}") for g in group), "n", "xm", "ym", "sxx", "sxy", "slope", "intercept", "s2")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    r = df.join(fit, on)
    dx, dy = F.col(x) - F.col("xm"), F.col(y) - F.col("ym")
    w = F.col("n") / (F.col("n") - 1)
    r = r.withColumn("residual", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).withColumn("leverage", 1 / F.col("n") + F.try_divide(dx * dx, F.col("sxx")))
    r = r.withColumn("student", F.try_divide("residual", F.sqrt(F.col("s2") * F.greatest(1 - F.col("leverage"), F.lit(1e-12)))))
    s2_out = F.try_divide(F.col("s2") * (F.col("n") - 2) - F.col("residual") ** 2 / F.greatest(1 - F.col("leverage"), F.lit(1e-12)), F.col("n") - 3)
    r = r.withColumn("deleted", F.try_divide("residual", F.sqrt(F.greatest(s2_out, F.lit(1e-300)) * F.greatest(1 - F.col("leverage"), F.lit(1e-12)))))
    r = r.withColumn("loo_slope", F.try_divide(F.col("sxy") - w * dx * dy, F.col("sxx") - w * dx * dx))
    xm, ym = F.col("xm") - dx / (F.col("n") - 1), F.col("ym") - dy / (F.col("n") - 1)
    r = r.withColumn("loo_origin", xm - F.try_divide(ym, F.col("loo_slope")))
    return r.select(*df.columns, "residual", "leverage", "student", "deleted", "loo_slope", "loo_origin")


def average_ranks(df: DataFrame, group: list[str], x: str, out: str) -> DataFrame:
    """Ranks with ties averaged, by value counts and their running sums."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("__n"))
    run = running_sums(counts, group, [x], {"c": F.col("__n")})
    ranks = run.select(*(F.col(g).alias(f"__{g}") for g in group), F.col(x).alias("__x"), (F.col("c_run") - (F.col("__n") - 1) / 2).alias(out))
    on = F.col(x) == F.col("__x")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return df.join(ranks, on).select(*df.columns, out)


def roc_auc(df: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """Area under the curve by the rank sum; null if a class is missing."""
    r = average_ranks(df, group, score, "__r")
    pos = F.sum(F.when(F.col(truth), 1).otherwise(0))
    neg = F.sum(F.when(F.col(truth), 0).otherwise(1))
    return r.groupBy(*group).agg(F.try_divide(F.sum(F.when(F.col(truth), F.col("__r"))) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def confusion(df: DataFrame, group: list[str], p: str, truth: str, alpha: float) -> DataFrame:
    """Counts at p <= alpha (inclusive), precision and false-positive rate (null on 0/0)."""
    called = F.coalesce(F.col(p) <= alpha, F.lit(False))
    c = df.groupBy(*group).agg(F.count_if(called & F.col(truth)).alias("tp"), F.count_if(called & ~F.col(truth)).alias("fp"), F.count_if(~called & F.col(truth)).alias("fn"), F.count_if(~called & ~F.col(truth)).alias("tn"))
    return c.withColumn("ppv", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))


def negative_binomial_fit(mean: Column, var: Column) -> tuple[Column, Column]:
    """(p, r) by moments; 0.95 and 5 where the variance does not exceed the mean."""
    ok = (var > mean) & (mean > 0)
    p = F.when(ok, 1 - mean / var).otherwise(0.95)
    return p, F.when(ok, mean * (1 - p) / p).otherwise(5.0)


def linear_percentiles(df: DataFrame, group: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """group and one column per entry of qs: percentiles interpolated linearly. The built-in exact
    aggregate would hold a group's values in one task; here values are counted first and their ranks
    come from running_sums. Null and NaN values are left out."""
    counts = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*group, F.col(x).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    run = running_sums(counts, group, ["__x"], {"c": F.col("__n")})
    aggs = []
    for name, q in qs.items():
        at = (F.col("c_all") - 1) * F.lit(float(q))
        value = lambda r: F.max(F.when((r + 1 > F.col("c_run") - F.col("__n")) & (r + 1 <= F.col("c_run")), F.col("__x")))
        low, high = value(F.floor(at)), value(F.ceil(at))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return run.groupBy(*group).agg(*aggs)


def mad_z(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Robust z: distance from the median in 1.4826 median absolute deviations (at
    least 1e-9). The medians are joined back, one row per group."""
    def joined(d: DataFrame, stat: DataFrame) -> DataFrame:
        on = F.lit(True)
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        return d.join(stat.withColumnsRenamed({g: f"__{g}" for g in group}), on).drop(*(f"__{g}" for g in group))

    d = joined(df, linear_percentiles(df, group, x, {"__med": 0.5})).withColumn("__dev", F.abs(F.col(x) - F.col("__med")))
    d = joined(d, linear_percentiles(d, group, "__dev", {"__mad": 0.5}))
    return d.select(*df.columns, ((F.col(x) - F.col("__med")) / F.greatest(F.lit(1.4826) * F.col("__mad"), F.lit(1e-9))).alias("z"))


def gaps_and_islands(df: DataFrame, group: list[str], order: str, flag: str) -> DataFrame:
    """Runs of consecutive positions where flag holds: group, first, last, length."""
    w = Window.partitionBy(*group).orderBy(order)
    d = df.where(F.col(flag)).withColumn("__i", F.col(order) - F.row_number().over(w))
    return d.groupBy(*group, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__i")
