"""Likely transmission pairs among dated, near sequences, and what follows from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeflow.functions.special import gamma_upper, log_negative_binomial, poisson_cdf
from cladeflow.operators.distances import pair_distances, pair_sums
from cladeflow.operators.statistics import bayes_fdr


@dataclass(frozen=True)
class PairModel:
    """Rates per site and year, years, sites. The interactive profile looks back less far."""

    rate: float = 0.0025
    interval: float = 0.5
    delay: float = 1.0
    length: float = 1000.0
    most_years: float = 20.0
    span: float = 10.0
    p_bg: float = 0.95
    r_bg: float = 5.0
    alpha: float = 0.05
    prior_odds: float = 1.0

    @classmethod
    def interactive(cls, **kw) -> PairModel:
        return cls(most_years=2.0, **kw)

    @property
    def base_distance(self) -> float:
        """The 99 % quantile of the geometric number of substitutions in the interval, per site."""
        x = 2 * self.rate * self.length * self.interval
        return max(math.ceil(math.log(0.01) / math.log(x / (x + 1)) - 1), 0) / self.length


#: fixed value: with fewer pairs only those at or over their median distance are background
LEAST_PAIRS = 500


def calibrated(seqs: DataFrame, taxon: str, seq: str, date: str, m: PairModel, kernel: str = "hamming") -> PairModel:
    """m with the span of the dates and the background of all pairs: the negative binomial of the moments of their substitutions
    (0.95 and 5 where the variance does not exceed the mean). Only sums leave the tasks; of fewer than LEAST_PAIRS
    pairs the distances themselves are taken."""
    span = seqs.agg((F.max(date) - F.min(date)).alias("s")).first()["s"]
    sub = lambda d: d * m.length
    got = pair_sums(seqs.withColumn("__one", F.lit(0)), taxon, seq, kernel, {"k": sub, "kk": lambda d: sub(d) ** 2}, "__one").agg(F.sum("pairs").alias("n"), F.sum("k").alias("k"), F.sum("kk").alias("kk")).first()
    n, k, kk = got["n"] or 0, got["k"] or 0.0, got["kk"] or 0.0
    if 0 < n < LEAST_PAIRS:
        each = sorted(r["d"] for r in pair_distances(seqs, taxon, seq, [kernel]).where(F.col(kernel).isNotNull()).select(F.col(kernel).alias("d")).collect())
        far = sub(np.array([x for x in each if x >= each[len(each) // 2]]))
        n, k, kk = len(far), float(far.sum()), float((far**2).sum())
    mean = k / n if n else 0.0
    var = max(kk / n - mean * mean, 0.0) if n else 0.0
    p = 1 - mean / var if var > mean > 0 else 0.95
    r = mean * (1 - p) / p if var > mean > 0 else 5.0
    return replace(m, span=span if span else m.span, p_bg=p, r_bg=r)


def envelope(d: Column, dt: Column, m: PairModel) -> Column:
    """Whether a pair is worth a likelihood: near enough in time and distance."""
    return (dt <= m.most_years) & (d <= 1.5 * (m.base_distance + 2 * m.rate * dt))


def adequate(k: np.ndarray, dt: np.ndarray, m: PairModel) -> np.ndarray:
    """Whether so few substitutions fit the clock: Poisson P(X <= floor k) at least alpha."""
    return poisson_cdf(k, m.rate * m.length * dt) >= m.alpha


def log_linked(k: np.ndarray, dt: np.ndarray, m: PairModel) -> np.ndarray:
    """Log likelihood of k substitutions and the gap dt under direct transmission."""
    b = 2 * m.rate * m.length
    c = b + 1 / m.interval
    p = b * m.interval / (b * m.interval + 1)
    tail = np.maximum(gamma_upper(k + 1, c * dt / 2), 1e-300)
    spread = dt / (2 * m.interval) + k * math.log(b) - (k + 1) * math.log(c) - math.log(m.interval) + np.log(tail)
    at_once = math.log(1 - p) + k * math.log(p)
    return np.maximum(np.where(dt <= 1e-15, at_once, spread), math.log(1e-300)) - dt / m.delay - math.log(m.delay)


def log_background(k: np.ndarray, dt: np.ndarray, m: PairModel) -> np.ndarray:
    """The same for an unlinked pair: negative binomial distance, triangular gap."""
    longest = max(m.span - m.delay, m.span / 2)
    gap = np.maximum(2 / m.span * (1 - np.minimum(dt, longest) / m.span), 1e-6 / m.span)
    return np.maximum(log_negative_binomial(k, m.r_bg, m.p_bg), math.log(1e-300)) + np.log(gap)


def bayes_factors(k: np.ndarray, dt: np.ndarray, m: PairModel, robust: bool = False) -> np.ndarray:
    """Linked over unlinked; 0 where the clock is not adequate; with robust, the least over slow and fast rates and short and long intervals."""
    models = [m]
    if robust:
        models = [PairModel(**{**m.__dict__, "rate": r, "interval": t}) for r in (1.5e-3, 3.5e-3) for t in (0.05, 3.0)]
    each = [np.where(adequate(k, dt, x), np.exp(np.minimum(log_linked(k, dt, x) - log_background(k, dt, x), 700)), 0.0) for x in models]
    return np.min(each, axis=0)


def with_bayes_factor(pairs: DataFrame, d: str, dt: str, m: PairModel, robust: bool = False) -> DataFrame:
    """pairs that pass the envelope, plus bayes_factor and pep; pairs without distance or gap are left out."""
    @F.pandas_udf(DoubleType())
    def bf(k: pd.Series, gap: pd.Series) -> pd.Series:
        return pd.Series(bayes_factors(k.to_numpy(float), gap.to_numpy(float), m, robust))

    p = pairs.where(F.col(d).isNotNull() & F.col(dt).isNotNull() & envelope(F.col(d), F.col(dt), m))
    p = p.withColumn("bayes_factor", bf(F.col(d) * F.lit(m.length), F.col(dt)))
    return p.withColumn("pep", F.when(F.col("bayes_factor") > 0, 1 / (1 + m.prior_odds * F.col("bayes_factor"))).otherwise(1.0))


def supported_pairs(pairs: DataFrame, keys: list[str], d: str, dt: str, m: PairModel, robust: bool = False) -> DataFrame:
    return bayes_fdr(with_bayes_factor(pairs, d, dt, m, robust), "pep", keys)


def edge_status(d: Column, q: Column, static: float, level: float) -> Column:
    return F.when((q <= level) & (d <= static), "BOTH").when(q <= level, "SUPPORTED").when(d <= static, "STATIC_ONLY").otherwise("NONE")


def active_population(n: Column, edges: Column, r0: float, z: float = 1.959963984540054) -> list[Column]:
    """Mean degree, sampling share and active population with its interval; null for no records or no edges."""
    theta = F.try_divide(2 * edges, n)
    act = F.try_divide(F.lit(r0) * n * n, 2 * edges)
    w = F.try_divide(F.lit(z), F.sqrt(edges))
    return [theta.alias("theta"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), theta / r0)).alias("rho"), act.alias("active"), (act * F.exp(-w)).alias("low"), (act * F.exp(w)).alias("high")]


def sir_r0(growth: Column, duration: float) -> Column:
    return 1 + growth * duration


def seir_r0(growth: Column, latent: float, infectious: float) -> Column:
    return (1 + growth * latent) * (1 + growth * infectious)


def gamma_r0(growth: Column, mean: float, sd: float) -> Column:
    """Gamma-distributed generation times; 0 where the growth is too negative."""
    x = 1 + growth * (sd * sd / mean)
    return F.when(x > 0, F.pow(F.greatest(x, F.lit(0.0)), F.lit(mean * mean / (sd * sd)))).otherwise(0.0)


def growth_rate(intervals: DataFrame, group: list[str], low: float = -25.0, high: float = 150.0, steps: int = 60) -> DataFrame:
    """Per group the exponential growth rate that maximises the profile likelihood of coalescent
    intervals (k lineages, from tau1 back to tau2, `events` coalescences at tau2), by golden section.
    The kernel reads a group's intervals; the likelihood is concave in the range."""
    g = (math.sqrt(5) - 1) / 2

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        k, a, b = (f[c].to_numpy(float) for c in ("k", "tau1", "tau2"))
        events = f["events"].to_numpy(float)
        pairs, times, count = k * (k - 1) / 2, (events * b).sum(), events.sum()

        def log_s(r: float) -> float:
            if abs(r) < 1e-9:
                return math.log(max((pairs * (b - a)).sum(), 1e-300))
            x = np.maximum(r * b, r * a)
            top = x.max()
            s = (pairs * np.exp(x - top) * -np.expm1(-np.abs(r) * (b - a)) / abs(r)).sum()
            return top + math.log(max(s, 1e-300))

        like = lambda r: r * times - count * log_s(r)
        lo, hi = low, high
        for _ in range(steps):
            x, y = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (x, hi) if like(x) < like(y) else (lo, y)
        r = (lo + hi) / 2
        curve = (like(r + 1e-4) - 2 * like(r) + like(r - 1e-4)) / 1e-8
        out = f.iloc[:1][group].copy()
        out["growth"], out["se"], out["n0"] = r, (1 / math.sqrt(-curve) if curve < 0 else None), math.exp(log_s(r)) / max(count, 1e-300)
        return out

    kinds = dict(intervals.dtypes)
    return intervals.groupBy(*group).applyInPandas(solve, ", ".join(f"{x} {kinds[x]}" for x in group) + ", growth double, se double, n0 double")
