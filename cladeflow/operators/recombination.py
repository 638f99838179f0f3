"""Scan of aligned sequences for tracts from another lineage, in long form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeflow.functions.sequences import jukes_cantor
from cladeflow.session import stored


def prior(share: Column, decay: float = 5.0, floor: float = 0.05) -> Column:
    """Log prior of a landmark at a share of differing sites."""
    return F.log(floor + (1 - floor) * F.exp(-decay * jukes_cantor(share)))


def compress_sites(taxa: int, sites: int) -> bool:
    """Whether a scan runs on variable sites only."""
    return (sites > 30_000 and taxa > 12) or sites > 50_000 or (sites > 10_000 and taxa >= 48) or (sites >= 10_000 and taxa * sites > 2_000_000)


def attention(scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Softmax of the channels' scores at each (taxon, site), its excess over the channel's mean (the force) - two
    windows over few channels and one joined aggregate per channel."""
    w = Window.partitionBy(*group)
    x = scores.withColumn("__e", F.exp(F.col(score) - F.max(score).over(w)))
    return x.withColumn("attention", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def momentum(force: DataFrame, lane: list[str], site: str, value: str) -> DataFrame:
    """Running sum of the force along the sites of a lane (taxon and channel), the bridge
    that removes its drift, and the best positive sum of 50 sites up to each site."""
    w = Window.partitionBy(*lane).orderBy(site)
    whole = Window.partitionBy(*lane)
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    u = F.row_number().over(w)
    x = force.withColumn("momentum", run).withColumn("bridge", run - u / F.count("*").over(whole) * F.sum(value).over(whole))
    return x.withColumn("window", F.sum(F.greatest(F.col(value), F.lit(0.0))).over(w.rowsBetween(-49, 0)))


def best_segments(force: DataFrame, lane: list[str], site: str, value: str, least: float) -> DataFrame:
    """Per lane the segment with the largest sum of force: lane, first, last, gain. The start of the best segment
    that ends at a site is where the running sum was least before it."""
    w = Window.partitionBy(*lane).orderBy(site)
    x = force.withColumn("__c", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__p", F.col("__c") - F.col(value))
    low = F.min(F.struct(F.col("__p").alias("p"), F.col(site).alias("s"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("__low", low).withColumn("__gain", F.col("__c") - F.col("__low.p"))
    best = F.max(F.struct(F.col("__gain").alias("gain"), (-F.col(site)).alias("n"), F.col("__low.s").alias("first")))
    x = x.groupBy(*lane).agg(best.alias("b")).select(*lane, F.col("b.first").alias("first"), (-F.col("b.n")).alias("last"), F.col("b.gain").alias("gain"))
    return x.where(F.col("gain") >= least)


@F.pandas_udf(DoubleType())
def fisher_one_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """P(at least a in the corner) of the 2 x 2 table a, b / c, d with its margins."""
    n = int((a + b + c + d).max()) + 1 if len(a) else 1
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
    out = []
    for p, q, r, s in zip(*(x.astype(int) for x in (a, b, c, d)), strict=True):
        top = min(p + q, p + r)
        k = np.arange(p, top + 1)
        const = lf[p + q] + lf[r + s] + lf[p + r] + lf[q + s] - lf[p + q + r + s]
        out.append(min(1.0, float(np.exp(const - lf[k] - lf[p + q - k] - lf[p + r - k] - lf[s - p + k]).sum())))
    return pd.Series(out, dtype=float)


def tract_counts(sites: DataFrame, triples: DataFrame) -> DataFrame:
    """For (child, home, donor, first, last): sites in the tract and in the flanks where the child agrees with only the donor or only the home."""
    s = sites.where(F.col("state").isin(*"ACGT")).select("taxon", "site", "state")
    get = lambda role: s.select(F.col("taxon").alias(role), F.col("site").alias(f"{role}_site"), F.col("state").alias(f"{role}_state"))
    x = triples.join(get("child"), "child").withColumnRenamed("child_site", "site")
    for role in ("home", "donor"):
        y = get(role)
        x = x.join(y, (x[role] == y[role]) & (x["site"] == y[f"{role}_site"])).drop(y[role])
    inside = F.col("site").between(F.col("first"), F.col("last"))
    donor = (F.col("child_state") == F.col("donor_state")) & (F.col("child_state") != F.col("home_state"))
    home = (F.col("child_state") == F.col("home_state")) & (F.col("child_state") != F.col("donor_state"))
    keys = ["child", "home", "donor", "first", "last"]
    return x.groupBy(*keys).agg(*(F.count_if(c & p).alias(n) for n, c, p in (("a", inside, donor), ("b", inside, home), ("c", ~inside, donor), ("d", ~inside, home))))


def least_informative(taxa: int) -> int:
    return max(6, math.ceil(2.5 * math.log(max(taxa, 1))))


#: fixed values: one-sided 95 % point of the normal distribution, shares and coherence that mark a burst of rate
Z95, ROOT_SHARE, COHERENCE = 1.645, 0.5, 0.5


def channel_statistics(force: DataFrame, taxon: str, channel: str, site: str, value: str) -> DataFrame:
    """taxon, channel, sites, variance and pulse (greatest less least) of the running sum of the force, energy (its mean
    square) and coherence: the best share of a channel's positive force that falls in 50 sites in a row (0 where there is none beyond rounding). Lanes
    are as long as the alignment; they are the only windows."""
    x = momentum(force, [taxon, channel], site, value)
    up = F.sum(F.greatest(F.col(value), F.lit(0.0)))
    return x.groupBy(taxon, channel).agg(F.count("*").alias("sites"), F.var_pop("momentum").alias("variance"), (F.max("momentum") - F.min("momentum")).alias("pulse"), F.avg(F.col(value) * F.col(value)).alias("energy"), F.when(up > 1e-9, F.max("window") / up).otherwise(0.0).alias("coherence"))


def screen_taxa(stats: DataFrame, taxon: str, channel: str, root: int, isolated: DataFrame, alpha: float = 0.05, stringency: float = 1.0) -> DataFrame:
    """taxon, v_cont, v_root, r_root, coherence, verdict for every taxon of channel_statistics.

    The root's channel is compared with those of the landmarks: r_root is its share of their variances. A taxon whose logit share
    stands out of the median (by MAD), with incoherent force and no near relative (isolated: taxon, isolated), is a
    `rate burst`: it evolves faster, it does not mix. One that stands out with a strong pulse is a `ghost`. Of the others
    those are candidates whose landmark variance or pulse lies above the lower half of the pool by 2 MADs (and the
    median by 1.5), and all ghosts; where the whole pool varies far beyond a clone's, all that do. The rest is `backbone`.
    Medians are exact, from counted values; of each a number comes to the driver."""
    from cladeflow.operators.statistics import linear_percentiles

    is_root = F.col(channel) == root
    x = stats.groupBy(taxon).agg(
        F.max("sites").alias("sites"), F.count_if(~is_root).alias("k"), F.coalesce(F.max(F.when(is_root, F.col("variance"))), F.lit(0.0)).alias("v_root"), F.coalesce(F.max(F.when(is_root, F.col("pulse"))), F.lit(0.0)).alias("root_pulse"),
        F.coalesce(F.max(F.when(is_root, F.col("energy"))), F.lit(0.0)).alias("root_energy"), F.coalesce(F.sum(F.when(~is_root, F.col("variance"))), F.lit(0.0)).alias("v_cont"), F.coalesce(F.max(F.when(~is_root, F.col("pulse"))), F.lit(0.0)).alias("cont_pulse"), F.coalesce(F.max(F.when(is_root, F.col("coherence"))), F.lit(0.0)).alias("coherence"),
    )
    r = lambda v: F.col("v_root") / (v + F.col("v_root") + 1e-9)
    held = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), r(F.col("v_cont"))))
    x = x.withColumns({"r_root": r(F.col("v_cont")), "r_dim": r(F.col("v_cont") / F.greatest("k", F.lit(1))), "logit": F.log(held / (1 - held)), "root_stat": F.col("root_pulse") / (F.sqrt("sites") * F.greatest(F.sqrt("root_energy"), F.lit(1e-6)))})

    def medians(d: DataFrame, **cols: Column) -> dict[str, float]:
        """The exact medians of a few columns: one pass over them all, a number each comes to the driver."""
        each = d.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), c.cast("double").alias("v")) for n, c in cols.items()))).alias("x")).select("x.n", "x.v")
        return dict.fromkeys(cols, 0.0) | {r["n"]: r["m"] for r in linear_percentiles(each, ["n"], "v", {"m": 0.5}).collect()}

    x = stored(x)
    n = x.count()
    mid = medians(x, l=F.col("logit"), r=F.col("v_root"))
    dev = medians(x, l=F.abs(F.col("logit") - mid["l"]), r=F.abs(F.col("v_root") - mid["r"]))
    step = 1 / F.sqrt("sites")
    z_r = (F.col("logit") - mid["l"]) / F.greatest(F.lit(1.4826 * dev["l"]), step)
    z_v = (F.col("v_root") - mid["r"]) / max(1.4826 * dev["r"], 0.05)
    alone = isolated.select(F.col(taxon).alias("__t"), F.col("isolated").alias("__alone"))
    x = x.join(alone, F.col(taxon) == F.col("__t"), "left").withColumn("alone", F.coalesce("__alone", F.lit(True)))
    burst = (z_r > Z95) & (F.col("r_root") >= ROOT_SHARE) & (F.col("coherence") <= COHERENCE) & F.col("alone")
    strong = (F.col("root_stat") >= max((-0.5 * math.log(alpha / (2.0 * max(n, 1)))) ** 0.5, Z95)) | (F.col("root_pulse") >= 3)
    ghost = ((z_r > Z95) | (F.col("r_dim") > ROOT_SHARE) | (z_v > 2)) & strong & (~F.col("alone") | (F.col("coherence") > COHERENCE))
    x = stored(x.withColumn("burst", burst).withColumn("ghost", ~burst & ghost))
    pool = x.where(~F.col("burst"))
    pool = x if pool.isEmpty() else pool
    v_mean = pool.agg(F.avg("v_cont")).first()[0] or 0.0
    all_ = medians(pool, v_cont=F.col("v_cont"), cont_pulse=F.col("cont_pulse"))
    lower = {c: F.when(F.col(c) <= all_[c], F.col(c)) for c in all_}
    low = medians(pool, **lower)
    spread = medians(pool, **{c: F.abs(lower[c] - low[c]) for c in all_})
    s2 = max(stringency, 0.1)

    def over(c: str) -> Column:
        scale = F.greatest(F.lit(1.4826 * spread[c]), low[c] * step, step)
        return F.col(c) > F.greatest(low[c] + 2 * s2 * scale, all_[c] + 1.5 * s2 * scale)

    clone = 10 * F.greatest(F.sqrt(F.col("sites") / 1000), F.lit(1.0))
    pervasive = (F.lit(max(v_mean, all_["v_cont"])) >= 3 * clone) & ((F.col("v_cont") >= clone) | (F.col("cont_pulse") >= 1.5 * clone))
    candidate = over("v_cont") | over("cont_pulse") | F.col("ghost") | pervasive | F.lit(s2 <= 0.65)
    verdict = F.when(F.col("burst"), "rate burst").when(F.col("ghost"), "ghost").when(candidate, "candidate").otherwise("backbone")
    return x.select(taxon, "v_cont", "v_root", "r_root", "coherence", verdict.alias("verdict"))


def matched_windows(force: DataFrame, lane: list[str], site: str, value: str, scales: tuple[int, ...], sigma: float, lanes: int, alpha: float = 0.05, floor: float = 0.0) -> DataFrame:
    """lane, scale, first, last, total, score: windows of fixed lengths whose summed force passes a family-wise threshold, without
    overlaps at one scale (the best first, ties to the earliest).

    A scale tau has length / tau independent windows, so the threshold is the normal point of alpha / (2 lanes scales windows), times
    sigma sqrt(tau), at least `floor`. Sums are window differences in the JVM; only windows over the threshold reach the
    choice, which is made lane by lane."""
    from statistics import NormalDist

    base = force.select(*lane, F.col(site).alias("__s"), F.col(value).alias("__v"))
    w, whole = Window.partitionBy(*lane).orderBy("__s"), Window.partitionBy(*lane)
    run = F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    base = base.withColumn("__c", run).withColumn("__n", F.count("*").over(whole))
    cells = []
    for tau in sorted(set(scales)):
        base = base.withColumns({f"__e{tau}": F.col("__c") - F.coalesce(F.lag("__c", tau).over(w), F.lit(0.0)), f"__f{tau}": F.lag("__s", tau - 1).over(w)})
        cells.append(F.struct(F.lit(tau).alias("scale"), F.col(f"__f{tau}").alias("first"), F.col(f"__e{tau}").alias("total")))
    x = base.select(*lane, F.col("__s").alias("last"), "__n", F.explode(F.array(*cells)).alias("x")).select(*lane, "last", "__n", "x.*")
    many = len(set(scales))
    # the normal point depends on the lane's length, of which there are few
    lengths = [r["__n"] for r in base.select("__n").distinct().collect()]
    point = {(tau, n): max(floor, NormalDist().inv_cdf(1 - max(alpha / (2 * lanes * many * max(n / tau, 1.0)), 1e-15)) * sigma * tau**0.5) for tau in set(scales) for n in lengths if tau < n}
    theta = F.try_element_at(F.create_map(*(F.lit(v) for (tau, n), th in point.items() for v in (f"{tau}:{n}", th))), F.concat_ws(":", "scale", "__n")) if point else F.lit(None).cast("double")
    hits = x.withColumn("theta", theta).where(F.col("first").isNotNull() & F.col("theta").isNotNull() & (F.col("total") >= F.col("theta")))
    hits = hits.select(*lane, "scale", "first", "last", "total", (F.col("total") / F.greatest("theta", F.lit(1e-9))).alias("score"))

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "first"], ascending=[False, True], kind="stable")
        kept: list[int] = []
        first, last = f["first"].to_numpy(), f["last"].to_numpy()
        for i in range(len(f)):
            if all(last[i] < first[k] or first[i] > last[k] for k in kept):
                kept.append(i)
        return f.iloc[kept]

    kinds = dict(force.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in lane) + f", scale int, first {kinds[site]}, last {kinds[site]}, total double, score double"
    return hits.groupBy(*lane, "scale").applyInPandas(choose, schema)
