"""Attributions of a scorer to taxa, their association with traits, and effects of mutations.

The scorer's outputs (attention of a site to a taxon, centrality of a site) are tables given from outside: no weights
are needed here.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeflow.functions.special import t_two_sided
from cladeflow.operators.alignments import consensus


def leaf_attributions(sites: DataFrame, alpha: DataFrame, valid: Column) -> DataFrame:
    """site, taxon, valid, attribution: attention times whether the taxon's state is valid and not the consensus (ties: the
    least state). sites: site, taxon, state; alpha: site, taxon, alpha (null counts as 0)."""
    c = consensus(sites, valid).select(F.col("site").alias("cs"), F.col("state").alias("major"))
    x = sites.join(alpha, ["site", "taxon"], "left").withColumn("valid", F.coalesce(valid, F.lit(False))).join(c, F.col("site") == F.col("cs"), "left")
    differs = F.col("valid") & (F.col("state") != F.col("major"))
    return x.select("site", "taxon", "valid", F.when(differs, F.coalesce("alpha", F.lit(0.0))).otherwise(0.0).alias("attribution"))


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if b > 0 and a == a else None for a, b in zip(t, df, strict=True)], dtype="float64")


def trait_association(attributions: DataFrame, trait: DataFrame, least_taxa: int = 4) -> DataFrame:
    """site, n_valid, rho, t, p: cosine of a site's attributions with the trait over all taxa, and its t statistic. trait: taxon, y.
    Sites with fewer valid states or without attributions have rho 0, t 0 and p 1."""
    norm = trait.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    x = attributions.join(trait.select("taxon", "y"), "taxon").groupBy("site").agg(F.count_if("valid").alias("n_valid"), F.sum(F.col("attribution") * F.col("y")).alias("ay"), F.sqrt(F.sum(F.col("attribution") * F.col("attribution"))).alias("na"))
    x = x.join(F.broadcast(norm))  # one row
    usable = (F.col("na") > 0) & (F.col("n_valid") >= least_taxa)
    rho = F.when(usable, F.col("ay") / (F.col("na") * F.col("ny") + 1e-15)).otherwise(0.0)
    x = x.select("site", "n_valid", rho.alias("rho"), usable.alias("usable"))
    t = F.col("rho") * F.sqrt((F.col("n_valid") - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-12)))
    x = x.withColumn("t", F.when(F.col("usable"), t).otherwise(0.0))
    return x.select("site", "n_valid", "rho", "t", F.when(F.col("usable"), _t_p(F.col("t"), (F.col("n_valid") - 2).cast("double"))).otherwise(1.0).alias("p"))


def spectral_energy(attributions: DataFrame, trait: DataFrame) -> DataFrame:
    """One row: the norm of the attributions' projections on the unit trait, and its share of their whole norm."""
    norm = trait.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    x = attributions.join(trait.select("taxon", "y"), "taxon").groupBy("site").agg(F.sum(F.col("attribution") * F.col("y")).alias("ay"), F.sum(F.col("attribution") * F.col("attribution")).alias("aa"))
    x = x.join(F.broadcast(norm)).agg(F.sqrt(F.sum(F.pow(F.col("ay") / F.greatest("ny", F.lit(1e-300)), F.lit(2)))).alias("energy"), F.sqrt(F.sum("aa")).alias("whole"))
    return x.select("energy", F.when(F.col("whole") > 0, F.col("energy") / F.col("whole")).otherwise(0.0).alias("ratio"))


def mutation_effects(counts: DataFrame, variants: DataFrame, centrality: DataFrame, background: dict[str, float], pseudo: float = 20.0, offset: float = -3.0, weight: float = 1.0) -> DataFrame:
    """variants plus log_odds, centrality, score, prediction.

    counts: site, state, n; variants: site, wt, mut; centrality: site, xi (null: 0). log_odds compares the shares of mut and wt at
    the site, both drawn towards the background by `pseudo` counts; the score is logistic in it, steeper at central sites.
    A variant at a site without counts has null log_odds, score 0.5 and the prediction `Unmapped`."""
    prior = F.create_map(*(F.lit(x) for k, v in background.items() for x in (k, v)))
    share = lambda n, state: (F.coalesce(n, F.lit(0)) + pseudo * F.coalesce(F.try_element_at(prior, state), F.lit(0.05))) / (F.col("total") + pseudo)
    total = counts.groupBy(F.col("site").alias("ts")).agg(F.sum("n").alias("total"))
    of = lambda role: counts.select(F.col("site").alias(f"{role}_s"), F.col("state").alias(f"{role}_x"), F.col("n").alias(f"{role}_n"))
    x = variants.join(total, F.col("site") == F.col("ts"), "left")
    for role in ("wt", "mut"):
        x = x.join(of(role), (F.col("site") == F.col(f"{role}_s")) & (F.col(role) == F.col(f"{role}_x")), "left")
    x = x.join(centrality.select(F.col("site").alias("xs"), "xi"), F.col("site") == F.col("xs"), "left")
    odds = F.log(share(F.col("mut_n"), F.col("mut")) / share(F.col("wt_n"), F.col("wt")))
    x = x.withColumn("log_odds", F.when(F.col("total").isNotNull(), odds)).withColumn("centrality", F.coalesce("xi", F.lit(0.0)))
    steep = (F.col("log_odds") - offset) * (1 + weight * F.col("centrality"))
    x = x.withColumn("score", F.coalesce(1 / (1 + F.exp(steep / 2)), F.lit(0.5)))
    label = F.when(F.col("log_odds").isNull(), "Unmapped").when(F.col("score") >= 0.5, "Pathogenic").otherwise("Benign")
    return x.select(*variants.columns, "log_odds", "centrality", "score", label.alias("prediction"))


def root_residues(sites: DataFrame, valid: Column, share: float = 0.05, least: int = 3, most: int = 25) -> DataFrame:
    """site, state: the commonest valid state of the earliest samples (ties: the least state), else of all samples. The earliest are
    `share` of the taxa with a date, at least `least` and at most `most`; ties of date go to the least taxon."""
    taxa = sites.select("taxon", "date").where("date is not null").distinct()
    n = taxa.count()
    early = taxa.orderBy("date", "taxon").limit(max(least, min(most, int(share * n)))).select("taxon")
    first = consensus(sites.join(early, "taxon", "left_semi"), valid).select("site", F.col("state").alias("early"))
    return consensus(sites, valid).select("site", "state").join(first, "site", "left").select("site", F.coalesce("early", "state").alias("state"))


def energy_floor(profiles: DataFrame, group: list[str], y: str, span: float, peak: float = 0.5e-4, area: float | None = None) -> DataFrame:
    """group, peak, area, width of the profiles that pass both floors: the largest size of y and the sum of its sizes times step. profiles:
    group, at, y, step. width is the time over which y is at least half its peak. The area's floor grows with the span by default."""
    floor = area if area is not None else 0.01e-3 * max(1.0, span / 5)
    top = F.max(F.abs(y)).over(Window.partitionBy(*group))
    x = profiles.withColumn("__top", top)
    x = x.groupBy(*group).agg(F.max(F.abs(y)).alias("peak"), F.sum(F.abs(y) * F.col("step")).alias("area"), F.sum(F.when(F.abs(y) >= F.col("__top") / 2, F.col("step")).otherwise(0.0)).alias("width"))
    return x.where((F.col("peak") >= peak) & (F.col("area") >= floor))


#: fixed values: decay rates of a soft root, in units of one over the span of the dates
DECAYS = (0.5, 1.0, 2.0, 5.0, 10.0, 20.0)


def soft_divergence(sites: DataFrame) -> DataFrame:
    """taxon, gamma, distance: divergence of every dated taxon from a soft root, a profile of the bases at each site in which earlier samples
    weigh exp(gamma) a year more. Of six decay rates the one with the best correlation of distance and date counts (ties: the
    first). sites: taxon, date, site, state.

    The distance is the expected Tamura-Nei one over a taxon's valid sites, the expected share of differing sites where the
    formula fails. Profiles are (gamma, site) rows; nothing else is as wide as the sites."""
    x = sites.where(F.col("state").isin(*"ACGT") & F.col("date").isNotNull())
    ends = sites.where(F.col("date").isNotNull()).agg(F.min("date").alias("t0"), (F.max("date") - F.min("date")).alias("span"))
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(DECAYS))))
    weight = F.exp(-F.col("g") * (F.col("date") - F.col("t0")))
    profile = x.join(F.broadcast(ends)).where("span > 0").select("site", "state", "date", "t0", "span", grid.alias("x")).select("site", "state", "date", "t0", F.col("x.k").alias("k"), (F.col("x.c") / F.col("span")).alias("g"))
    profile = profile.groupBy("k", "g", "site").agg(*(F.sum(F.when(F.col("state") == b, weight).otherwise(0.0)).alias(f"w{b}") for b in "ACGT"))
    whole = sum((F.col(f"w{b}") for b in "ACGT"), F.lit(0.0))
    profile = profile.select("k", "g", "site", *((F.col(f"w{b}") / whole).alias(f"q{b}") for b in "ACGT"))
    mean_q = profile.groupBy("k").agg(*(F.avg(f"q{b}").alias(f"m{b}") for b in "ACGT"))
    near = {"A": ("G", "C", "T"), "G": ("A", "C", "T"), "C": ("T", "A", "G"), "T": ("C", "A", "G")}
    at = lambda pick: F.coalesce(*(F.when(F.col("state") == b, pick(b)) for b in "ACGT"))
    ts, tv = at(lambda b: F.col(f"q{near[b][0]}")), at(lambda b: F.col(f"q{near[b][1]}") + F.col(f"q{near[b][2]}"))
    pur = F.col("state").isin("A", "G")
    e = x.select("taxon", "date", "site", "state").join(profile, "site").groupBy("k", "g", "taxon", "date").agg(
        F.count("*").alias("n"), F.sum(F.when(pur, ts).otherwise(0.0)).alias("p1"), F.sum(F.when(~pur, ts).otherwise(0.0)).alias("p2"), F.sum(tv).alias("q"), *(F.count_if(F.col("state") == b).alias(f"n{b}") for b in "ACGT")
    )
    e = e.join(F.broadcast(mean_q), "k")  # six rows
    f = {b: F.greatest(0.5 * (F.col(f"m{b}") + F.col(f"n{b}") / F.col("n")), F.lit(1e-4)) for b in "ACGT"}
    e = e.select("k", "g", "taxon", "date", (F.col("p1") / F.col("n")).alias("p1"), (F.col("p2") / F.col("n")).alias("p2"), (F.col("q") / F.col("n")).alias("q"), *(f[b].alias(f"f{b}") for b in "ACGT"))
    fa, fc, fg, ft = (F.col(f"f{b}") for b in "ACGT")
    r, y = fa + fg, fc + ft
    k1, k2, k3 = 2 * fa * fg / r, 2 * fc * ft / y, 2 * (r * y - fa * fg * y / r - fc * ft * r / y)
    a1, a2, a3 = 1 - F.col("p1") / k1 - F.col("q") / (2 * r), 1 - F.col("p2") / k2 - F.col("q") / (2 * y), 1 - F.col("q") / (2 * r * y)
    plain = F.col("p1") + F.col("p2") + F.col("q")
    ok = (a1 > 0) & (a2 > 0) & (a3 > 0)
    d = F.when(ok, -k1 * F.log(F.when(a1 > 0, a1)) - k2 * F.log(F.when(a2 > 0, a2)) - k3 * F.log(F.when(a3 > 0, a3)))
    e = e.select("k", F.col("g").alias("gamma"), "taxon", "date", F.when(d >= 0, d).otherwise(plain).alias("distance"))
    fit = e.groupBy("k").agg(F.coalesce(F.corr("date", "distance"), F.lit(-1.0)).alias("r")).agg(F.min_by("k", F.struct(-F.col("r"), "k")).alias("best"))
    return e.join(F.broadcast(fit), F.col("k") == F.col("best")).select("taxon", "gamma", "distance")


def domain_of(positions: DataFrame, position: str, domains: DataFrame, default: str = "outside") -> DataFrame:
    """positions plus domain: the name of the first interval (domains: name, first, last) that holds the position, by first and name;
    `default` outside of all. Domains are looked up by cells of a hundred positions, so it is an equi-join whatever their number."""
    cell = lambda c: F.floor(c / 100)
    d = domains.where("first <= last").select(F.col("name").alias("__d"), F.col("first").alias("__a"), F.col("last").alias("__z"), F.explode(F.sequence(cell(F.col("first")), cell(F.col("last")))).alias("__c"))
    hit = positions.select(position).distinct().join(d, (cell(F.col(position)) == F.col("__c")) & F.col(position).between(F.col("__a"), F.col("__z")))
    named = hit.groupBy(F.col(position).alias("__p")).agg(F.min(F.struct("__a", "__d")).alias("b")).select("__p", F.col("b.__d").alias("__name"))
    return positions.join(named, F.col(position) == F.col("__p"), "left").select(*positions.columns, F.coalesce("__name", F.lit(default)).alias("domain"))


def canonical_columns(sites: DataFrame, taxon: str) -> DataFrame:
    """position, site: which column of an alignment holds the n-th letter (from 1) of the reference taxon. sites: taxon, site, state. The
    window is as long as the alignment."""
    w = Window.orderBy("site")
    return sites.where((F.col("taxon") == taxon) & (F.col("state") != "-")).select(F.row_number().over(w).alias("position"), "site")


#: fixed values: how much a Bayes factor supports a route
SUPPORT = ((100.0, "Decisive (BF >= 100)"), (10.0, "Strong (10 <= BF < 100)"), (3.0, "Substantial (3 <= BF < 10)"), (-math.inf, "Unsupported (BF < 3)"))


def support_label(bf: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(SUPPORT):
        out = F.when(bf >= least, name).otherwise(out)
    return out
