"""Queries of the grouped kernels: their numerics are tested against closed forms and brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeflow.operators import dating as dg
from cladeflow.operators import kernels as kn
from cladeflow.operators.association import support_label
from cladeflow.operators.sites import codon_threads, mutant_scan, patches, site_scores
from cladeflow.operators.statistics import bh_qvalues
from cladeflow.plans.alignments import SITES, aligned, plain_base, sites
from cladeflow.plans.networks import _near
from cladeflow.session import spread, stored, table


#: fixed value: label shuffles of the reference
SHUFFLES = 1000


def _run(kernel):
    def query(s, d):
        return dg.per_group(aligned(s, d), "clade", kernel, dg.SCHEMAS[kernel])

    return query


def permuted_migration(s, d):
    a = aligned(s, d).select(F.col("taxon").alias("node"), F.col("clade").alias("label"))
    x = dg.permutation_excess(stored(_near(s, d)), a, SHUFFLES)
    return bh_qvalues(x.withColumn("route", F.concat_ws("-", "a", "b")), "p", "route", "fdr_q").drop("route").withColumn("support", support_label(F.col("bayes_factor")))


def active_population_draws(s, d):
    """Median and 95 % range of the population from seeded draws: one row."""
    n, e = aligned(s, d).count(), _near(s, d).count()
    if not n or not e:
        return s.createDataFrame([], "records long, edges long, median double, low double, high double")
    x = kn.population_draws(n, e)
    return s.createDataFrame([(n, e, float(x[len(x) // 2]), float(x[int(0.025 * len(x))]), float(x[int(0.975 * len(x))]))], "records long, edges long, median double, low double, high double")


def codon_threading(s, d):
    """Every record placed on the codons of the longest clean record."""
    f = table(s, d, "fasta_record").select("row_ord", "seq")
    ref = f.where("length(seq) > 0 and not seq rlike '[^ACGTacgt]'").orderBy(F.desc(F.length("seq")), "row_ord").limit(1).collect()
    return codon_threads(spread(f), "row_ord", "seq", ref[0]["seq"] if ref else "")


def error_patches(s, d):
    return patches(sites(s, d).where(plain_base()), window=8, alpha=0.02)


def variable_site_scores(s, d):
    return site_scores(sites(s, d).where(plain_base())).select("site", F.round("score", 6).alias("score"))


def mutant_scores(s, d):
    return mutant_scan(sites(s, d).where(plain_base())).select("site", "state", F.round("shift", 6).alias("shift"))


QUERIES = {
    "clock_models": _run(dg.clock_models),
    "clock_bootstrap": _run(dg.bootstrap_origin),
    "community_clocks": _run(dg.community),
    "mds_coordinates": _run(dg.coordinates),
    "metricity": _run(dg.metric_report),
    "spectral_clusters": _run(dg.clusters),
    "leader_bins": _run(dg.leaders),
    "diverse_landmarks": _run(dg.landmarks),
    "joined_trees": _run(dg.joined_tree),
    **{f.__name__: f for f in (permuted_migration, active_population_draws, codon_threading, error_patches, variable_site_scores, mutant_scores)},
}
_COUNTS = f"with {SITES}, k as (select site, " + ", ".join(f"count(*) filter (state = '{x}') n{x}" for x in "ACGT") + " from v group by site)"


def _entropy(*counts: str) -> str:
    whole = " + ".join(f"({c})" for c in counts)
    return " + ".join(f"(case when ({c}) > 0 then -(({c}) / ({whole})) * ln(({c}) / ({whole})) else 0e0 end)" for c in counts)


_TOP = "case greatest(nA, nC, nG, nT) when nA then 'A' when nC then 'C' when nG then 'G' else 'T' end"
_NEW = [f"n{x} + (state = '{x}')::int - (top = '{x}')::int" for x in "ACGT"]
_TAIL = "(select coalesce(sum(exp(lgamma(b + 1) - lgamma(i + 1) - lgamma(b - i + 1) + lgamma(size - b + 1) - lgamma(n - i + 1) - lgamma(size - b - n + i + 1) - lgamma(size + 1) + lgamma(n + 1) + lgamma(size - n + 1))), 0) from range(k, least(n, b) + 1) r(i) where n - i <= size - b)"
ORACLE: dict[str, str] = {
    "variable_site_scores": f"{_COUNTS} select site, round({_entropy('nA', 'nC', 'nG', 'nT')}, 6) score from k",
    "mutant_scores": f"{_COUNTS}, t as (select *, {_TOP} top, {_entropy('nA', 'nC', 'nG', 'nT')} base from k), m as (select t.*, state from t, (values ('A'), ('C'), ('G'), ('T')) b(state) where state <> top) select site, state, round({_entropy(*_NEW)} - base, 6) + 0e0 shift from m",
    "error_patches": f"with {SITES}, c as (select site, state c from (select *, row_number() over (partition by site order by n desc, state) r from (select site, state, count(*) n from v group by all)) where r = 1), x as (select taxon, site, (state <> c)::int bad from v join c using (site)), ww as (select taxon, site, sum(bad) over (partition by taxon order by site range between current row and 7 following)::bigint k, count(*) over (partition by taxon order by site range between current row and 7 following) n, sum(bad) over (partition by taxon)::bigint b, count(*) over (partition by taxon) size from x), h as (select taxon, site a, site + 7 z from ww where k >= 3 and {_TAIL} <= 0.02e0), g as (select *, max(z) over (partition by taxon order by a, z rows between unbounded preceding and 1 preceding) pe from h), s as (select *, sum(case when pe is null or a > pe + 1 then 1 else 0 end) over (partition by taxon order by a, z rows unbounded preceding) grp from g) select taxon, min(a) \"first\", max(z) \"last\", count(*) parts from s group by taxon, grp",
}
