"""Queries on pair distances and networks over the alignment made of the vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cladeflow.operators import distances as ds
from cladeflow.operators import graphs as gr
from cladeflow.plans.alignments import SITES, aligned
from cladeflow.session import stored, table

NEAR = 0.16


def _pairs(s, d, kernels, most=None):
    return ds.pair_distances(aligned(s, d).select("taxon", "seq"), "taxon", "seq", kernels, most)


def _near(s, d):
    return _pairs(s, d, ["hamming"], NEAR)


def pair_hamming_edges(s, d):
    return _near(s, d).select("i", "j", F.round("hamming", 6).alias("d"))


def tn93_edges(s, d):
    p = _pairs(s, d, ["tn93", "hamming"], 0.2)
    return p.select("i", "j", F.round("tn93", 6).alias("tn93"))


def tn93_masks_edges(s, d):
    return _pairs(s, d, ["tn93_masks"], 0.2).select("i", "j", F.round("tn93_masks", 6).alias("d"))


def tn93_screen_edges(s, d):
    return _pairs(s, d, ["tn93_screen"], 0.2).select("i", "j", F.round("tn93_screen", 6).alias("d"))


def distance_summary(s, d):
    """All pairs of all taxa: mean and spread of the distance inside and between clades."""
    corrected = lambda h: -0.75 * np.log(1 - np.minimum(h, 0.7499) * 4 / 3)
    p = ds.pair_sums(aligned(s, d), "taxon", "seq", "hamming", {"h": lambda h: h, "jc": corrected}, "clade")
    return p.select("same", "pairs", F.round(F.col("h") / F.col("pairs"), 6).alias("mean"), F.round(F.col("jc") / F.col("pairs"), 6).alias("mean_jc"))


def network_degree(s, d):
    return gr.degrees(_near(s, d))


def network_components(s, d):
    return gr.components(_near(s, d))


def cluster_summary(s, d):
    e = stored(_near(s, d))
    return gr.cluster_summary(e, gr.components(e), "hamming").select("component", "size", "edges", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("greatest", 6).alias("greatest"))


def spectral_communities(s, d):
    e = stored(_near(s, d)).withColumn("w", 1 - F.col("hamming"))
    return gr.spectral_bisection(e, gr.components(e), "w").groupBy("path").agg(F.count("*").alias("size"))


def effective_sizes(s, d):
    """n^2 over the sum of exp(-100 d) over ordered pairs, the diagonal included, per clade."""
    a = aligned(s, d)
    off = ds.pair_sums(a, "taxon", "seq", "hamming", {"off": lambda h: np.exp(-100 * h)}, "clade", within=True).withColumnRenamed("label", "clade")
    n = a.groupBy("clade").agg(F.count("*").alias("n"))
    return n.join(off, "clade", "left").select("clade", "n", F.round(F.col("n") * F.col("n") / (F.col("n") + 2 * F.coalesce("off", F.lit(0.0))), 6).alias("n_eff"))


def cosine_edges(s, d):
    return ds.cosine_edges(table(s, d, "embeddings"), "vec_id", "embedding", 0.35).select("i", "j", F.round("similarity", 5).alias("similarity"))


def nearest_reference(s, d):
    """Nearest of the clades' first taxa, by the screening distance."""
    a = aligned(s, d)
    first = a.groupBy("clade").agg(F.min("taxon").alias("t")).select("t")
    anchors = a.join(first, a["taxon"] == first["t"], "left_semi")
    n = ds.nearest_anchor(a.select("taxon", "seq"), anchors.select("taxon", "seq"), "taxon", "seq")
    return n.select("query", "anchor", (F.round("distance", 6) + 0.0).alias("distance"))


def dated_pairs(s, d):
    """Pairs of one clade sampled at most a month apart: a range join by month cells."""
    a = aligned(s, d).select("taxon", "clade", "date").withColumn("cell", F.floor(F.col("date") * 12 + 1e-6))
    b = a.select(F.col("taxon").alias("t2"), F.col("clade").alias("c2"), F.col("date").alias("d2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("k"))
    p = a.join(b, (F.col("clade") == F.col("c2")) & (F.col("cell") == F.col("k")) & (F.col("taxon") < F.col("t2")) & (F.abs(F.col("date") - F.col("d2")) <= 0.0834))
    return p.select(F.col("taxon").alias("i"), F.col("t2").alias("j"), F.round(F.abs(F.col("date") - F.col("d2")), 6).alias("dt"))


QUERIES = {f.__name__: f for f in (pair_hamming_edges, tn93_edges, tn93_masks_edges, tn93_screen_edges, distance_summary, network_degree, network_components, cluster_summary, spectral_communities, effective_sizes, cosine_edges, nearest_reference, dated_pairs)}

_COUNT = f"""{SITES}, n as (select a.taxon i, b.taxon j, a.clade ci, b.clade cj, count(*) tot, count(*) filter (a.state <> b.state) diff,
 {", ".join(f"count(*) filter (a.state = '{x}') + count(*) filter (b.state = '{x}') n{x}" for x in "ACGT")},
 count(*) filter (a.state in ('A', 'G') and b.state in ('A', 'G') and a.state <> b.state) ag, count(*) filter (a.state in ('C', 'T') and b.state in ('C', 'T') and a.state <> b.state) ct
 from v a join v b on a.site = b.site and a.taxon < b.taxon {{}} group by all)"""
_PAIRS = f"with recursive {_COUNT.format('')}, p as (select *, diff / tot h from n)"
_NEAR = f"{_PAIRS}, e as (select i, j, h from p where h <= {NEAR}e0)"
_COMP = f"{_NEAR}, b as (select i x, j y from e union select j, i from e), r(s, t) as (select x, x from b union select r.s, b.y from r join b on r.t = b.x), l as (select s node, min(t) component from r group by s)"
_FORM = """q as (select i, j, tot, ag / tot pag, ct / tot pct, (diff - ag - ct) / tot tv, diff / tot h, {f} from n), z as (select *, fa + fg fr, fc + ft fy from q),
y as (select *, 2 * fa * fg / fr k1, 2 * fc * ft / fy k2, 2 * (fr * fy - fa * fg * fy / fr - fc * ft * fr / fy) k3 from z),
x as (select *, 1 - pag / k1 - tv / (2 * fr) a1, 1 - pct / k2 - tv / (2 * fy) a2, 1 - tv / (2 * fr * fy) a3 from y)"""
_FREQ = ", ".join(f"n{x.upper()} / (2e0 * tot) f{x}" for x in "acgt")
_FLOOR = ", ".join(f"greatest(n{x.upper()} / (2e0 * tot), 1e-4) f{x}" for x in "acgt")
_D = "(-k1 * ln(a1) - k2 * ln(a2) - k3 * ln(a3))"


def _tn(freq: str, bad: str, other: str, least: str, name: str) -> str:
    return f"with {_COUNT.format('')}, {_FORM.format(f=freq)}, d as (select i, j, tot, case when {bad} then {other} else {_D} end d from x) select i, j, round(d, 6) {name} from d where {least} and d <= 0.2e0"


ORACLE = {
    "pair_hamming_edges": f"{_NEAR} select i, j, round(h, 6) d from e",
    "tn93_edges": _tn(_FREQ, "least(fa, fc, fg, ft) <= 0 or least(a1, a2, a3) <= 0", "case when least(fa, fc, fg, ft) > 0 or 1 - 2 * (pag + pct) - tv <= 0 or 1 - 2 * tv <= 0 then 1000e0 else greatest(-0.5e0 * ln(1 - 2 * (pag + pct) - tv) - 0.25e0 * ln(1 - 2 * tv), 0e0) end", "tot > 0", "tn93"),
    "tn93_masks_edges": _tn(_FLOOR, "h = 0 or least(a1, a2, a3) <= 1e-6", "h", "tot > 0", "d"),
    "tn93_screen_edges": _tn(_FLOOR, "least(a1, a2, a3) <= 0", "h", "tot >= 50", "d"),
    "distance_summary": f"{_PAIRS} select ci = cj same, count(*) pairs, round(avg(h), 6) mean, round(avg(-0.75e0 * ln(1 - least(h, 0.7499e0) * 4 / 3e0)), 6) mean_jc from p group by 1",
    "network_degree": f"{_NEAR} select node, count(*) degree from (select i node from e union all select j from e) group by node",
    "network_components": f"{_COMP} select node, component from l",
    "cluster_summary": f"{_COMP}, s as (select component, count(*) size from l group by 1), g2 as (select component, count(*) edges, round(min(h), 6) \"least\", round(avg(h), 6) mean, round(max(h), 6) \"greatest\" from e join l on i = node group by 1) select * from s join g2 using (component)",
    "effective_sizes": f"{_PAIRS.replace('with recursive', 'with')}, o as (select ci clade, sum(exp(-100 * h)) s from p where ci = cj group by 1), c as (select label clade, count(*) n from embeddings group by 1) select clade, n, round(n * n / (n + 2 * coalesce(s, 0)), 6) n_eff from c left join o using (clade)",
    "cosine_edges": "select a.vec_id i, b.vec_id j, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) similarity from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35e0",
    "nearest_reference": f"with {SITES}, f as (select min(vec_id) t from embeddings group by label), n as (select a.taxon i, b.taxon j, count(*) tot, count(*) filter (a.state <> b.state) diff, {', '.join(f"count(*) filter (a.state = '{x}') + count(*) filter (b.state = '{x}') n{x}" for x in 'ACGT')}, count(*) filter (a.state in ('A', 'G') and b.state in ('A', 'G') and a.state <> b.state) ag, count(*) filter (a.state in ('C', 'T') and b.state in ('C', 'T') and a.state <> b.state) ct from v a join v b on a.site = b.site join f on b.taxon = t group by all), {_FORM.format(f=_FLOOR)}, d as (select i, j, greatest(case when least(a1, a2, a3) <= 0 then h else {_D} end, 0) d from x where tot >= 50) select i query, j anchor, round(d, 6) + 0e0 distance from (select *, row_number() over (partition by i order by round(d, 12) + 0e0, j) r from d) where r = 1",
    "dated_pairs": "with a as (select vec_id t, label c, 2000 + (vec_id * 37 % 240) / 12e0 d from embeddings) select a.t i, b.t j, round(abs(a.d - b.d), 6) dt from a join a b on a.c = b.c and a.t < b.t where abs(a.d - b.d) <= 0.0834e0",
}
