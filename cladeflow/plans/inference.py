"""Queries of contemporaneous clusters, attributions and traits, resampling, matching, the recombination screen and reports."""

from __future__ import annotations

import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from cladeflow.operators import alignments as al
from cladeflow.operators import association as asn
from cladeflow.operators import dating as dg
from cladeflow.operators import distances as ds
from cladeflow.operators import dyads as dy
from cladeflow.operators import matching as mt
from cladeflow.operators import recombination as rc
from cladeflow.operators import resampling as rs
from cladeflow.plans.alignments import SITES, aligned, plain_base, sites
from cladeflow.plans.dynamics import _FORCE, _force, r6
from cladeflow.plans.networks import _COUNT, NEAR, _near
from cladeflow.session import shared_dir, stored, table
from cladeflow.sources import reports

#: substitutions a site and year, and sites, of the alignment made of the vectors
RATE, LENGTH = 0.08, 64


def _clusters(s, d, admissible):
    x = dy.dyads(stored(_near(s, d)), aligned(s, d).select("taxon", "date"), "hamming", admissible)
    return x.select("cluster", "kind", "size", "taxa", *r6("earliest", "latest", "timespan_days", "mean_distance", "min_distance", "max_distance"))


def contemporaneous_dyads(s, d):
    return _clusters(s, d, lambda x, days: dy.within_envelope(x, days, RATE, LENGTH))


def boxed_dyads(s, d):
    return _clusters(s, d, lambda x, days: dy.within_box(x, days, 0.12, 200.0))


def reported_pairs(s, d):
    """Pairs that share more than 60 sites, up to a distance."""
    p = ds.pair_distances(aligned(s, d).select("taxon", "seq"), "taxon", "seq", ["hamming", "overlap"], 0.15)
    return p.where("overlap > 60").select("i", "j", F.col("overlap").cast("int").alias("overlap"), F.round("hamming", 6).alias("d"))


def _alpha(s, d):
    """Attention of a site to a taxon: the size of the vector's component."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("taxon"), F.posexplode("embedding").alias("site", "x"))
    return e.select("site", "taxon", F.abs(F.col("x").cast("double")).alias("alpha"))


def _attributions(s, d):
    return asn.leaf_attributions(sites(s, d).select("site", "taxon", "state"), _alpha(s, d), plain_base())


def _trait(s, d):
    return aligned(s, d).select("taxon", F.when(F.col("clade") < 3, 1.0).otherwise(-1.0).alias("y"))


def leaf_attributions(s, d):
    x = _attributions(s, d)
    return x.groupBy("taxon").agg(F.count_if(F.col("attribution") > 0).alias("sites"), F.round(F.sum("attribution"), 5).alias("total"), F.round(F.max("attribution"), 5).alias("top"))


def trait_association(s, d):
    x = asn.trait_association(_attributions(s, d), _trait(s, d))
    return x.select("site", "n_valid", F.round("rho", 6).alias("rho"), F.round("t", 4).alias("t"))


def trait_energy(s, d):
    return asn.spectral_energy(_attributions(s, d), _trait(s, d)).select(F.round("energy", 4).alias("energy"), F.round("ratio", 6).alias("ratio"))


def mutation_effects(s, d):
    """All replacements of the consensus, with the share of other bases as the site's centrality."""
    x = sites(s, d).where(plain_base())
    counts = stored(x.groupBy("site", "state").agg(F.count("*").alias("n")))
    c = al.consensus(x, F.lit(True)).select("site", F.col("state").alias("wt"), "n")
    xi = counts.groupBy("site").agg(F.sum("n").alias("all")).join(c, "site").select("site", (1 - F.col("n") / F.col("all")).alias("xi"))
    variants = c.select("site", "wt", F.explode(F.array(*map(F.lit, "ACGT"))).alias("mut")).where("wt <> mut")
    e = asn.mutation_effects(counts, variants, xi, dict.fromkeys("ACGT", 0.25))
    return e.select("site", "wt", "mut", *r6("log_odds", "centrality", "score"), "prediction")


def root_residues(s, d):
    return asn.root_residues(sites(s, d), plain_base())


def energy_floor(s, d):
    """Daily means of the events' values by type and user, those with a high peak and area."""
    e = table(s, d, "events").groupBy("event_type", F.col("user_id"), F.to_date("ts").alias("at")).agg((F.avg("value") / 100).alias("y"))
    x = asn.energy_floor(e.withColumn("step", F.lit(1.0)), ["event_type", "user_id"], "y", 30.0, peak=1.0, area=2.0)
    return x.select("event_type", "user_id", *r6("peak", "area", "width"))


def route_support(s, d):
    e = table(s, d, "supported_edges").where("bayes_factor is not null and not isnan(bayes_factor)")
    return e.groupBy(asn.support_label(F.col("bayes_factor")).alias("support")).agg(F.count("*").alias("edges"))


TIMES = 20


def shuffled_dates(s, d):
    """Correlation of date and clade number under shuffles of the dates: a row per replicate."""
    a = aligned(s, d)
    x = rs.shuffled(a.select("taxon", "date"), "taxon", "date", TIMES).join(a.select("taxon", "clade"), "taxon")
    return x.groupBy("rep").agg(F.count("*").alias("n"), F.round(F.corr("date", "clade"), 6).alias("r"))


def site_subsets(s, d):
    k = aligned(s, d).select(F.explode(F.sequence(F.lit(0), F.lit(LENGTH - 1))).alias("site")).distinct()
    return rs.subsets(k, "site", 8, TIMES)


def bootstrap_counts(s, d):
    return rs.bootstrap_counts(aligned(s, d).select("taxon"), "taxon", TIMES).groupBy("rep").agg(F.sum("copies").alias("drawn"), F.count("*").alias("different"), F.max("copies").alias("most"))


def stratified_taxa(s, d):
    return rs.stratified(aligned(s, d).select("taxon", "clade"), "clade", "taxon", 100)


def strided_records(s, d):
    return rs.strided(table(s, d, "fasta_record").select("row_ord", "name"), "row_ord", 150).select("row_ord")


def matched_taxa(s, d):
    """Metadata ids as tips against the record names."""
    tips = table(s, d, "meta").where("trim(id) <> ''").select("id")
    return mt.match_taxa(tips, "id", table(s, d, "fasta_record").where("name <> ''").select("name"), "name")


def upserted_sites(s, d):
    """Sites delivered until the middle of 2022, re-runs and later sites put in their place: counts by gene."""
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null")
    once = lambda c: x.where(c).groupBy("gene_id", "site_1idx").agg(F.max("lrt").alias("lrt"))
    x2 = mt.upserted(once("loaded_at < timestamp_ntz'2022-07-01 00:00:00'"), once("loaded_at >= timestamp_ntz'2022-07-01 00:00:00'"), ["gene_id", "site_1idx"])
    return x2.groupBy("gene_id").agg(F.count("*").alias("sites"), F.round(F.sum(F.when(~F.isnan("lrt"), F.col("lrt"))), 4).alias("total"))


def preset_intervals(s, d):
    return mt.presets(s).select("preset", "mean", "sd", "unit", *r6("mean_years", "sd_years"))


def clock_choices(s, d):
    """Which clock counts for each combination of findings, one per row of the nations and regions."""
    bit = lambda k: F.expr(f"(n & {1 << k}) <> 0")
    n = table(s, d, "customer").select((F.col("c_custkey") % 128).cast("int").alias("n")).distinct()
    flags = [bit(k) for k in range(7)]
    return n.select("n", *(mt.chosen_clock(asked, flags[0], flags[1], flags[2], flags[0], flags[3], flags[4], flags[5], flags[6]).alias(asked) for asked in ("auto", "linear", "spline")))


def channel_statistics(s, d):
    return rc.channel_statistics(_force(s, d), "taxon", "channel", "site", "force").select("taxon", "channel", "sites", *r6("variance", "pulse", "energy", "coherence"))


def screened_taxa(s, d):
    """Recombination screen of all taxa; clade 0 is the root's channel, taxa without a near pair are isolated."""
    near = _near(s, d).select(F.explode(F.array("i", "j")).alias("taxon")).distinct().withColumn("isolated", F.lit(False))
    stats = stored(rc.channel_statistics(_force(s, d), "taxon", "channel", "site", "force"))
    return rc.screen_taxa(stats, "taxon", "channel", 0, near).select("taxon", *r6("v_cont", "v_root", "r_root"), "verdict")


def matched_windows(s, d):
    """The best window of each lane and scale over the family-wise threshold."""
    x = rc.matched_windows(_force(s, d), ["taxon", "channel"], "site", "force", (8, 16), 0.02, lanes=10)
    return x.groupBy("taxon", "channel", "scale").agg(F.round(F.max("total"), 6).alias("total"))


def reported_edges(s, d):
    """Supported edges written as a transmission report and read back."""
    e = table(s, d, "supported_edges").where("q_value <= 0.05 and id1 is not null and id2 is not null and distance is not null and delta_t is not null and bayes_factor >= 3 and bayes_factor < 1e6")
    path = f"{shared_dir(s)}/report-{uuid.uuid4().hex}"
    reports.write_transmission(path, edges=e)
    back = s.read.csv(f"{path}/edges", header=True)
    return back.groupBy("id1").agg(F.count("*").alias("edges"), F.round(F.sum(F.col("distance").cast("double")), 4).alias("total"))


def checked_predictions(s, d):
    """First-run site predictions of one gene written as CSV, read back and checked."""
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null and lrt is not null and not isnan(lrt) and lrt >= 0 and p_value is not null and site_1idx >= 1")
    least = x.agg(F.min("gene_id").alias("g"))
    x = x.join(F.broadcast(least), F.col("gene_id") == F.col("g")).groupBy(F.col("site_1idx").alias("site")).agg(F.max("lrt").alias("lrt"), F.min("p_value").alias("p_value"), (F.max("is_sig_p05") == 0).alias("is_invariable"))
    path = f"{shared_dir(s)}/predictions-{uuid.uuid4().hex}"
    reports.write_csv(x, path)
    return reports.read_predictions(s, path)


def soft_divergence(s, d):
    return asn.soft_divergence(sites(s, d)).select("taxon", *r6("gamma", "distance"))


def site_domains(s, d):
    """Site tests by domain: five overlapping intervals of positions."""
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null and site_1idx is not null").groupBy("gene_id", "site_1idx").agg(F.max("lrt").alias("lrt"))
    domains = s.createDataFrame([("head", 1, 90), ("binding", 60, 240), ("core", 200, 700), ("loop", 350, 360), ("tail", 701, 2000)], "name string, first int, last int")
    x = asn.domain_of(x, "site_1idx", domains)
    return x.groupBy("domain").agg(F.count("*").alias("sites"), F.count_if((F.col("lrt") > 10) & ~F.isnan("lrt")).alias("strong"))


def canonical_columns(s, d):
    """Columns of the letters of the taxon with the most gaps."""
    x = sites(s, d)
    ref = x.groupBy("taxon").agg(F.count_if(F.col("state") == "-").alias("gaps")).agg(F.min_by("taxon", F.struct(-F.col("gaps"), "taxon")).alias("t")).first()["t"]
    return asn.canonical_columns(x, ref)


def site_evaluation(s, d):
    """First runs of the sites as predictions against their latest runs as truth, by gene: sites on either side only and in both,
    calls, and the correlation of the statistics."""
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null and site_1idx is not null and lrt is not null and not isnan(lrt)")
    run = lambda c, name: x.where(c).groupBy("gene_id", "site_1idx").agg(F.max("lrt").alias(name))
    p, t = run("loaded_at < timestamp_ntz'2022-01-01 00:00:00'", "predicted"), run("loaded_at >= timestamp_ntz'2022-01-01 00:00:00'", "truth")
    both = p.join(t, ["gene_id", "site_1idx"], "full")
    seen = F.col("predicted").isNotNull() & F.col("truth").isNotNull()
    return both.groupBy("gene_id").agg(F.count_if(seen).alias("matched"), F.count_if(F.col("truth").isNull()).alias("predicted_only"), F.count_if(F.col("predicted").isNull()).alias("truth_only"), F.count_if(seen & (F.col("predicted") > 4) & (F.col("truth") > 4)).alias("agreed"), F.round(F.sum(F.when(seen, F.abs(F.col("predicted") - F.col("truth")))), 4).alias("gap"))


def deconvolved_communities(s, d):
    """Communities of each clade by spectral splits that improve the clocks."""
    x = dg.deconvolve(aligned(s, d), "clade")
    return x.groupBy("path", "why").agg(F.count("*").alias("taxa"))


QUERIES = {f.__name__: f for f in (contemporaneous_dyads, boxed_dyads, reported_pairs, leaf_attributions, trait_association, trait_energy, mutation_effects, root_residues, energy_floor, route_support, shuffled_dates, site_subsets, bootstrap_counts, stratified_taxa, strided_records, matched_taxa, upserted_sites, preset_intervals, clock_choices, channel_statistics, screened_taxa, matched_windows, reported_edges, checked_predictions, soft_divergence, site_domains, canonical_columns, site_evaluation, deconvolved_communities)}

_DATED = "(2000 + ({} * 37 % 240) / 12e0)"
_DYADS = f"""with recursive {_COUNT.format('')}, pd as (select i, j, diff / tot h, abs({_DATED.format('i')} - {_DATED.format('j')}) * 365.25e0 dd from n where diff / tot <= {NEAR}e0), e as (select i, j, h from pd where {{}}),
b as (select i x, j y from e union select j, i from e), r(s, t) as (select x, x from b union select r.s, b.y from r join b on r.t = b.x), l as (select s node, min(t) cluster from r group by s),
m as (select cluster, count(*) size, string_agg(node::varchar, ';' order by node) taxa, min({_DATED.format('node')}) earliest, max({_DATED.format('node')}) latest from l group by 1),
g as (select cluster, avg(h) a, min(h) lo, max(h) hi from e join l on i = node group by 1)
select cluster, case when size = 2 then 'Dyad (Pair)' else 'Point-Source Cluster (N=' || size || ')' end kind, size, taxa, round(earliest, 6) earliest, round(latest, 6) latest, round((latest - earliest) * 365.25e0, 6) timespan_days, round(a, 6) mean_distance, round(lo, 6) min_distance, round(hi, 6) max_distance from m join g using (cluster)"""
_LAM = f"({LENGTH * RATE!r}e0 * (dd / 365.25e0 + 1))"
_ATTR = f"""with {SITES}, cs as (select site, state major from (select *, row_number() over (partition by site order by n desc, state) r from (select site, state, count(*) n from v group by all)) where r = 1),
al as (select vec_id taxon, (generate_subscripts(embedding, 1) - 1)::int site, abs(unnest(embedding)::double) alpha from embeddings),
atr as (select s.site, s.taxon, clade, state <> '-' valid, case when state <> '-' and state <> major then alpha else 0e0 end a from sites s join al using (site, taxon) left join cs using (site))"""
_Y = "case when clade < 3 then 1e0 else -1e0 end"
_RHO = f"{_ATTR}, q as (select site, count(*) filter (valid) n_valid, sum(a * {_Y}) ay, sum(a * a) aa, (select sqrt(count(*)) from embeddings) ny from atr group by site), rr as (select *, case when aa > 0 and n_valid >= 4 then ay / (sqrt(aa) * ny + 1e-15) else 0e0 end rho from q)"
_HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
_A = "a as (select vec_id taxon, label clade, 2000 + (vec_id * 37 % 240) / 12e0 date, row_number() over (order by vec_id) pos, count(*) over () n from embeddings)"
_STATS = f"{_FORCE}, mo as (select *, sum(force) over w m, sum(greatest(force, 0)) over (w rows between 49 preceding and current row) wi from fo window w as (partition by taxon, channel order by site)), cst as (select taxon, channel, count(*) sites, var_pop(m) variance, max(m) - min(m) pulse, avg(force * force) energy, case when sum(greatest(force, 0)) > 1e-9 then max(wi) / sum(greatest(force, 0)) else 0e0 end coherence from mo group by all)"
_SCREEN = f"""{_STATS}, near as (select i taxon from ({_COUNT.format('').replace(SITES + ', ', 'with ')} select i, j from n where diff / tot <= {NEAR}e0) union select j from ({_COUNT.format('').replace(SITES + ', ', 'with ')} select i, j from n where diff / tot <= {NEAR}e0)),
t1 as (select taxon, max(sites) l, count(*) filter (channel <> 0) k, coalesce(max(variance) filter (channel = 0), 0) vr, coalesce(max(pulse) filter (channel = 0), 0) pr, coalesce(max(energy) filter (channel = 0), 0) er, coalesce(sum(variance) filter (channel <> 0), 0) vc, coalesce(max(pulse) filter (channel <> 0), 0) pc, coalesce(max(coherence) filter (channel = 0), 0) co from cst group by 1),
t2 as (select *, vr / (vc + vr + 1e-9) rr, vr / (vc / greatest(k, 1) + vr + 1e-9) rd, pr / (sqrt(l) * greatest(sqrt(er), 1e-6)) rst, count(*) over () n, taxon not in (select taxon from near) alone from t1),
t3 as (select *, ln(greatest(1e-4, least(1 - 1e-4, rr)) / (1 - greatest(1e-4, least(1 - 1e-4, rr)))) lg from t2),
m1 as (select median(lg) lm, median(vr) vm from t3), m2 as (select median(abs(lg - lm)) ld, median(abs(vr - vm)) vd from t3, m1),
t4 as (select *, (lg - lm) / greatest(1.4826e0 * ld, 1 / sqrt(l)) zr, (vr - vm) / greatest(1.4826e0 * vd, 0.05e0) zv from t3, m1, m2),
t5 as (select *, zr > 1.645e0 and rr >= 0.5e0 and co <= 0.5e0 and alone burst, (zr > 1.645e0 or rd > 0.5e0 or zv > 2) and (rst >= greatest(sqrt(-0.5e0 * ln(0.05e0 / (2e0 * n))), 1.645e0) or pr >= 3) and (not alone or co > 0.5e0) gh from t4),
pl as (select * from t5 where not burst or not exists (select 1 from t5 where not burst)), p1 as (select median(vc) va, median(pc) pa, avg(vc) vmean from pl),
p2 as (select median(vc) vl from pl, p1 where vc <= va), p3 as (select median(abs(vc - vl)) vld from pl, p1, p2 where vc <= va), p4 as (select median(pc) pl from pl, p1 where pc <= pa), p5 as (select median(abs(pc - p4.pl)) pld from pl, p1, p4 where pc <= pa),
t6 as (select *, greatest(1.4826e0 * vld, vl / sqrt(l), 1 / sqrt(l)) sv, greatest(1.4826e0 * pld, p4.pl / sqrt(l), 1 / sqrt(l)) sp, 10 * greatest(sqrt(l / 1000e0), 1e0) clone from t5, p1, p2, p3, p4, p5)"""
_LOOSE = "trim({}, '''\"')"

# thresholds of the windows: the normal point of 0.05 / (2 lanes scales blocks), for every length a lane can have
_POINTS = " ".join(f"when '{tau}:{n}' then {NormalDist().inv_cdf(1 - 0.05 / (2 * 10 * 2 * max(n / tau, 1.0))) * 0.02 * tau**0.5!r}e0" for tau in (8, 16) for n in range(tau + 1, LENGTH + 1))

ORACLE = {
    "contemporaneous_dyads": _DYADS.format(f"dd <= 365.25e0 and h <= ({_LAM} + {dy.Z95!r}e0 * sqrt({_LAM}) + 0.5e0) / {LENGTH}e0"),
    "boxed_dyads": _DYADS.format("dd <= 200e0 and h <= 0.12e0"),
    "reported_pairs": f"with {_COUNT.format('')} select i, j, tot::int overlap, round(diff / tot, 6) d from n where tot > 60 and diff / tot <= 0.15e0",
    "leaf_attributions": f"{_ATTR} select taxon, count(*) filter (a > 0) sites, round(sum(a), 5) total, round(max(a), 5) top from atr group by 1",
    "trait_association": f"{_RHO} select site, n_valid, round(rho, 6) rho, round(rho * sqrt((n_valid - 2) / greatest(1 - rho * rho, 1e-12)), 4) t from rr",
    "trait_energy": f"{_RHO} select round(sqrt(sum(power(ay / ny, 2))), 4) energy, round(sqrt(sum(power(ay / ny, 2))) / sqrt(sum(aa)), 6) ratio from rr",
    "mutation_effects": f"with {SITES}, k as (select site, state, count(*) n from v group by all), c as (select site, state wt, n nw, t from (select *, row_number() over (partition by site order by n desc, state) r, sum(n) over (partition by site) t from k) where r = 1), x as (select site, wt, m mut, ln((coalesce(n, 0) + 5e0) / (t + 20e0) / ((nw + 5e0) / (t + 20e0))) lo, 1 - nw / t xi from c cross join (values ('A'), ('C'), ('G'), ('T')) b(m) left join k using (site) where false or (m <> wt and state = m) union all select site, wt, m, ln(5e0 / (t + 20e0) / ((nw + 5e0) / (t + 20e0))), 1 - nw / t from c cross join (values ('A'), ('C'), ('G'), ('T')) b(m) where m <> wt and not exists (select 1 from k where k.site = c.site and k.state = m)), y as (select *, 1 / (1 + exp((lo + 3) * (1 + xi) / 2)) s from x) select site, wt, mut, round(lo, 6) log_odds, round(xi, 6) centrality, round(s, 6) score, case when s >= 0.5e0 then 'Pathogenic' else 'Benign' end prediction from y",
    "root_residues": f"with {SITES}, t as (select vec_id taxon from embeddings order by vec_id * 37 % 240, vec_id limit (select greatest(3, least(25, floor(0.05e0 * count(*))::bigint)) from embeddings)), f as (select site, state, row_number() over (partition by site order by count(*) desc, state) r from v group by site, state), g as (select site, state, row_number() over (partition by site order by count(*) desc, state) r from v semi join t using (taxon) group by site, state) select f.site, coalesce(g.state, f.state) state from f left join g on f.site = g.site and g.r = 1 where f.r = 1",
    "energy_floor": "with e as (select event_type, user_id, ts::date dt, avg(value) / 100 y from events group by all), m as (select *, max(abs(y)) over (partition by event_type, user_id) top from e) select event_type, user_id, round(max(abs(y)), 6) peak, round(sum(abs(y)), 6) area, round(sum(case when abs(y) >= top / 2 then 1e0 else 0e0 end), 6) width from m group by 1, 2 having max(abs(y)) >= 1 and sum(abs(y)) >= 2",
    "route_support": "select case when bayes_factor >= 100 then 'Decisive (BF >= 100)' when bayes_factor >= 10 then 'Strong (10 <= BF < 100)' when bayes_factor >= 3 then 'Substantial (3 <= BF < 10)' else 'Unsupported (BF < 3)' end support, count(*) edges from supported_edges where bayes_factor is not null and not isnan(bayes_factor) group by 1",
    "shuffled_dates": f"with {_A}, p as (select unnest(range(1, {TIMES + 1}))::int rep, * from a), o as (select rep, date, row_number() over (partition by rep order by {_HASH.format('rep || chr(58) || taxon')}, taxon) pos from p) select rep, count(*) n, round(corr(o.date, a.clade), 6) r from o join a using (pos) group by rep",
    "site_subsets": f"with p as (select r::int rep, k::int site from range(1, {TIMES + 1}) a(r), range(0, {LENGTH}) b(k)) select rep, site from (select *, row_number() over (partition by rep order by {_HASH.format('rep || chr(58) || site')}, site) k from p) where k <= 8",
    "bootstrap_counts": f"with {_A}, p as (select unnest(range(1, {TIMES + 1}))::int rep, pos, n from a), c as (select rep, {_HASH.format('rep || chr(58) || pos')} % n + 1 k, count(*) copies from p group by all) select rep, sum(copies)::bigint drawn, count(*) different, max(copies) most from c group by rep",
    "stratified_taxa": f"with {_A}, k as (select *, row_number() over (partition by clade order by {_HASH.format('taxon::varchar')}, taxon) r, greatest(1, round(100e0 * count(*) over (partition by clade) / n)) q from a) select taxon, clade from k where r <= q and r <= 100",
    "strided_records": "select row_ord from (select row_ord, row_number() over (order by row_ord) - 1 k, count(*) over () n from fasta_record) where k % ceil(n / 150e0)::bigint = 0",
    "matched_taxa": f"with t as (select distinct id taxon from meta where trim(id) <> ''), f as (select distinct name k from fasta_record where name <> ''), x as (select taxon, max(k) \"key\", 'exact' stage, 0 n from t join f on {_LOOSE.format('taxon')} = k group by 1 union all select taxon, max(k), 'unquoted', 1 from t join f on {_LOOSE.format('taxon')} = {_LOOSE.format('k')} group by 1 union all select taxon, max(k), 'any case', 2 from t join f on lower({_LOOSE.format('taxon')}) = lower({_LOOSE.format('k')}) group by 1) select taxon, \"key\", stage from x where n = (select min(n) from x)",
    "upserted_sites": "with x as (select gene_id, site_1idx, lrt, loaded_at >= timestamp '2022-07-01' late from orthomam_site_selection where gene_id is not null), o as (select gene_id, site_1idx, late, max(lrt) lrt from x group by all), k as (select * from (select *, row_number() over (partition by gene_id, site_1idx order by late desc) r from o) where r = 1) select gene_id, count(*) sites, round(sum(lrt) filter (not isnan(lrt)), 4) total from k group by 1",
    "preset_intervals": "select preset, \"mean\", sd, unit, round(case unit when 'days' then \"mean\" / 365.25e0 else \"mean\" end, 6) mean_years, round(case unit when 'days' then sd / 365.25e0 else sd end, 6) sd_years from (values " + ", ".join(f"('{n}', {m}e0, {v}e0, '{u}')" for n, m, v, u in mt.PRESETS) + ') p(preset, "mean", sd, unit)',
    "channel_statistics": f"{_STATS} select taxon, channel, sites, round(variance, 6) variance, round(pulse, 6) pulse, round(energy, 6) energy, round(coherence, 6) coherence from cst",
    "screened_taxa": f"{_SCREEN} select taxon, round(vc, 6) v_cont, round(vr, 6) v_root, round(rr, 6) r_root, case when burst then 'rate burst' when gh then 'ghost' when vc > greatest(vl + 2 * sv, va + 1.5e0 * sv) or pc > greatest(t6.pl + 2 * sp, pa + 1.5e0 * sp) or (greatest(vmean, va) >= 3 * clone and (vc >= clone or pc >= 1.5e0 * clone)) then 'candidate' else 'backbone' end verdict from t6",
    "matched_windows": f"{_FORCE}, cu as (select taxon, channel, site, sum(force) over w c, row_number() over w k, count(*) over (partition by taxon, channel) n from fo window w as (partition by taxon, channel order by site)), ta as (select * from (values (8), (16)) t(scale)), bx as (select taxon, channel, scale, n, c - coalesce(lag(c, scale) over (partition by taxon, channel, scale order by site), 0) total, k from cu, ta) select taxon, channel, scale, round(max(total), 6) total from bx where k >= scale and n > scale and total >= case (scale || ':' || n) {_POINTS} end group by all",
    "soft_divergence": f"with {SITES}, g(k, c) as (values (0, 0.5e0), (1, 1e0), (2, 2e0), (3, 5e0), (4, 10e0), (5, 20e0)), sp as (select min(date) t0, max(date) - min(date) span from sites), pw as (select k, c / span g, site, " + ", ".join(f"sum(case when state = '{b}' then exp(-c / span * (date - t0)) else 0e0 end) w{b}" for b in "ACGT") + " from v, sp, g group by 1, 2, 3), pq as (select k, g, site, " + ", ".join(f"w{b} / (wA + wC + wG + wT) q{b}" for b in "ACGT") + " from pw), mq as (select k, " + ", ".join(f"avg(q{b}) m{b}" for b in "ACGT") + " from pq group by 1), e as (select k, g, taxon, date, count(*) n, sum(case state when 'A' then qG when 'G' then qA else 0 end) / count(*) p1, sum(case state when 'C' then qT when 'T' then qC else 0 end) / count(*) p2, sum(case when state in ('A', 'G') then qC + qT else qA + qG end) / count(*) q, " + ", ".join(f"count(*) filter (state = '{b}') n{b}" for b in "ACGT") + " from v join pq using (site) group by 1, 2, 3, 4), f as (select e.*, " + ", ".join(f"greatest(0.5e0 * (m{b} + n{b} / n), 1e-4) f{b}" for b in "ACGT") + " from e join mq using (k)), h as (select *, fA + fG fr, fC + fT fy from f), i as (select *, 2 * fA * fG / fr k1, 2 * fC * fT / fy k2, 2 * (fr * fy - fA * fG * fy / fr - fC * fT * fr / fy) k3 from h), j as (select *, 1 - p1 / k1 - q / (2 * fr) a1, 1 - p2 / k2 - q / (2 * fy) a2, 1 - q / (2 * fr * fy) a3 from i), dd as (select k, g, taxon, date, case when least(a1, a2, a3) > 0 then -k1 * ln(case when a1 > 0 then a1 end) - k2 * ln(case when a2 > 0 then a2 end) - k3 * ln(case when a3 > 0 then a3 end) end d, p1 + p2 + q ham from j), z as (select k, g, taxon, date, case when d >= 0 then d else ham end d from dd), r as (select k, corr(date, d) r from z group by 1) select taxon, round(g, 6) gamma, round(d, 6) distance from z where k = (select k from r order by r desc, k limit 1)",
    "site_domains": "with x as (select gene_id, site_1idx p, max(lrt) lrt from orthomam_site_selection where gene_id is not null and site_1idx is not null group by all), k as (select *, case when p between 1 and 90 then 'head' when p between 60 and 240 then 'binding' when p between 200 and 700 then 'core' when p between 701 and 2000 then 'tail' else 'outside' end \"domain\" from x) select \"domain\", count(*) sites, count(*) filter (lrt > 10 and not isnan(lrt)) strong from k group by 1",
    "canonical_columns": f"with {SITES} select (row_number() over (order by site))::int \"position\", site from sites where state <> '-' and taxon = (select taxon from (select taxon, count(*) filter (state = '-') g from sites group by 1) order by g desc, taxon limit 1)",
    "site_evaluation": "with x as (select * from orthomam_site_selection where gene_id is not null and site_1idx is not null and not isnan(lrt)), p as (select gene_id, site_1idx, max(lrt) predicted from x where loaded_at < timestamp '2022-01-01' group by all), t as (select gene_id, site_1idx, max(lrt) truth from x where loaded_at >= timestamp '2022-01-01' group by all) select gene_id, count(*) filter (predicted is not null and truth is not null) matched, count(*) filter (truth is null) predicted_only, count(*) filter (predicted is null) truth_only, count(*) filter (predicted > 4 and truth > 4) agreed, round(sum(abs(predicted - truth)), 4) gap from p full join t using (gene_id, site_1idx) group by 1",
    "clock_choices": "with c as (select distinct (c_custkey % 128)::int n from customer), f as (select n, n & 1 > 0 o, n & 2 > 0 g, n & 4 > 0 s, n & 8 > 0 ob, n & 16 > 0 gb, n & 32 > 0 att, n & 64 > 0 nl from c), k as (select *, case when s and nl then 'spline' when g and not gb and ob then 'ols' when g and att then 'ols' when g and gb then 'gls' when o and ob then 'ols' when g then 'gls' when o then 'ols' else 'gls' end auto from f) select n, auto, case when g and not att and (gb or not ob) then 'gls' when o then 'ols' else 'gls' end linear, case when s then 'spline' else auto end spline from k",
    "reported_edges": "select id1, count(*) edges, round(sum(round(distance, 6)), 4) total from supported_edges where q_value <= 0.05e0 and id1 is not null and id2 is not null and distance is not null and delta_t is not null and bayes_factor >= 3 and bayes_factor < 1e6 group by 1",
    "checked_predictions": "select site_1idx site, max(lrt) lrt, min(p_value) p_value, max(is_sig_p05) = 0 is_invariable from orthomam_site_selection where gene_id = (select min(gene_id) from orthomam_site_selection where lrt is not null and not isnan(lrt) and lrt >= 0 and p_value is not null and site_1idx >= 1) and lrt is not null and not isnan(lrt) and lrt >= 0 and p_value is not null and site_1idx >= 1 group by 1",
}
