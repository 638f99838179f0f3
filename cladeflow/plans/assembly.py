"""Queries that assemble results: dossiers, matched traits, re-ranked pairs, segments, epicentres, exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cladeflow.operators import dating as dg
from cladeflow.operators import graphs as gr
from cladeflow.operators import kernels as kn
from cladeflow.operators.alignments import allele_frequencies, padded
from cladeflow.plans.alignments import aligned, plain_base, sites
from cladeflow.plans.dynamics import _force, coselection_pairs
from cladeflow.plans.networks import _COMP, _COUNT, NEAR, _near
from cladeflow.session import stored, table
from cladeflow.sources.tables import geojson_points


def padded_records(s, d):
    """Records padded to the longest one: how much was filled in, and the common width."""
    f = table(s, d, "fasta_record").select("row_ord", F.coalesce("seq", F.lit("")).alias("seq"))
    p = padded(f.withColumn("n", F.length("seq")), "seq")
    return p.select("row_ord", F.length("seq").alias("width"), (F.length("seq") - F.col("n")).alias("filled"))


def near_pair_rarity(s, d):
    """Near pairs weighed by what they share: minus log frequency of the shared states below 20 %."""
    x = sites(s, d).where(plain_base()).select("taxon", "site", "state")
    a = allele_frequencies(x)
    fr = a.select("site", F.explode(F.array(*(F.struct(F.lit(b).alias("state"), F.col(f"f{b}").alias("f")) for b in "ACGT"))).alias("z")).select("site", "z.*").where("f < 0.2")
    rare = x.join(fr, ["site", "state"])
    i = rare.select(F.col("taxon").alias("i"), "site", "state", "f")
    j = rare.select(F.col("taxon").alias("j"), "site", "state")
    p = _near(s, d).select("i", "j", "hamming")
    shared = p.join(i, "i").join(j, ["j", "site", "state"]).groupBy("i", "j").agg(F.count("*").alias("shared"), F.sum(-F.log("f")).alias("nats"))
    return p.select("i", "j").join(shared, ["i", "j"], "left").select("i", "j", F.coalesce("shared", F.lit(0)).alias("shared"), F.round(F.coalesce("nats", F.lit(0.0)), 6).alias("nats"))


def trait_match(s, d):
    """Host words against names: exact first, then in lower case, then as part of the name; the first that matches."""
    f = table(s, d, "fasta_record").where("name is not null").select("row_ord", F.split("name", "_").alias("w"))
    hosts = s.createDataFrame([("Duck", "waterfowl"), ("gull", "shore"), ("CHICKEN", "poultry"), ("turk", "poultry")], "host string, trait string")
    words = f.select("row_ord", F.explode("w").alias("word"))
    # four fixed rows
    m = words.join(F.broadcast(hosts), F.lower("word").contains(F.lower("host")))
    how = F.when(F.col("word") == F.col("host"), 0).when(F.lower("word") == F.lower("host"), 1).otherwise(2)
    return m.groupBy("row_ord").agg(F.min(F.struct(how.alias("how"), "host", "trait")).alias("b")).select("row_ord", F.col("b.how").alias("how"), F.col("b.trait").alias("trait"))


def cluster_dossiers(s, d):
    """One JSON document per cluster: size, span, density and its members' dates."""
    e = stored(_near(s, d))
    lab = gr.components(e)
    a = aligned(s, d).select(F.col("taxon").alias("node"), "clade", "date")
    x = lab.join(a, "node").groupBy("component").agg(F.count("*").alias("size"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("clade").alias("clades"))
    n = e.join(lab, e["i"] == lab["node"]).groupBy("component").agg(F.count("*").alias("edges"))
    x = x.join(n, "component")
    return x.select("component", F.to_json(F.struct("size", "edges", "clades", F.struct(F.round("first", 4).alias("first"), F.round("last", 4).alias("last")).alias("span"), F.round(2 * F.col("edges") / (F.col("size") * (F.col("size") - 1)), 6).alias("density"))).alias("dossier"))


def location_geojson(s, d):
    h = table(s, d, "h5n1_ha_metadata").where("location is not null").groupBy("location").agg(F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"), F.count("*").alias("n"))
    return geojson_points(h, "lat", "lon", "location", "n")


def epicentres(s, d):
    """Per clade the generalised least-squares centre of its taxa's places and its radius: the covariance of two taxa is the path
    from the earliest sample that they share."""

    def centre(f: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        dist = dg.filled(dist)
        root = dist[int(f["date"].argmin())]
        lat, lon, r = kn.epicentre(f["lat"].to_numpy(float), f["lon"].to_numpy(float), np.maximum(0.5 * (root[:, None] + root[None, :] - dist), 0))
        return pd.DataFrame([{"lat": lat, "lon": lon, "radius_km": r}])

    places = table(s, d, "h5n1_ha_metadata").where("lat is not null and lon is not null").select(F.col("h5_row").alias("place"), "lat", "lon")
    a = aligned(s, d)
    return dg.per_group(a.join(places, a["taxon"] == places["place"]).drop("place"), "clade", centre, "lat double, lon double, radius_km double")


def changepoints(s, d):
    """Segments of the force of each taxon's own channel, by recursive splits."""
    own = aligned(s, d).select(F.col("taxon").alias("t"), "clade")
    x = _force(s, d).join(own, (F.col("taxon") == F.col("t")) & (F.col("channel") == F.col("clade"))).select("taxon", "site", "force")

    def cut(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("site")
        at = f["site"].to_numpy()
        rows = [(int(at[a]), int(at[b]), m) for a, b, m in kn.binary_segments(f["force"].to_numpy(float), 3.0)]
        out = pd.DataFrame(rows, columns=["first", "last", "mean"])
        out.insert(0, "taxon", f["taxon"].iloc[0])
        return out

    return x.groupBy("taxon").applyInPandas(cut, "taxon long, first int, last int, mean double")


def tree_rotations(s, d):
    """Mean cosine factor of each taxon against its clade: rotary positions by distance."""
    def rot(f: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"taxon": f["taxon"], "factor": kn.tree_rotations(dist, 16).mean(axis=1)})

    return dg.per_group(aligned(s, d), "clade", rot, "taxon long, factor double")


def dated_trees(s, d):
    """Per clade the joined tree at its best root, with the rate and the date of the root."""
    def tree(f: pd.DataFrame, dist: np.ndarray) -> pd.DataFrame:
        when = dict(zip(f["taxon"].astype(str), f["date"], strict=True))
        nodes, rate, rss = kn.best_root(kn.neighbour_joining(dist, list(when)), when)
        at = kn.node_dates(nodes, when, max(rate, 1e-4)) if rate == rate else {}
        root = next((v for v, p, *_ in nodes if p is None), None)
        return pd.DataFrame([{"rate": rate, "rss": rss, "root": at.get(root), "newick": kn.newick_text(nodes)}])

    return dg.per_group(aligned(s, d), "clade", tree, "rate double, rss double, root double, newick string")


def coselection_sectors(s, d):
    """Sites in groups by greedy modularity of the co-selection network: groups never join across components, so each
    component is one task's matrix; a sector is named by its component and its rank in it."""
    e = stored(coselection_pairs(s, d).select(F.col("a").alias("i"), F.col("b").alias("j"), "sim"))
    whole = 2 * (e.agg(F.sum("sim")).first()[0] or 0.0)
    label = gr.components(e)
    e = e.join(label, e["i"] == label["node"]).select("component", F.col("i").alias("a"), F.col("j").alias("b"), "sim")

    def sectors(f: pd.DataFrame) -> pd.DataFrame:
        sites_ = np.unique(np.r_[f["a"], f["b"]])
        w = np.zeros((len(sites_), len(sites_)))
        i, j = np.searchsorted(sites_, f["a"]), np.searchsorted(sites_, f["b"])
        w[i, j] = w[j, i] = f["sim"]
        return pd.DataFrame({"component": f["component"].iloc[0], "site": sites_, "sector": kn.modularity_groups(w, whole)})

    return e.groupBy("component").applyInPandas(sectors, "component int, site int, sector int")


BELOW = "conv(substr(md5(cast({} as string)), 1, 7), 16, 10)"


def gene_split(s, d):
    """Four fifths of the genes for fitting, the rest held out, by a hash of the gene; rows follow their gene."""
    part = F.when(F.expr(BELOW.format("gene_id")).cast("long") % 100 < 80, "fit").otherwise("held out")
    genes = table(s, d, "orthomam_gene_selection").select("gene_id", part.alias("part"))
    x = table(s, d, "orthomam_site_selection").select("gene_id", "lrt").join(genes, "gene_id")
    return x.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("gene_id").alias("genes"))


def stratified_sites(s, d):
    """Sites drawn with more weight to strong signals: all above ten, then a half, a fifth, a tenth, a twentieth."""
    share = F.when(F.col("lrt") >= 10, 100).when(F.col("lrt") >= 4, 50).when(F.col("lrt") >= 1, 20).when(F.col("lrt") > 0, 10).otherwise(5)
    x = table(s, d, "orthomam_site_selection").where("gene_id is not null and lrt is not null and not isnan(lrt)").withColumn("share", share)
    h = F.expr(BELOW.format("concat(gene_id, ':', site_1idx)")).cast("long") % 100
    return x.where(h < F.col("share")).groupBy("share").agg(F.count("*").alias("rows"), F.round(F.avg("lrt"), 6).alias("mean"))


def reported_genes(s, d):
    """The report as SQL text over views: named genes that are no controls, with how many of their sites pass."""
    table(s, d, "orthomam_gene_selection").createOrReplaceTempView("v_genes")
    table(s, d, "orthomam_site_selection").createOrReplaceTempView("v_sites")
    return s.sql("select g.gene_id, g.gene_symbol, count(*) as rows, sum(case when s.q_value <= 0.1 then 1 else 0 end) as passed from v_genes g join v_sites s on g.gene_id = s.gene_id where g.gene_symbol is not null and g.gene_symbol not like 'K%' group by g.gene_id, g.gene_symbol")


QUERIES = {f.__name__: f for f in (padded_records, near_pair_rarity, trait_match, cluster_dossiers, location_geojson, epicentres, changepoints, tree_rotations, dated_trees, coselection_sectors, gene_split, stratified_sites, reported_genes)}
_BELOW = "('0x' || substr(md5(({})::varchar), 1, 7))::bigint % 100"
_JSON_NUMBER = "case when {0} = trunc({0}) then trunc({0})::bigint || '.0' else {0}::varchar end"
ORACLE = {
    "location_geojson": "with h as (select location, round(avg(lat), 4) lat, round(avg(lon), 4) lon, count(*) n from h5n1_ha_metadata where location is not null group by 1) select '{\"type\":\"Feature\",\"geometry\":' || case when lat is null or lon is null then 'null' else '{\"type\":\"Point\",\"coordinates\":[' || lon || ',' || lat || ']}' end || ',\"properties\":{\"location\":' || to_json(location) || ',\"n\":' || n || '}}' \"value\" from h",
    "cluster_dossiers": f"{_COMP}, mm as (select component, count(*) size, count(distinct label) clades, round(2000 + min(node * 37 % 240) / 12e0, 4) a, round(2000 + max(node * 37 % 240) / 12e0, 4) z from l join embeddings on vec_id = node group by 1), k as (select component, count(*) edges from e join l on i = node group by 1), q as (select *, round(2 * edges / (size * (size - 1)), 6) dens from mm join k using (component)) select component, '{{\"size\":' || size || ',\"edges\":' || edges || ',\"clades\":' || clades || ',\"span\":{{\"first\":' || {_JSON_NUMBER.format('a')} || ',\"last\":' || {_JSON_NUMBER.format('z')} || '}},\"density\":' || {_JSON_NUMBER.format('dens')} || '}}' dossier from q",
    "gene_split": f"with g as (select gene_id, case when {_BELOW.format('gene_id')} < 80 then 'fit' else 'held out' end part from orthomam_gene_selection) select part, count(*) \"rows\", count(distinct gene_id) genes from orthomam_site_selection join g using (gene_id) group by 1",
    "stratified_sites": f"with x as (select *, case when lrt >= 10 then 100 when lrt >= 4 then 50 when lrt >= 1 then 20 when lrt > 0 then 10 else 5 end share from orthomam_site_selection where gene_id is not null and lrt is not null and not isnan(lrt)) select share, count(*) \"rows\", round(avg(lrt), 6) mean from x where {_BELOW.format("gene_id || ':' || site_1idx")} < share group by 1",
    "reported_genes": "select g.gene_id, g.gene_symbol, count(*) \"rows\", sum(case when s.q_value <= 0.1e0 then 1 else 0 end)::bigint passed from orthomam_gene_selection g join orthomam_site_selection s using (gene_id) where g.gene_symbol is not null and g.gene_symbol not like 'K%' group by all",
    "padded_records": "select row_ord, (select max(length(seq)) from fasta_record)::int width, ((select max(length(seq)) from fasta_record) - length(coalesce(seq, '')))::int filled from fasta_record",
    "near_pair_rarity": f"with {_COUNT.format('')}, p as (select i, j from n where diff / tot <= {NEAR}e0), f as (select site, state, greatest(count(*) / sum(count(*)) over (partition by site), 1e-4) f from v group by site, state), r as (select taxon, site, state, f from v join f using (site, state) where f < 0.2e0), s as (select p.i, p.j, count(*) shared, sum(-ln(a.f)) nats from p join r a on a.taxon = p.i join r b on b.taxon = p.j and a.site = b.site and a.state = b.state group by all) select i, j, coalesce(shared, 0) shared, round(coalesce(nats, 0), 6) nats from p left join s using (i, j)",
    "trait_match": "with w as (select row_ord, unnest(string_split(name, '_')) w from fasta_record where name is not null), h(host, trait) as (values ('Duck', 'waterfowl'), ('gull', 'shore'), ('CHICKEN', 'poultry'), ('turk', 'poultry')), m as (select row_ord, case when w = host then 0 when lower(w) = lower(host) then 1 else 2 end how, host, trait from w join h on contains(lower(w), lower(host))) select row_ord, how::int how, trait from (select *, row_number() over (partition by row_ord order by how, host, trait) r from m) where r = 1",
}
