"""Queries on joins, windows, trees, transmission, screening and recombination."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cladeflow.functions.times import micros
from cladeflow.operators.prefix_sums import running_sums
from cladeflow.operators import distances as ds
from cladeflow.operators import recombination as rc
from cladeflow.operators import screening as sc
from cladeflow.operators import transmission as tr
from cladeflow.operators import trees as te
from cladeflow.operators.alignments import consensus
from cladeflow.plans.alignments import SITES, aligned, plain_base, sites
from cladeflow.plans.networks import NEAR, _COUNT, _D, _FLOOR, _FORM, _near, _pairs
from cladeflow.session import spread, stored, table
from cladeflow.streaming import screen as ss

HEAD = r"^([^|_. ]*)"


def _day():
    """Days since the start of 2024 of an event."""
    return micros("ts") / F.lit(86400e6) - 19723


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# joins


def metadata_cascade(s, d):
    """Metadata row -> record: by the whole id, else its first word, else its part before | _ or . ; the first record of that name."""
    names = table(s, d, "fasta_record").where("name <> ''").groupBy("name").agg(F.min("row_ord").alias("rec"))
    m = table(s, d, "meta").where("id is not null").select("meta_row", "id", F.split(F.trim("id"), " ").getItem(0).alias("word"), F.regexp_extract(F.trim("id"), HEAD, 1).alias("head"))
    for k, c in enumerate(("id", "word", "head")):
        n = names.select(F.col("name").alias(f"n{k}"), F.col("rec").alias(f"r{k}"))
        m = m.join(n, m[c] == n[f"n{k}"], "left")
    return m.select("meta_row", F.coalesce("r0", "r1", "r2", F.lit(-1)).alias("record"), F.when(F.col("r0").isNotNull(), "full").when(F.col("r1").isNotNull(), "word").when(F.col("r2").isNotNull(), "head").otherwise("none").alias("how"))


def evaluation_join(s, d):
    """Delivered sites against the genes' summary: in both, or on one side only."""
    p = table(s, d, "orthomam_site_selection").where("gene_id is not null").groupBy("gene_id").agg(F.count_if(F.col("p_value") <= 0.05).alias("called"))
    t = table(s, d, "orthomam_gene_selection").select(F.col("gene_id").alias("g"), "sig_sites_p05")
    x = p.join(t, p["gene_id"] == t["g"], "full")
    side = F.when(F.col("g").isNull(), "predictions").when(F.col("gene_id").isNull(), "truth").otherwise("both")
    return x.groupBy(side.alias("side")).agg(F.count("*").alias("genes"), F.sum("called").alias("called"), F.sum("sig_sites_p05").alias("summary"))


def names_without_metadata(s, d):
    f = table(s, d, "fasta_record").where("name <> ''").select("name").distinct()
    return f.join(table(s, d, "meta").select(F.col("id").alias("name")), "name", "left_anti")


def edge_union(s, d):
    """Static edges and well supported ones as one set of unordered pairs with their status."""
    e = table(s, d, "supported_edges").where("id1 is not null and id2 is not null and id1 <> id2").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "distance", "q_value")
    e = e.groupBy("a", "b").agg(F.min("distance").alias("d"), F.min("q_value").alias("q"))
    st = tr.edge_status(F.coalesce("d", F.lit(9.0)), F.coalesce("q", F.lit(9.0)), 0.015, 0.05)
    return e.select("a", "b", st.alias("status")).where("status <> 'NONE'")


def edge_status_report(s, d):
    return edge_union(s, d).groupBy("status").agg(F.count("*").alias("edges"))


def top_genes(s, d):
    """The ten genes with the highest largest statistic: a report."""
    return table(s, d, "orthomam_gene_selection").select("gene_id", "max_lrt").orderBy(F.desc("max_lrt"), "gene_id").limit(10)


# windows


def sliding_windows(s, d):
    """Counts and mean in windows of two days every half day; both ends belong to a window."""
    e = table(s, d, "events").select("event_type", "value", _day().alias("t"))
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - 2) * 2)).cast("int")
    e = e.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") * 2).cast("int"))))
    return e.groupBy("event_type", (F.col("w") / 2).alias("start")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def gradient_profile(s, d):
    """Daily means, their central differences and the trapezoid under them."""
    e = table(s, d, "events").groupBy("event_type", F.floor(_day()).alias("day")).agg(F.avg("value").alias("y"))
    w = Window.partitionBy("event_type").orderBy("day")
    x = e.withColumn("slope", F.coalesce((F.lead("y").over(w) - F.lag("y").over(w)) / (F.lead("day").over(w) - F.lag("day").over(w)), F.lit(0.0)))
    x = x.withColumn("area", F.coalesce((F.lead("y").over(w) + F.col("y")) / 2 * (F.lead("day").over(w) - F.col("day")), F.lit(0.0)))
    return x.select("event_type", "day", *r6("y", "slope", "area"))


def kernel_regression(s, d):
    """Gaussian-weighted mean of the value at sixty points in time, from hourly sums."""
    h = table(s, d, "events").groupBy("event_type", F.floor(_day() * 24).alias("h")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    g = h.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(59))))
    k = F.exp(-0.5 * F.pow(((F.col("h") + 0.5) / 24 - F.col("g") / 2) / 1.5, 2))
    return g.groupBy("event_type", (F.col("g") / 2).alias("at")).agg(F.round(F.sum(k * F.col("v")) / (F.sum(k * F.col("n")) + 1e-8), 6).alias("fit"))


def stratified_anchors(s, d):
    """Per tenth of the time span and type the first event by value: a stratified pick."""
    e = table(s, d, "events").select("event_id", "event_type", "value", _day().alias("t"))
    b = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    e = e.join(F.broadcast(b)).withColumn("bin", F.least(F.lit(9), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10)))
    return e.groupBy("bin", "event_type").agg(F.min(F.struct("value", "event_id")).alias("m")).select("bin", "event_type", F.col("m.event_id").alias("event_id"))


def landmark_dates(s, d):
    """Taxa at sixteen evenly spaced places of the date order in each clade."""
    a = aligned(s, d).select("taxon", "clade", "date")
    a = running_sums(a, ["clade"], ["date", "taxon"], {"at": F.lit(1)}).withColumn("k", F.col("at_run") - 1).withColumn("n", F.col("at_all"))
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i * (F.col("n") - 1) / 15))
    return a.where(F.array_contains(at, F.col("k"))).select("clade", "taxon")


def event_properties(s, d):
    e = table(s, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("top"), F.count("k").alias("n"))


def ordinal_decode(s, d):
    """Thresholded logits to a level: expm1 of the summed sigmoids times the step."""
    e = table(s, d, "embeddings")
    z = F.aggregate(F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))), F.lit(0.0), lambda a, x: a + x * 0.05)
    return e.select("vec_id", F.round(F.expm1(z), 6).alias("level"))


def phenotype_vector(s, d):
    """Host pattern in the name as 0/1, standardised over all records."""
    f = table(s, d, "fasta_record").where("name is not null").select("row_ord", F.when(F.lower("name").rlike("duck|gull|swan"), 1.0).otherwise(0.0).alias("y"))
    m = f.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"))
    return f.join(F.broadcast(m)).select("row_ord", F.round((F.col("y") - F.col("m")) / F.greatest("sd", F.lit(1e-12)), 6).alias("z"))


def coselection_pairs(s, d):
    """Cosine over taxa of the sites' deviations from the consensus, with its t statistic."""
    x = sites(s, d)
    c = consensus(x, plain_base()).select("site", F.col("state").alias("c"))
    dev = stored(x.where(plain_base()).join(c, "site").where("state <> c").select("taxon", "site"))
    n = dev.groupBy("site").agg(F.count("*").alias("n"))
    p = dev.join(dev.select("taxon", F.col("site").alias("s2")), "taxon").where("site < s2").groupBy("site", "s2").agg(F.count("*").alias("shared"))
    p = p.join(n, "site").join(n.select(F.col("site").alias("s2"), F.col("n").alias("n2")), "s2")
    sim = F.col("shared") / F.sqrt(F.col("n") * F.col("n2"))
    df = F.greatest(F.lit(1), table(s, d, "embeddings").count() - F.lit(2))
    return p.withColumn("sim", sim).where("shared >= 3 and sim >= 0.3").select(F.col("site").alias("a"), F.col("s2").alias("b"), "shared", F.round("sim", 6).alias("sim"), F.round(F.col("sim") * F.sqrt(df / F.greatest(F.lit(1e-9), 1 - F.col("sim") * F.col("sim"))), 4).alias("t"))


# transmission

MODEL = tr.PairModel(rate=0.002, length=64.0, span=20.0, r_bg=12.0, p_bg=0.4)


def _dated(s, d):
    p = _near(s, d)
    a = aligned(s, d).select(F.col("taxon").alias("i"), F.col("date").alias("di"))
    b = aligned(s, d).select(F.col("taxon").alias("j"), F.col("date").alias("dj"))
    return p.join(a, "i").join(b, "j").select("i", "j", F.col("hamming").alias("d"), F.abs(F.col("di") - F.col("dj")).alias("dt"))


def envelope_pairs(s, d):
    return _dated(s, d).where(tr.envelope(F.col("d"), F.col("dt"), MODEL)).select("i", "j", *r6("d", "dt"))


def supported_transmissions(s, d):
    """Pairs under the model whose background and span are calibrated on all pairs."""
    m = tr.calibrated(aligned(s, d), "taxon", "seq", "date", MODEL)
    x = tr.supported_pairs(_dated(s, d), ["i", "j"], "d", "dt", m, robust=True)
    return x.select("i", "j", *r6("bayes_factor", "pep", "q_value"))


def active_population(s, d):
    """Per clade: records, near edges inside it, and the population they imply."""
    a = aligned(s, d)
    c = a.select(F.col("taxon").alias("i"), "clade")
    e = _near(s, d).join(c, "i").groupBy("clade").agg(F.count("*").alias("e"))
    x = a.groupBy("clade").agg(F.count("*").alias("n")).join(e, "clade", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    return x.select("clade", "n", "e", *tr.active_population(F.col("n"), F.col("e"), 1.5)).select("clade", "n", "e", *(F.round(k, 4).alias(k) for k in ("theta", "rho", "active", "low", "high")))


def reproduction_numbers(s, d):
    """Growth of the daily counts per type, as reproduction numbers of three models and a doubling time."""
    c = table(s, d, "events").groupBy("event_type", F.floor(_day()).alias("day")).agg(F.log(F.count("*")).alias("y"))
    g = c.groupBy("event_type").agg((F.regr_slope("y", "day") * 365.25).alias("growth"))
    return g.select("event_type", *r6("growth"), F.round(tr.sir_r0(F.col("growth"), 0.02), 6).alias("sir"), F.round(tr.seir_r0(F.col("growth"), 0.01, 0.02), 6).alias("seir"), F.round(tr.gamma_r0(F.col("growth"), 0.02, 0.01), 6).alias("gamma"), F.round(F.try_divide(F.log(F.lit(2.0)), F.col("growth")), 6).alias("doubling"))


def migration_flux(s, d):
    """Affinity between clades: summed over near pairs and divided by the product of sizes."""
    a = aligned(s, d).select(F.col("taxon").alias("t"), "clade")
    n = a.groupBy("clade").agg(F.count("*").alias("n"))
    p = _pairs(s, d, ["hamming"], 0.6).join(a, F.col("i") == F.col("t")).drop("t").withColumnRenamed("clade", "ci").join(a, F.col("j") == F.col("t")).drop("t").withColumnRenamed("clade", "cj")
    f = p.groupBy(F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b")).agg(F.sum(1 - F.col("hamming")).alias("w"))
    f = f.join(n.select(F.col("clade").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("clade").alias("b"), F.col("n").alias("nb")), "b")
    return f.select("a", "b", F.round(F.col("w") / (F.col("na") * F.col("nb")), 8).alias("flux"))


def source_sink(s, d):
    """Edges from the earlier to the later taxon: out, in and net flux per taxon."""
    p = _near(s, d)
    a = aligned(s, d).select("taxon", "date")
    p = p.join(a.select(F.col("taxon").alias("i"), F.col("date").alias("di")), "i").join(a.select(F.col("taxon").alias("j"), F.col("date").alias("dj")), "j").where("di <> dj")
    ends = p.select(F.explode(F.array(F.struct(F.when(F.col("di") < F.col("dj"), F.col("i")).otherwise(F.col("j")).alias("node"), F.lit(1).alias("out")), F.struct(F.when(F.col("di") < F.col("dj"), F.col("j")).otherwise(F.col("i")).alias("node"), F.lit(0).alias("out")))).alias("x"))
    g = ends.groupBy("x.node").agg(F.sum("x.out").alias("sent"), F.sum(1 - F.col("x.out")).alias("received"))
    return g.withColumn("net", F.col("sent") - F.col("received"))


def centroids(s, d):
    h = table(s, d, "h5n1_ha_metadata").where("location is not null and lower(trim(location)) not in ('none', 'nan', 'unknown', '')")
    return h.groupBy("location").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("n")).where("n >= 3")


# trees


def tree_nodes(s, d):
    """World, regions, nations and customers as one rooted tree."""
    r = table(s, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), (1 + F.col("r_regionkey") / 10).alias("length"))
    n = table(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("node"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), (0.5 + F.col("n_nationkey") / 100).alias("length"))
    c = table(s, d, "customer").select((F.col("c_custkey") + 1000).alias("node"), (F.col("c_nationkey") + 100).cast("long").alias("parent"), (F.abs("c_acctbal") / 10000).alias("length"))
    root = s.createDataFrame([(0, None, 0.0)], "node long, parent long, length double")
    return root.unionByName(r).unionByName(n).unionByName(c)


def tree_depths(s, d):
    n = tree_nodes(s, d)
    return te.depths(n, te.closure(n)).select("node", *r6("depth"))


def patristic_nations(s, d):
    n = tree_nodes(s, d).where("node < 1000")
    close = stored(te.closure(n))
    k = n.where("node >= 100").select(F.col("node").alias("i"))
    pairs = k.join(k.select(F.col("i").alias("j")), F.col("i") < F.col("j"))
    return te.shared_depth(pairs, close, te.depths(n, close)).select("i", "j", *r6("shared", "distance"))


def fitch_states(s, d):
    n = tree_nodes(s, d)
    return te.fitch(n.select("node", "parent"), _segments(s, d)).select("node", "state", "changed")


def _segments(s, d):
    """Tip states; of customers in debt the segment counts as unknown."""
    seg = F.instr(F.lit("AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY"), F.col("c_mktsegment"))
    return table(s, d, "customer").select((F.col("c_custkey") + 1000).alias("node"), F.when(F.col("c_acctbal") >= 0, F.floor(seg / 10)).alias("state"))


def root_states(s, d):
    return te.root_states(tree_nodes(s, d).select("node", "parent"), _segments(s, d)).select("state", *r6("share"))


def transitions(s, d):
    return te.transition_counts(te.fitch(tree_nodes(s, d).select("node", "parent"), _segments(s, d)))


def coalescent(s, d):
    """Lineages through time: orders as sampled tips, every second one as a coalescence."""
    o = table(s, d, "orders").select("o_orderpriority", (F.lit(12000) - F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01"))).alias("tau"), F.when(F.col("o_totalprice") > 150000, -1).otherwise(1).alias("step"))
    x = te.coalescent_intervals(o, ["o_orderpriority"])
    return x.select("o_orderpriority", "tau1", "tau2", "k", "events")


def growth_rates(s, d):
    """Growth of the coalescent rate per order priority, by the likelihood of the intervals: orders as tips, four fifths of
    them joining 400 days earlier."""
    o = table(s, d, "orders").select("o_orderpriority", (F.lit(12000) - F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01"))).alias("tau"), "o_totalprice")
    steps = o.select("o_orderpriority", "tau", F.lit(1).alias("step")).unionByName(o.where("o_totalprice > 60000").select("o_orderpriority", (F.col("tau") + 400).alias("tau"), F.lit(-1).alias("step")))
    x = te.coalescent_intervals(steps, ["o_orderpriority"]).where("k > 1 and events > 0")
    x = x.select("o_orderpriority", "k", (F.col("tau1") / 365.25).alias("tau1"), (F.col("tau2") / 365.25).alias("tau2"), "events")
    return tr.growth_rate(x, ["o_orderpriority"])


# screening


def _screened(s, d):
    """Every taxon against the clock and the anchors of its data set."""
    a = aligned(s, d)
    first = stored(a.groupBy("clade").agg(F.min_by("seq", F.struct("date", "taxon")).alias("rs"), F.min("date").alias("d0")))
    x = a.join(first.select("clade", "rs"), "clade")
    same = F.aggregate(F.zip_with(F.split("seq", ""), F.split("rs", ""), lambda p, q: F.when((p != "-") & (q != "-"), F.when(p != q, 1).otherwise(0))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda z, v: F.struct((z["n"] + v.isNotNull().cast("int")).alias("n"), (z["k"] + F.coalesce(v, F.lit(0))).alias("k")))
    x = x.withColumn("q", same).withColumn("d", F.try_divide("q.k", "q.n"))
    return x.select("taxon", "clade", "date", "seq", "d", (F.length(F.replace(F.col("seq"), F.lit("-"), F.lit(""))) * -1 + F.length("seq")).alias("n_missing"), F.length("seq").alias("length"))


def screening_model(s, d):
    """Records, clock and the anchors that calibrated it."""
    x = stored(_screened(s, d))
    anchors = stored(sc.draw_anchors(x, "taxon", "date"))
    return x, sc.calibrate(anchors, "date", "d"), anchors


def triage_status(s, d):
    x, m, anchors = screening_model(s, d)
    return ss.screen(spread(x), m, anchors, "taxon", "d", "date", "seq").select("taxon", "status", F.round("predicted_date", 4).alias("predicted"), (F.round("z", 4) + 0.0).alias("z"))


# recombination


def _attention(s, d):
    x = sites(s, d).where(plain_base()).select("taxon", "site", "state")
    c = sites(s, d).where(plain_base()).groupBy("clade", "site", "state").agg(F.count("*").alias("n")).groupBy("clade", "site").agg(F.min(F.struct((-F.col("n")).alias("n"), "state")).alias("m")).select(F.col("clade").alias("channel"), F.col("site").alias("cs"), F.col("m.state").alias("c"))
    sx = x.join(c, x["site"] == c["cs"]).select("taxon", "site", "channel", F.when(F.col("state") == F.col("c"), 1.0).otherwise(0.0).alias("score"))
    return rc.attention(sx, ["taxon", "site"])


def site_attention(s, d):
    return _attention(s, d).groupBy("taxon", "channel").agg(F.round(F.avg("attention"), 6).alias("mean"), F.round(F.max("attention"), 6).alias("top"))


def _force(s, d):
    a = stored(_attention(s, d))
    m = a.groupBy("site", "channel").agg(F.avg("attention").alias("m"))
    return a.join(m, ["site", "channel"]).select("taxon", "channel", "site", (F.col("attention") - F.col("m")).alias("force"))


def cumulative_momentum(s, d):
    x = rc.momentum(_force(s, d), ["taxon", "channel"], "site", "force")
    return x.groupBy("taxon", "channel").agg(*((F.round(F.max(k), 6) + 0.0).alias(k) for k in ("momentum", "bridge", "window")))


def best_tracts(s, d):
    x = rc.best_segments(_force(s, d), ["taxon", "channel"], "site", "force", 0.05)
    return x.select("taxon", "channel", *r6("gain"))


def tract_tests(s, d):
    a = aligned(s, d).select("taxon", "clade")
    f = a.groupBy("clade").agg(F.min("taxon").alias("t"))
    g = f.select((F.col("clade") - 1).alias("c2"), F.col("t").alias("donor"))
    t = a.join(f.withColumnRenamed("t", "home"), "clade").join(g, F.col("clade") == F.col("c2")).select(F.col("taxon").alias("child"), "home", "donor", F.lit(16).alias("first"), F.lit(31).alias("last"))
    x = rc.tract_counts(sites(s, d), t)
    return x.select("child", "donor", "a", "b", "c", "d", F.round(rc.fisher_one_sided("a", "b", "c", "d"), 6).alias("p"))


def landmark_prior(s, d):
    x = _screened(s, d)
    return x.where("d is not null").select("taxon", (F.round(rc.prior(F.col("d")), 6) + 0.0).alias("log_prior"))


QUERIES = {f.__name__: f for f in (metadata_cascade, evaluation_join, names_without_metadata, edge_union, edge_status_report, top_genes, sliding_windows, gradient_profile, kernel_regression, stratified_anchors, landmark_dates, event_properties, ordinal_decode, phenotype_vector, coselection_pairs, envelope_pairs, supported_transmissions, active_population, reproduction_numbers, migration_flux, source_sink, centroids, tree_depths, patristic_nations, fitch_states, root_states, transitions, coalescent, growth_rates, triage_status, site_attention, cumulative_momentum, best_tracts, tract_tests, landmark_prior)}

_E = "e as (select *, epoch_us(ts) / 86400e6 - 19723 t from events)"
_NODES = "nodes as (select 0::bigint node, null::bigint parent, 0e0 length union all select r_regionkey + 1, 0, 1 + r_regionkey / 10e0 from region union all select n_nationkey + 100, n_regionkey + 1, 0.5e0 + n_nationkey / 100e0 from nation union all select c_custkey + 1000, c_nationkey + 100, abs(c_acctbal) / 10000e0 from customer)"
_DEPTH = f"{_NODES}, dep as (select node, parent, length depth from nodes where parent is null union all select n.node, n.parent, dep.depth + n.length from nodes n join dep on n.parent = dep.node)"
_NEARD = f"with {_COUNT.format('')}, dd as (select i, j, diff / tot d, abs((i * 37 % 240) - (j * 37 % 240)) / 12e0 dt, (i * 37 % 240) di, (j * 37 % 240) dj from n where diff / tot <= {NEAR}e0)"
_UNION = """with e as (select least(id1, id2) a, greatest(id1, id2) b, coalesce(min(distance), 9) d, coalesce(min(q_value), 9) q from supported_edges where id1 is not null and id2 is not null and id1 <> id2 group by all)
select a, b, case when q <= 0.05e0 and d <= 0.015e0 then 'BOTH' when q <= 0.05e0 then 'SUPPORTED' else 'STATIC_ONLY' end status from e where q <= 0.05e0 or d <= 0.015e0"""
_ATT = f"""with {SITES}, cc as (select clade channel, site, state c from (select *, row_number() over (partition by clade, site order by n desc, state) r from (select clade, site, state, count(*) n from v group by all)) where r = 1),
sx as (select taxon, v.site, channel, case when state = c then 1e0 else 0e0 end score from v join cc using (site)), att as (select *, exp(score) / sum(exp(score)) over (partition by taxon, site) attention from sx)"""
_FORCE = f"{_ATT}, fo as (select taxon, channel, site, attention - avg(attention) over (partition by site, channel) force from att)"

# log of the upper incomplete gamma ratio for a = k + 1: -x - lgamma(k + 1) + ln of the integral of (x + t)^k e^-t, by Simpson's rule
_UPPER = "(-{x} - lgamma(k + 1) + ln((select sum((case when j in (0, 3000) then 1 when j % 2 = 1 then 4 else 2 end) * exp(k * ln({x} + j * 0.02e0) - j * 0.02e0)) * 0.02e0 / 3 from range(0, 3001) g(j))))"
_SUPPORTED = f"""with {_COUNT.format('')}, al as (select i, j, diff / tot d, abs((i * 37 % 240) - (j * 37 % 240)) / 12e0 dt from n),
bg as (select avg(d * 64) m, var_pop(d * 64) v, (select (max(vec_id * 37 % 240) - min(vec_id * 37 % 240)) / 12e0 from embeddings) sp from al),
bp as (select sp, case when v > m and m > 0 then 1 - m / v else 0.95e0 end p, case when v > m and m > 0 then m * (m / v) / (1 - m / v) else 5e0 end r from bg),
c as (select i, j, d * 64 k, dt from al where d <= {NEAR}e0 and dt <= 20 and d <= 1.5e0 * ({MODEL.base_distance!r}e0 + 2 * 0.002e0 * dt)),
mo(rate, tau) as (values (1.5e-3, 0.05e0), (1.5e-3, 3e0), (3.5e-3, 0.05e0), (3.5e-3, 3e0)),
x as (select i, j, k, dt, rate, tau, 2 * rate * 64 b, 2 * rate * 64 + 1 / tau cc, sp, greatest(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(1 - p) + k * ln(p), ln(1e-300)) + ln(greatest(2 / sp * (1 - least(dt, greatest(sp - 1, sp / 2)) / sp), 1e-6 / sp)) lu from c, mo, bp),
y as (select *, case when dt <= 1e-15 then ln(1 - b * tau / (b * tau + 1)) + k * ln(b * tau / (b * tau + 1)) else dt / (2 * tau) + k * ln(b) - (k + 1) * ln(cc) - ln(tau) + greatest({_UPPER.format(x='(cc * greatest(dt, 1e-15) / 2)')}, ln(1e-300)) end ll,
 case when rate * 64 * dt <= 0 then 1 else (select sum(exp(q * ln(rate * 64 * dt) - rate * 64 * dt - lgamma(q + 1))) from range(0, floor(k)::bigint + 1) g(q)) end fit from x),
z as (select i, j, min(case when fit >= 0.05e0 then exp(least(greatest(ll, ln(1e-300)) - dt - lu, 700)) else 0 end) bf from y group by all),
pq as (select *, case when bf > 0 then 1 / (1 + bf) else 1e0 end pep from z), ur as (select *, avg(pep) over (order by pep, i, j rows unbounded preceding) ru from pq)
select i, j, round(bf, 6) bayes_factor, round(pep, 6) pep, round(min(ru) over (order by pep, i, j rows between current row and unbounded following), 6) q_value from ur"""

# halves of 32 sites share too few with any anchor to be scored, so no record of this alignment is a chimera
_TRIAGE = f"""with {SITES}, f as (select label clade, arg_min(vec_id, (vec_id * 37 % 240) * 1000000000 + vec_id) t from embeddings group by 1),
rd as (select v.taxon, count(*) filter (v.state <> r.state) / count(*) d from v join f using (clade) join v r on r.taxon = f.t and r.site = v.site group by 1),
re as (select s.taxon, any_value(s.date) t, count(*) filter (s.state = '-') miss, count(*) len from sites s group by 1),
rr as (select re.*, rd.d from re left join rd using (taxon)), en as (select min(t) lo, max(t) hi from rr),
an as (select taxon, t, d from (select rr.*, row_number() over (partition by case when hi > lo then least(31, floor((t - lo) / (hi - lo) * 32)) else 0 end order by ('0x' || substr(md5(taxon::varchar), 1, 8))::bigint, taxon) r from rr, en) where r <= 32),
cm as (select regr_slope(d, t) b, avg(t) filter (d is not null) tr, avg(d) d0, regr_syy(d, t) yy, regr_sxy(d, t) xy, count(d) n, min(t) filter (d is not null) lo, max(t) filter (d is not null) hi, median(d) med from an),
cl as (select *, sqrt(greatest(yy - b * xy, 0) / n) sg, hi - lo sp, case when b > 1e-12 then least(tr - d0 / b, lo) else lo end og from cm),
n as (select a.taxon i, b.taxon j, count(*) tot, count(*) filter (a.state <> b.state) diff, {", ".join(f"count(*) filter (a.state = '{x}') + count(*) filter (b.state = '{x}') n{x}" for x in "ACGT")}, count(*) filter (a.state in ('A', 'G') and b.state in ('A', 'G') and a.state <> b.state) ag, count(*) filter (a.state in ('C', 'T') and b.state in ('C', 'T') and a.state <> b.state) ct from v a join v b on a.site = b.site join an on b.taxon = an.taxon group by all), {_FORM.format(f=_FLOOR)},
di as (select i, j, case when tot >= 50 then greatest(case when least(a1, a2, a3) <= 0 then h else {_D} end, 0) else 1 end dn from x),
nn as (select i, j, dn from (select *, row_number() over (partition by i order by round(dn, 12), j) r from di) where r = 1),
ev as (select rr.taxon, rr.t, rr.d, miss, miss / len missing, dn nn, an.t nt, cl.*, (rr.d - (d0 + b * (rr.t - tr))) / greatest(sg, 1e-12) z, case when b > 1e-7 then tr + (rr.d - d0) / b end pr from rr join nn on nn.i = rr.taxon join an on an.taxon = nn.j, cl),
ex as (select *, coalesce((pr - t) * 365.25e0, 0) er, z > 2.5 and (nn > 1.25e0 * med or abs(nt - t) <= 1.5e0) exc from ev)
select taxon, case when missing > 0.05e0 then 'SUS_LOW_QUALITY' when nn > greatest(0.08e0, 3.5e0 * med) then 'SUS_CONTAMINANT' when d <= 0.0002e0 and t >= og + 0.6e0 * sp and z <= -2.5 then 'SUS_ARCHIVAL' when exc and (miss > 10 or missing > 0.02e0) then 'SUS_LOW_QUALITY' when exc then 'SUS_HYPERMUTATED'
 when ((abs(er) > 60 and abs(z) >= 2) or abs(er) > greatest(365.25e0, 0.75e0 * sp * 365.25e0)) and nn <= 2.5e0 * greatest(med, 0.001e0) then 'SUS_DATE_MISMATCH' else 'PASS' end status, {{}} from ex"""

# four levels: world, regions, nations, customers
_LEAST = "floor(log2(({0} & (-{0}))::double))::int"
_UP = "case when bit_and({0}) <> 0 then bit_and({0}) else bit_or({0}) end"
_DOWN = f"case when ({{0}} & (1::bigint << {{1}})) <> 0 then {{1}} else {_LEAST} end"
_FITCH_SETS = f"""with k as (select c_custkey + 1000 node, c_nationkey + 100 p, case when c_acctbal >= 0 then 1::bigint << (instr('AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY', c_mktsegment) // 10)::int end s from customer),
c as (select node, p, coalesce(s, (select bit_or(s) from k)) s from k),
n as (select n_nationkey + 100 node, any_value(n_regionkey) + 1 p, case when count(c.s) = 0 then (select bit_or(s) from k) else {_UP.format('c.s')} end s from nation left join c on c.p = n_nationkey + 100 group by 1),
r as (select p node, {_UP.format('s')} s from n group by p), w as (select {_UP.format('s')} s from r),
w2 as (select {_LEAST.format('s')} st from w), r2 as (select node, st ps, {_DOWN.format('s', 'st')} st from r, w2),
n2 as (select n.node, r2.st ps, {_DOWN.format('n.s', 'r2.st')} st from n join r2 on n.p = r2.node),
c2 as (select c.node, n2.node up, n2.st ps, {_DOWN.format('c.s', 'n2.st')} st from c join n2 on c.p = n2.node)"""
_FITCH = f"""{_FITCH_SETS}
select 0::bigint node, st state, false changed from w2 union all select node, st, st <> ps from r2 union all select node, st, st <> ps from n2 union all select node, st, st <> ps from c2"""

ORACLE = {
    "metadata_cascade": r"with f as (select name, min(row_ord) rec from fasta_record where name <> '' group by 1), m as (select meta_row, id, string_split(trim(id), ' ')[1] word, regexp_extract(trim(id), '^([^|_. ]*)', 1) head from meta where id is not null) select meta_row, coalesce(a.rec, b.rec, c.rec, -1) record, case when a.rec is not null then 'full' when b.rec is not null then 'word' when c.rec is not null then 'head' else 'none' end how from m left join f a on id = a.name left join f b on word = b.name left join f c on head = c.name",
    "evaluation_join": "select case when g.gene_id is null then 'predictions' when p.gene_id is null then 'truth' else 'both' end side, count(*) genes, sum(called)::bigint called, sum(sig_sites_p05)::bigint summary from (select gene_id, count(*) filter (p_value <= 0.05e0) called from orthomam_site_selection where gene_id is not null group by 1) p full join orthomam_gene_selection g on p.gene_id = g.gene_id group by 1",
    "names_without_metadata": "select distinct name from fasta_record f where name <> '' and not exists (select 1 from meta where id = f.name)",
    "edge_union": _UNION,
    "edge_status_report": f"select status, count(*) edges from ({_UNION}) group by 1",
    "top_genes": "select gene_id, max_lrt from orthomam_gene_selection order by max_lrt desc, gene_id limit 10",
    "sliding_windows": f"with {_E}, w as (select event_type, value, unnest(range(greatest(0, ceil((t - 2) * 2))::bigint, floor(t * 2)::bigint + 1)) w from e) select event_type, w / 2e0 \"start\", count(*) n, round(avg(value), 6) mean from w group by all",
    "gradient_profile": f"with {_E}, g as (select event_type, floor(t)::bigint \"day\", avg(value) y from e group by all) select event_type, \"day\", round(y, 6) y, round(coalesce((lead(y) over w - lag(y) over w) / (lead(\"day\") over w - lag(\"day\") over w), 0), 6) slope, round(coalesce((lead(y) over w + y) / 2 * (lead(\"day\") over w - \"day\"), 0), 6) area from g window w as (partition by event_type order by \"day\")",
    "kernel_regression": f"with {_E}, h as (select event_type, floor(t * 24) h, sum(value) v, count(*) n from e group by all), g as (select *, unnest(range(0, 60)) g from h), k as (select *, exp(-0.5e0 * power(((h + 0.5e0) / 24 - g / 2e0) / 1.5e0, 2)) k from g) select event_type, g / 2e0 \"at\", round(sum(k * v) / (sum(k * n) + 1e-8), 6) fit from k group by all",
    "stratified_anchors": f"with {_E}, b as (select event_id, event_type, value, least(9, floor((t - min(t) over ()) / (max(t) over () - min(t) over ()) * 10))::bigint bin from e) select bin, event_type, event_id from (select *, row_number() over (partition by bin, event_type order by value, event_id) r from b) where r = 1",
    "landmark_dates": "with a as (select vec_id taxon, label clade, row_number() over (partition by label order by vec_id * 37 % 240, vec_id) - 1 k, count(*) over (partition by label) n from embeddings) select clade, taxon from a where k in (select floor(i * (n - 1) / 15) from range(0, 16) t(i))",
    "event_properties": "select event_type, sum((props->>'k')::int)::bigint total, max((props->>'k')::int) top, count(props->>'k') n from events group by 1",
    "ordinal_decode": "select vec_id, round(exp(sum(0.05e0 / (1 + exp(-x)))) - 1, 6) \"level\" from (select vec_id, unnest(embedding)::double x from embeddings) group by 1",
    "phenotype_vector": "with y as (select row_ord, case when regexp_matches(lower(name), 'duck|gull|swan') then 1e0 else 0e0 end y from fasta_record where name is not null) select row_ord, round((y - avg(y) over ()) / greatest(stddev_pop(y) over (), 1e-12), 6) z from y",
    "coselection_pairs": f"with {SITES}, cs as (select site, state c from (select *, row_number() over (partition by site order by n desc, state) r from (select site, state, count(*) n from v group by all)) where r = 1), dev as (select taxon, site from v join cs using (site) where state <> c), nn as (select site, count(*) n from dev group by 1), p as (select a.site a, b.site b, count(*) shared from dev a join dev b on a.taxon = b.taxon and a.site < b.site group by all), q as (select a, b, shared, shared / sqrt(x.n * y.n) sim from p join nn x on a = x.site join nn y on b = y.site) select a, b, shared, round(sim, 6) sim, round(sim * sqrt((select count(*) - 2 from embeddings) / greatest(1e-9, 1 - sim * sim)), 4) t from q where shared >= 3 and sim >= 0.3e0",
    "envelope_pairs": f"{_NEARD} select i, j, round(d, 6) d, round(dt, 6) dt from dd where dt <= 20 and d <= 1.5e0 * ({MODEL.base_distance!r}e0 + 2 * 0.002e0 * dt)",
    "supported_transmissions": _SUPPORTED,
    "active_population": f"with {_COUNT.format('')}, dd as (select ci clade, count(*) e from n where diff / tot <= {NEAR}e0 group by 1), a as (select label clade, count(*) n from embeddings group by 1), x as (select clade, n, coalesce(e, 0) e from a left join dd using (clade)) select clade, n, e, round(2e0 * e / n, 4) theta, round(greatest(0e0, least(1e0, 2e0 * e / n / 1.5e0)), 4) rho, round(1.5e0 * n * n / (2e0 * e), 4) active, round(1.5e0 * n * n / (2e0 * e) * exp(-1.959963984540054e0 / sqrt(e)), 4) low, round(1.5e0 * n * n / (2e0 * e) * exp(1.959963984540054e0 / sqrt(e)), 4) high from x",
    "reproduction_numbers": f"with {_E}, c as (select event_type, floor(t) x, ln(count(*)) y from e group by all), g as (select event_type, regr_slope(y, x) * 365.25e0 growth from c group by 1) select event_type, round(growth, 6) growth, round(1 + growth * 0.02e0, 6) sir, round((1 + growth * 0.01e0) * (1 + growth * 0.02e0), 6) seir, round(case when 1 + growth * 0.005e0 > 0 then power(1 + growth * 0.005e0, 4) else 0e0 end, 6) gamma, round(ln(2e0) / growth, 6) doubling from g",
    "migration_flux": f"with {_COUNT.format('')}, f as (select least(ci, cj) a, greatest(ci, cj) b, sum(1 - diff / tot) w from n where diff / tot <= 0.6e0 group by all), c as (select label, count(*) n from embeddings group by 1) select a, b, round(w / (x.n * y.n), 8) flux from f join c x on a = x.label join c y on b = y.label",
    "source_sink": f"{_NEARD}, o as (select case when di < dj then i else j end s, case when di < dj then j else i end r from dd where di <> dj) select node, sum(o)::bigint sent, sum(1 - o)::bigint received, sum(2 * o - 1)::bigint net from (select s node, 1 o from o union all select r, 0 from o) group by 1",
    "centroids": "select location, round(avg(lat), 6) lat, round(avg(lon), 6) lon, count(*) n from h5n1_ha_metadata where location is not null and lower(trim(location)) not in ('none', 'nan', 'unknown', '') group by 1 having count(*) >= 3",
    "tree_depths": f"with recursive {_DEPTH} select node, round(depth, 6) depth from dep",
    "patristic_nations": f"with recursive {_DEPTH}, x as (select * from dep where node between 100 and 999), r as (select * from dep where node between 1 and 99) select a.node i, b.node j, round(case when a.parent = b.parent then r.depth else 0e0 end, 6) shared, round(a.depth + b.depth - 2 * case when a.parent = b.parent then r.depth else 0e0 end, 6) distance from x a join x b on a.node < b.node join r on a.parent = r.node",
    "fitch_states": _FITCH,
    "root_states": f"{_FITCH_SETS} select x::int state, round(1e0 / bit_count(s), 6) share from (select s, unnest(range(0, 62)) x from w) where (s & (1::bigint << x::int)) <> 0",
    "transitions": f"{_FITCH_SETS} select ps source, st target, count(*) n from (select ps, st from r2 union all select ps, st from n2 union all select ps, st from c2) where ps <> st group by all",
    "coalescent": "with o as (select o_orderpriority, 12000 - (o_orderdate::date - date '1970-01-01') tau, sum(case when o_totalprice > 150000 then -1 else 1 end)::bigint st, (count(*) filter (o_totalprice > 150000))::bigint ev from orders group by all), k as (select o_orderpriority, tau tau1, lead(tau) over w tau2, sum(st) over w k, lead(ev) over w events from o window w as (partition by o_orderpriority order by tau)) select o_orderpriority, tau1, tau2, k::bigint k, events from k where tau2 is not null",
    "site_attention": f"{_ATT} select taxon, channel, round(avg(attention), 6) mean, round(max(attention), 6) top from att group by all",
    "cumulative_momentum": f"{_FORCE}, m as (select taxon, channel, sum(force) over w mo, sum(force) over w - row_number() over w / count(*) over z * sum(force) over z br, sum(greatest(force, 0)) over (w rows between 49 preceding and current row) wi from fo window w as (partition by taxon, channel order by site), z as (partition by taxon, channel)) select taxon, channel, round(max(mo), 6) + 0e0 momentum, round(max(br), 6) + 0e0 bridge, round(max(wi), 6) + 0e0 \"window\" from m group by all",
    "best_tracts": f"{_FORCE}, c as (select *, sum(force) over (partition by taxon, channel order by site) c from fo), g as (select taxon, channel, c - min(c - force) over (partition by taxon, channel order by site) g from c) select taxon, channel, round(max(g), 6) gain from g group by all having max(g) >= 0.05e0",
    "triage_status": _TRIAGE.format("round(pr, 4) predicted, round(z, 4) + 0e0 z"),
    "landmark_prior": f"with {SITES}, f as (select label clade, arg_min(vec_id, (vec_id * 37 % 240) * 1000000000 + vec_id) t from embeddings group by 1), p as (select v.taxon, count(*) n, count(*) filter (v.state <> r.state) k from v join f using (clade) join v r on r.taxon = f.t and r.site = v.site group by 1) select taxon, round(ln(0.05e0 + 0.95e0 * exp(-5 * (-0.75e0 * ln(1 - least(k / n, 0.7499e0) * 4 / 3e0)))), 6) + 0e0 log_prior from p",
    "tract_tests": f"with {SITES}, f as (select label clade, min(vec_id) t from embeddings group by 1), tt as (select vec_id child, h.t home, g.t donor from embeddings e join f h on e.label = h.clade join f g on g.clade = e.label + 1), x as (select child, donor, c.site between 16 and 31 s, c.state = o.state and c.state <> h.state don, c.state = h.state and c.state <> o.state hom from tt join v c on c.taxon = child join v h on h.taxon = home and h.site = c.site join v o on o.taxon = donor and o.site = c.site), q as (select child, donor, count(*) filter (s and don) a, count(*) filter (s and hom) b, count(*) filter (not s and don) c, count(*) filter (not s and hom) d from x group by all), k as (select *, unnest(range(a, least(a + b, a + c) + 1)) k from q) select child, donor, a, b, c, d, round(least(1e0, sum(exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)))), 6) p from k group by all",
}
