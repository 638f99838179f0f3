import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.operators import association as asn
from cladeflow.operators import dating as dg
from cladeflow.operators import dyads as dy
from cladeflow.operators import kernels as kn
from cladeflow.operators import matching as mt
from cladeflow.operators import recombination as rc
from cladeflow.operators import resampling as rs
from cladeflow.sources import reports


def test_dyads_pairs_chains_and_gaps(spark):
    pairs = spark.createDataFrame([("a", "b", 0.001), ("b", "c", 0.002), ("d", "e", 0.004), ("f", "g", 0.2), ("a", "h", None), ("x", "a", float("nan"))], "i string, j string, d double")
    dates = spark.createDataFrame([(t, 2020.0 + k / 10) for k, t in enumerate("abcdefghx")], "taxon string, date double")
    box = lambda d, days: dy.within_box(d, days, 0.01, 60.0)
    got = {r["cluster"]: (r["kind"], r["taxa"], round(r["timespan_days"], 2), r["max_distance"]) for r in dy.dyads(pairs, dates, "d", box).collect()}
    assert got == {"a": ("Point-Source Cluster (N=3)", "a;b;c", 73.05, 0.002), "d": ("Dyad (Pair)", "d;e", 36.53, 0.004)}
    # 0.5 substitutions expected: up to 0.5 + 1.64 sqrt(0.5) + 0.5 of 1000 sites
    ok = spark.range(1).select(*(dy.within_envelope(F.lit(k / 1000), F.lit(0.0), 0.0005, 1000).alias(str(k)) for k in (2, 3))).first()
    assert list(ok) == [True, False]
    assert dy.dyads(pairs.limit(0), dates, "d", box).count() == 0


def test_association_against_numpy(spark):
    rng = np.random.default_rng(3)
    states = rng.choice(list("AC-"), (12, 30), p=[0.7, 0.25, 0.05])
    alpha, y = rng.random((12, 30)), rng.choice([-1.0, 1.0], 30)
    sites = spark.createDataFrame([(s, t, str(states[s, t])) for s in range(12) for t in range(30)], "site int, taxon int, state string")
    al = spark.createDataFrame([(s, t, float(alpha[s, t])) for s in range(12) for t in range(30)], "site int, taxon int, alpha double")
    trait = spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "taxon int, y double")
    a = asn.leaf_attributions(sites, al, F.col("state").isin("A", "C"))
    m = np.zeros((12, 30))
    for s in range(12):
        top = max("AC", key=lambda b: ((states[s] == b).sum(), -ord(b)))
        m[s] = np.where((states[s] != top) & (states[s] != "-"), alpha[s], 0)
    for r in asn.trait_association(a, trait).collect():
        v = m[r["site"]]
        rho = v @ y / (np.linalg.norm(v) * np.linalg.norm(y)) if v.any() else 0.0
        assert r["rho"] == pytest.approx(rho, abs=1e-9)
        assert 0 <= r["p"] <= 1
    e = asn.spectral_energy(a, trait).first()
    assert e["energy"] == pytest.approx(np.linalg.norm(m @ y / np.linalg.norm(y)))
    assert asn.trait_association(a.limit(0), trait).count() == 0


def test_mutation_effects_edges(spark):
    counts = spark.createDataFrame([(1, "A", 90), (1, "C", 10)], "site int, state string, n long")
    v = spark.createDataFrame([(1, "A", "C"), (1, "A", "G"), (2, "A", "C"), (1, "C", "A")], "site int, wt string, mut string")
    xi = spark.createDataFrame([(1, 0.5), (2, None)], "site int, xi double")
    got = {(r["site"], r["wt"], r["mut"]): r for r in asn.mutation_effects(counts, v, xi, dict.fromkeys("ACGT", 0.25)).collect()}
    assert got[2, "A", "C"]["prediction"] == "Unmapped" and got[2, "A", "C"]["score"] == 0.5
    assert got[1, "C", "A"]["prediction"] == "Benign" and got[1, "C", "A"]["log_odds"] == pytest.approx(np.log(95 / 15))
    assert got[1, "A", "G"]["score"] > got[1, "A", "C"]["score"]


def test_resampling_is_the_same_in_any_order(spark):
    rows = [(i, i % 7) for i in range(200)]
    a, b = (spark.createDataFrame(x, "k long, s int").repartition(n) for x, n in ((rows, 2), (rows[::-1], 5)))
    for f in (lambda d: rs.shuffled(d, "k", "s", 3), lambda d: rs.subsets(d, "k", 5, 4), lambda d: rs.bootstrap_counts(d, "k", 3), lambda d: rs.stratified(d, "s", "k", 40), lambda d: rs.strided(d, "k", 30)):
        x, y = ({tuple(r) for r in f(d).collect()} for d in (a, b))
        assert x == y and x
        assert f(a.limit(0)).count() == 0
    counts = rs.bootstrap_counts(a, "k", 3).groupBy("rep").agg(F.sum("copies").alias("n")).collect()
    assert {r["n"] for r in counts} == {200}
    kept = rs.shuffled(a, "k", "s", 3)
    assert {(r["rep"], r["s"], r["n"]) for r in kept.groupBy("rep", "s").agg(F.count("*").alias("n")).collect()} == {(rep, s, sum(v == s for _, v in rows)) for rep in (1, 2, 3) for s in range(7)}
    assert rs.strided(a, "k", 30).count() == 29


def test_taxa_match_in_stages(spark):
    rec = spark.createDataFrame([("'Aa'",), ("bb",), ("CC",), (None,)], "name string")
    tips = lambda *x: spark.createDataFrame([(t,) for t in x], "tip string")
    run = lambda t: {(r["taxon"], r["key"], r["stage"]) for r in mt.match_taxa(t, "tip", rec, "name").collect()}
    assert run(tips("bb", "aa", "Aa", "cc")) == {("bb", "bb", "exact")}
    assert run(tips("Aa", "cc", None)) == {("Aa", "'Aa'", "unquoted")}
    assert run(tips("aa", "'cc'")) == {("aa", "'Aa'", "any case"), ("'cc'", "CC", "any case")}
    assert run(tips("zz")) == set()


def test_upsert(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k int, l int, v string")
    new = spark.createDataFrame([(1, None, "c"), (3, 1, "d")], "k int, l int, v string")
    assert {tuple(r) for r in mt.upserted(old, new, ["k", "l"]).collect()} == {(1, None, "c"), (2, 5, "b"), (3, 1, "d")}


def force(spark, lanes):
    return spark.createDataFrame([(t, c, s, float(v)) for (t, c), x in lanes.items() for s, v in enumerate(x)], "taxon int, channel int, site int, force double")


def test_screen_finds_planted_kinds(spark):
    rng = np.random.default_rng(4)
    noise = lambda: rng.normal(0, 0.05, 400)
    lanes = {(t, c): noise() for t in range(24) for c in range(4)}
    crossed = noise()
    crossed[150:230] += 1.0
    lanes[3, 2] = crossed - crossed.mean()
    lanes[7, 0] = rng.normal(0, 0.05, 400) + 0.5 * np.where(np.arange(400) % 40 < 20, 1, -1)
    lanes[7, 0] += 0.4
    stats = rc.channel_statistics(force(spark, lanes), "taxon", "channel", "site", "force")
    alone = spark.createDataFrame([(t, t == 7) for t in range(24)], "taxon int, isolated boolean")
    got = {r["taxon"]: r["verdict"] for r in rc.screen_taxa(stats, "taxon", "channel", 0, alone).collect()}
    assert got[3] == "candidate" and got[7] == "rate burst"
    # the first pass is meant to be sensitive: two deviations over the quiet half let a few random walks through
    assert sum(v == "backbone" for k, v in got.items() if k not in (3, 7)) > 11
    assert "rate burst" not in {v for k, v in got.items() if k != 7}


def test_matched_windows_against_a_loop(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 120)
    x[30:50] += 3
    x[80:100] += 2.5
    got = rc.matched_windows(force(spark, {(1, 1): x}), ["taxon", "channel"], "site", "force", (10, 20), 1.0, lanes=1).collect()
    for tau in (10, 20):
        mine = sorted((r["first"], r["last"], r["total"]) for r in got if r["scale"] == tau)
        sums = sorted(((x[k : k + tau].sum(), k) for k in range(121 - tau)), key=lambda v: (-v[0], v[1]))
        from statistics import NormalDist

        least = NormalDist().inv_cdf(1 - 0.05 / (2 * 2 * (120 / tau))) * tau**0.5
        kept = []
        for s, k in sums:
            if s >= least and all(k + tau - 1 < a or k > a + tau - 1 for a, _ in kept):
                kept.append((k, s))
        assert [m[:2] for m in mine] == sorted((k, k + tau - 1) for k, _ in kept)
        assert kept


def test_modularity_cut_against_all_cuts():
    rng = np.random.default_rng(2)
    w = rng.random((14, 14)) * 0.1
    w[:6, :6] += 1
    w[6:, 6:] += 1
    w = (w + w.T) / 2
    order = np.arange(14)
    k, q = kn.modularity_cut(w, order, 2)

    def modularity(k):
        m = w.sum()
        return sum((w[np.ix_(s, s)].sum() - w[s].sum() ** 2 / m) / m for s in (order[:k], order[k:]))

    assert k == 6 and q == pytest.approx(max(modularity(j) for j in range(2, 13)))
    assert kn.modularity_cut(w, order, 8) == (0, 0.0)


def test_deconvolution_splits_two_clocks(spark):
    rnd = random.Random(5)
    flip = lambda s, n: "".join(rnd.choice("ACGT".replace(c, "")) if i in n else c for i, c in enumerate(s))
    rows = []
    for g, rate in (("x", 0.002), ("y", 0.008)):
        root = "".join(rnd.choice("ACGT") for _ in range(1500))
        for k in range(20):
            t = 2000 + k * 0.7
            rows.append((len(rows), t, flip(root, set(rnd.sample(range(1500), round(1500 * rate * (t - 2000))))), g))
    df = spark.createDataFrame(rows, "taxon int, date double, seq string, truth string").withColumn("one", F.lit("all"))
    got = {r["taxon"]: (r["path"], r["why"]) for r in dg.deconvolve(df, "one", dg.SplitRules(min_gain=2.0)).collect()}
    assert len(got) == 40
    parts = {g: {got[t][0].split("/")[1] for t, _, _, h in rows if h == g and "/" in got[t][0]} for g in "xy"}
    assert len(parts["x"]) == len(parts["y"]) == 1 and parts["x"] != parts["y"]
    few = dg.deconvolve(df.limit(5), "one").collect()
    assert {r["why"] for r in few} == {"min_leaf"} and dg.deconvolve(df.limit(0), "one").count() == 0


def test_domains_and_columns(spark):
    pos = spark.createDataFrame([(p,) for p in (1, 50, 150, 151, 900, None)], "p int")
    dom = spark.createDataFrame([("a", 1, 150), ("b", 40, 60), ("c", 151, 151)], "name string, first int, last int")
    assert {(r["p"], r["domain"]) for r in asn.domain_of(pos, "p", dom).collect()} == {(1, "a"), (50, "a"), (150, "a"), (151, "c"), (900, "outside"), (None, "outside")}


def test_predictions_are_checked(spark, tmp_path):
    def read(text):
        p = tmp_path / f"{abs(hash(text))}.csv"
        p.write_text(text)
        return reports.read_predictions(spark, str(p)).collect()

    good = "site,lrt,p_value,is_invariable,other\n1,0.5,0.25,False,x\n2,0,1,true,y\n"
    assert sorted((r["site"], r["lrt"], r["is_invariable"]) for r in read(good)) == [(1, 0.5, False), (2, 0.0, True)]
    with pytest.raises(ValueError, match="missing columns: p_value"):
        read("site,lrt,is_invariable\n1,1,true\n")
    for bad in ("1,-1,0.5,true", "1,nan,0.5,true", "1,1,1.5,true", "1,1,0.5,maybe", "0,1,0.5,true", "x,1,0.5,true"):
        with pytest.raises(Exception, match="site"):
            read(f"site,lrt,p_value,is_invariable\n{bad}\n")
    with pytest.raises(Exception, match="duplicate"):
        read("site,lrt,p_value,is_invariable\n1,1,0.5,true\n1,2,0.5,true\n")


def test_gene_files_are_paired(spark, tmp_path):
    for side, names in (("p", ("g1.csv", "g2.csv", "note.txt")), ("m", ("g1.MEME.json", "g3.MEME.json"))):
        (tmp_path / side).mkdir()
        for n in names:
            (tmp_path / side / n).write_text("x")
    at = str(tmp_path / "p"), str(tmp_path / "m")
    with pytest.raises(ValueError, match="2 genes"):
        reports.pair_gene_files(spark, *at)
    got = {r["gene"]: (r["left"] is not None, r["right"] is not None) for r in reports.pair_gene_files(spark, *at, allow_unmatched=True).collect()}
    assert got == {"g1": (True, True), "g2": (True, False), "g3": (False, True)}


def test_reports_are_written(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 0.0123456789, None)], "id1 string, id2 string, distance double, q_value double")
    reports.write_transmission(str(tmp_path / "r"), edges=edges)
    back = spark.read.csv(str(tmp_path / "r/edges"), header=True).first()
    assert tuple(back) == ("a", "b", "0.012346", None, None, None)
    reports.write_json(edges, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"id1": "a", "id2": "b", "distance": 0.0123456789, "q_value": None}
