import math

import numpy as np
import pandas as pd
import pytest

from cladeflow.functions import special as sp
from cladeflow.operators import kernels as kn
from cladeflow.operators.distances import KERNELS, code_matrix, meeting_counts, resolved_counts
from cladeflow.operators.graphs import components, degrees, spectral_bisection
from cladeflow.operators.sites import codon_threads
from cladeflow.operators.transmission import PairModel, bayes_factors, growth_rate
from cladeflow.operators.trees import closure, depths, fitch, node_levels, parse_newick, root_states, shared_depth, transition_counts


def test_special_functions():
    for k, m in ((0, 0.5), (3, 2.0), (20, 31.0), (2, 60.0)):
        want = sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k + 1))
        assert sp.poisson_cdf(np.array([k + 0.7]), np.array([m]))[0] == pytest.approx(want, rel=1e-10)
    assert sp.t_quantile(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-9)
    assert sp.t_quantile(0.975, 1) == pytest.approx(12.706204736174698, rel=1e-9)
    assert sp.t_two_sided(0.0, 7) == pytest.approx(1.0)
    assert sp.normal_cdf(np.array([1.959963984540054]))[0] == pytest.approx(0.975, rel=1e-9)
    assert sp.lrt_mixture_p(np.array([0.0, np.nan, -1.0])).tolist() == [2 / 3] * 3
    assert sp.lrt_boundary_p(np.array([0.0, np.nan])).tolist() == [1.0, 1.0]
    assert sp.lrt_boundary_p(np.array([3.841458820694124]))[0] == pytest.approx(0.025, rel=1e-6)
    nb = np.exp(sp.log_negative_binomial(np.arange(400), 3.0, 0.6))
    assert nb.sum() == pytest.approx(1)


def test_distance_kernels_by_hand():
    a, b = "ACGTACGTAC" * 6, "ACGTACGTAT" * 6
    m = meeting_counts(code_matrix([a]), code_matrix([b]))
    assert KERNELS["hamming"](m)[0, 0] == pytest.approx(0.1)
    f = {"A": 36 / 120, "C": 30 / 120, "G": 24 / 120, "T": 30 / 120}
    r, y = f["A"] + f["G"], f["C"] + f["T"]
    k1, k2 = 2 * f["A"] * f["G"] / r, 2 * f["T"] * f["C"] / y
    k3 = 2 * (r * y - f["A"] * f["G"] * y / r - f["C"] * f["T"] * r / y)
    want = -k1 * math.log(1) - k2 * math.log(1 - 0.1 / k2) - k3 * math.log(1)
    for name in ("tn93", "tn93_masks", "tn93_screen"):
        assert KERNELS[name](m)[0, 0] == pytest.approx(want)
    short = meeting_counts(code_matrix(["ACGT"]), code_matrix(["ACGA"]))
    assert np.isnan(KERNELS["tn93_screen"](short)[0, 0])
    none = meeting_counts(code_matrix(["--NN"]), code_matrix(["ACGT"]))
    assert np.isnan(KERNELS["tn93_masks"](none)[0, 0])


def test_ambiguity_modes():
    m = meeting_counts(code_matrix(["R"]), code_matrix(["A"]))
    get = lambda mode: resolved_counts(m, mode)[:, :, 0, 0]
    assert get("resolve")[0, 0] == 1
    assert get("average")[0, 0] == get("average")[2, 0] == 0.5
    assert get("skip").sum() == 0
    both = meeting_counts(code_matrix(["R"]), code_matrix(["M"]))
    assert resolved_counts(both, "resolve")[0, 0, 0, 0] == 1
    gap = meeting_counts(code_matrix(["-"]), code_matrix(["C"]))
    assert resolved_counts(gap, "resolve").sum() == 0
    assert resolved_counts(gap, "gapmm")[1, 1, 0, 0] == 1


def test_mds_recovers_a_plane():
    x = np.random.default_rng(1).normal(size=(20, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    y, vals = kn.classical_mds(d, 4)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1)), d)
    assert abs(vals[2]) < 1e-9
    assert kn.metricity(d)["negative"] < 1e-9


def test_trees_from_additive_distances():
    text = "((a:1,b:2):1.5,(c:0.5,d:3):2);"
    nodes = parse_newick(text)
    up = {v: (p, le or 0.0) for v, p, le, _ in nodes}
    tips = {n: v for v, _, _, n in nodes if n}

    def path(v):
        out = {}
        s = 0.0
        while v is not None:
            out[v] = s
            s += up[v][1]
            v = up[v][0]
        return out

    names = sorted(tips)
    d = np.array([[min(path(tips[a])[k] + path(tips[b])[k] for k in path(tips[a]) if k in path(tips[b])) for b in names] for a in names])
    tree = kn.neighbour_joining(d, names)
    again = parse_newick(kn.newick_text(tree))
    assert {n for *_, n in again if n} == set(names)
    rooted = kn.reroot_midpoint(tree)
    depth = kn.root_to_tip(rooted)
    assert max(depth.values()) == pytest.approx(d.max() / 2)
    assert sum(x[2] for x in rooted) == pytest.approx(sum(x[2] for x in tree))


def test_newick_oddities():
    assert [x[3] for x in parse_newick("('a b':1,[note]b{1}:2e-1)root;") if x[3]] == ["root", "a b", "b"]
    assert parse_newick("") == []
    assert len(parse_newick("(,);")) == 3


def test_tree_plans(spark):
    nodes = spark.createDataFrame([(v, p, le) for v, p, le, _ in parse_newick("((a:1,b:2):1.5,(c:0.5,d:3):2);")], "node long, parent long, length double")
    c = closure(nodes)
    dep = {r["node"]: r["depth"] for r in depths(nodes, c).collect()}
    assert dep == {0: 0.0, 1: 1.5, 2: 2.5, 3: 3.5, 4: 2.0, 5: 2.5, 6: 5.0}
    pairs = spark.createDataFrame([(2, 3), (2, 6)], "i long, j long")
    got = {(r["i"], r["j"]): (r["shared"], r["distance"]) for r in shared_depth(pairs, c, depths(nodes, c)).collect()}
    assert got == {(2, 3): (1.5, 3.0), (2, 6): (0.0, 7.5)}


def test_clock_fits():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(2000, 2010, 60))
    y = 0.003 * (t - 1990) + rng.normal(0, 1e-4, 60)
    g = kn.generalised_line(t, y, np.eye(60))
    assert g["slope"] == pytest.approx(np.polyfit(t, y, 1)[0], rel=1e-6)
    assert kn.pagel_line(t, y, np.eye(60) + 0.5)["slope"] == pytest.approx(0.003, rel=0.05)
    c = kn.community_clock(t, y, np.full((60, 60), 1.0) * (1 - np.eye(60)))
    assert c["rate"] == pytest.approx(0.003, rel=0.02)
    assert c["low"] < 1990 < c["high"]
    assert (c["state"], c["tier"]) == ("OK", kn.STATIONARY)
    low, high = kn.wild_bootstrap(t, y)
    assert low < 1990.2
    assert high > 1989.8
    bent = np.where(t < 2005, 0.001 * (t - 2000), 0.005 + 0.01 * (t - 2005))
    assert kn.broken_line(t, bent)["at"] == pytest.approx(2005, abs=0.5)
    assert kn.restricted_spline(t, bent)["f"] > 50
    curve = (t - 1999) ** 1.7
    assert kn.power_line(t, curve)["rss"] < 1e-3 * ((curve - curve.mean()) ** 2).sum()


def test_clusters_and_picks():
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.05, (15, 2)), rng.normal(3, 0.05, (15, 2))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    label, k = kn.spectral_clusters(np.exp(-(d**2)))
    assert k == 2
    assert len(set(label[:15])) == len(set(label[15:])) == 1
    assert {p // 15 for p in kn.farthest_points(d, 2)} == {0, 1}
    assert kn.leader_bins(np.exp(-d), 0.5).tolist() == [0] * 15 + [1] * 15
    near = kn.nystrom_embedding(np.exp(-(d[:, ::3] ** 2)), np.exp(-(d[::3, ::3] ** 2)), 2)
    again = kn.kmeans(near / np.linalg.norm(near, axis=1, keepdims=True), 2)[0]
    assert len(set(again[:15])) == len(set(again[15:])) == 1 != len(set(again))


def test_segments():
    x = np.r_[np.zeros(30), np.ones(20), np.zeros(30)]
    assert [(a, b) for a, b, _ in kn.binary_segments(x, 2.0)] == [(0, 29), (30, 49), (50, 79)]


def test_alignment_against_plain_recursion():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n, m = rng.integers(1, 9, 2)
        s = rng.integers(-3, 5, (n, m)).astype(float)
        pairs = kn.affine_align(s, -2.0, -2.0)
        # with equal open and extension costs the best score is the linear-gap one
        best = np.zeros((n + 1, m + 1))
        best[1:, 0] = -2.0 * np.arange(1, n + 1)
        best[0, 1:] = -2.0 * np.arange(1, m + 1)
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i, j] = max(best[i - 1, j - 1] + s[i - 1, j - 1], best[i - 1, j] - 2, best[i, j - 1] - 2)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        got = sum(s[i, j] for i, j in pairs) - 2.0 * (n + m - 2 * len(pairs))
        assert got == pytest.approx(best[n, m])


def test_many_alignments_score_as_single_ones():
    rng = np.random.default_rng(15)
    target = rng.integers(0, 4, 17)
    queries = [rng.integers(0, 4, n) for n in (0, 1, 5, 17, 30, 12)] + [target, target[:6], np.r_[target[:4], target[9:]], np.r_[target[:8], rng.integers(0, 4, 7), target[8:]]]
    score, paths = kn.affine_align_many(queries, target, 2.0, -1.0, -4.0, -1.0, paths=True)

    def worth(q, pairs):
        gap = lambda n: -4.0 - (n - 1) if n else 0.0
        edges = [(-1, -1), *pairs, (len(q), len(target))]
        return sum(2.0 if q[i] == target[j] else -1.0 for i, j in pairs) + sum(gap(c - a - 1) + gap(d - b - 1) for (a, b), (c, d) in zip(edges, edges[1:], strict=False))

    for q, s, pairs in zip(queries, score, paths, strict=True):
        assert worth(q, pairs) == s
        one = kn.affine_align(np.where(q[:, None] == target[None, :], 2.0, -1.0), -4.0, -1.0)
        assert worth(q, one) == s


def test_community_states():
    rng = np.random.default_rng(9)
    apart = lambda n: 1.0 - np.eye(n)
    t = np.sort(rng.uniform(2015, 2020, 40))
    y = 0.004 * (t - 2014) + rng.normal(0, 1e-5, 40)
    clock = kn.community_clock
    assert (clock(t, y, apart(40))["state"], clock(t, y, apart(40))["tier"]) == ("OK", kn.ACTIVE)
    assert clock(t, y, apart(40))["high"] <= t.min() and clock(t, y, apart(40))["origin"] == pytest.approx(2014, abs=0.1)
    assert clock(t, y / 6, apart(40))["tier"] == kn.EMERGENT
    assert clock(t, -y, apart(40))["tier"] == kn.EXTINCT and clock(t, -y, apart(40))["origin"] == t.min()
    # noise alone: an unbounded set is never active
    for seed in range(200):
        r = np.random.default_rng(seed)
        c = clock(t, np.abs(r.normal(0.05, 0.05, 40)), apart(40))
        assert c["state"] == "OK" or c["tier"] in (kn.EXTINCT, kn.STATIONARY)
    assert any(clock(t, np.abs(np.random.default_rng(s).normal(0.05, 0.05, 40)), apart(40))["state"] == "RATE_UNIDENTIFIABLE_G_GE_1" for s in range(20))
    assert [clock(t[:n], y[:n], apart(n))["tier"] for n in (1, 2)] == [kn.SINGLE, kn.PAIR] and clock(t[:2], y[:2], apart(2))["state"] == "TOO_SMALL"
    flat = clock(np.full(5, 2000.0), y[:5], apart(5))
    assert (flat["state"], flat["tier"], flat["origin"]) == ("ZERO_TIME_VAR", kn.OPEN, 2000.0)
    assert clock(t, np.full(40, np.nan), apart(40))["state"] == "REGRESSION_FAILED"
    # a pair without a distance neither drives the line nor the effective size
    d = y.copy()
    d[7] = np.nan
    m = apart(40)
    m[7, :] = m[:, 7] = np.nan
    assert clock(t, d, m)["rate"] == pytest.approx(0.004, rel=0.01)


def test_epicentre_is_the_mean_of_independent_points():
    lat, lon = np.array([0.0, 2.0, 4.0]), np.array([1.0, 1.0, 4.0])
    a, o, r = kn.epicentre(lat, lon, np.eye(3))
    assert (a, o) == pytest.approx((2.0, 2.0))
    assert r == pytest.approx(math.sqrt((8 + 6) / (2 * 3 - 2) / 3) * 111.32 * math.sqrt(5.991))
    # two samples of one place weigh little more than one
    a, _, _ = kn.epicentre(np.array([0.0, 0.0, 3.0]), np.zeros(3), np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1.0]]))
    assert 1.3 < a < 1.55


def test_fitch_with_unknown_tips(spark):
    tree = [(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 6), (8, 6)]
    nodes = spark.createDataFrame(tree, "node long, parent long")
    tips = spark.createDataFrame([(3, 1), (4, None), (5, 2), (7, 0)], "node long, state int")
    got = {r["node"]: (r["state"], r["changed"]) for r in fitch(nodes, tips).collect()}
    # 4 and 8 may be anything: 1 has {1}, 6 has {0}, 2 has {0, 2}, the root {0, 1, 2}
    assert got == {0: (0, False), 1: (1, True), 2: (0, False), 3: (1, False), 4: (1, False), 5: (2, True), 6: (0, False), 7: (0, False), 8: (0, False)}
    assert {(r["state"], round(r["share"], 6)) for r in root_states(nodes, tips).collect()} == {(k, 0.333333) for k in range(3)}
    assert {tuple(r) for r in transition_counts(fitch(nodes, tips)).collect()} == {(0, 1, 1), (0, 2, 1)}
    assert fitch(nodes, tips.limit(0)).count() == 0 and root_states(nodes, tips.limit(0)).count() == 0
    chain = spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, 40))], "node long, parent long")
    assert {r["level"] for r in node_levels(chain).where("node = level").collect()} == set(range(40))


def test_codon_threads(spark):
    rng = np.random.default_rng(6)
    sense = [c for c in ("GCT", "TGG", "AAA", "CTG", "GAT", "TTC", "ATG", "CCC", "GGA", "CAT")]
    ref = "".join(rng.choice(sense, 80))
    rows = [(1, ref), (2, ref[::-1].translate(str.maketrans("ACGT", "TGCA"))), (3, "A" + ref), (4, ref[:90] + ref[120:]), (5, None), (6, "")]
    got = {r["key"]: r for r in codon_threads(spark.createDataFrame(rows, "k long, s string"), "k", "s", ref).collect()}
    assert got[1]["seq"] == got[2]["seq"] == got[3]["seq"] == ref
    assert (got[2]["strand"], got[3]["frame"]) == (-1, 1)
    assert got[4]["seq"] == ref[:90] + "-" * 30 + ref[120:]
    assert got[5]["strand"] is None and got[6]["seq"] is None
    short = codon_threads(spark.createDataFrame([(1, ref[:29]), (2, "ACGTTGCA" * 30), (3, ref + "TAA")], "k long, s string"), "k", "s", ref)
    assert {r["key"]: (r["seq"], r["stops"]) for r in short.collect()}[3] == (ref, 0)
    assert {r["key"]: r["seq"] for r in short.collect()}[1] is None and {r["key"]: r["score"] for r in short.collect()}[1] is None


def test_bayes_factor_prefers_near_pairs():
    m = PairModel()
    bf = bayes_factors(np.array([0.0, 1.0, 60.0]), np.array([0.1, 0.1, 0.1]), m)
    assert bf[0] > 1
    assert bf[0] > bf[1] > bf[2]
    assert bayes_factors(np.array([0.0]), np.array([15.0]), m)[0] == 0
    assert (bayes_factors(np.array([1.0]), np.array([0.2]), m, robust=True) <= bf[1] * 10).all()


def test_growth_rate(spark):
    f = pd.DataFrame([{"g": "a", "k": k, "tau1": i * 0.01, "tau2": (i + 1) * 0.01, "events": 1} for i, k in enumerate(range(60, 1, -1))])
    r = growth_rate(spark.createDataFrame(f), ["g"]).first()
    assert -25 < r["growth"] < 150
    tau2, pairs = f["tau2"], f["k"] * (f["k"] - 1) / 2

    def like(x):
        s = (pairs * (np.exp(x * f["tau2"]) - np.exp(x * f["tau1"])) / x).sum()
        return x * tau2.sum() - len(f) * math.log(s)

    assert like(r["growth"]) >= max(like(r["growth"] + e) for e in (-0.05, 0.05))


def test_components_and_bisection(spark):
    e = [(i, i + 1, 1.0) for i in range(40)] + [(100 + i, 100 + j, 1.0) for i in range(6) for j in range(i)] + [(200 + i, 200 + j, 1.0) for i in range(6) for j in range(i)] + [(100, 200, 0.01)]
    df = spark.createDataFrame(e, "i long, j long, w double")
    lab = components(df)
    got = {r["node"]: r["component"] for r in lab.collect()}
    assert set(got.values()) == {0, 100}
    assert got[40] == 0
    parts = {}
    for r in spectral_bisection(df.where("i >= 100"), components(df.where("i >= 100")), "w", max_conductance=0.3).collect():
        parts.setdefault(r["path"], set()).add(r["node"] // 100)
    assert sorted(map(sorted, parts.values())) == [[1], [2]]
    assert {r["node"]: r["degree"] for r in degrees(df).collect()}[100] == 6
    assert components(df.limit(0)).count() == 0


def test_best_root_and_node_dates():
    nodes = parse_newick("(((a:1,b:2):1,c:3):1,d:5);")
    nodes = [(v, p, le or 0.0, n) for v, p, le, n in nodes]
    when = {k: 2000 + v for k, v in kn.root_to_tip(nodes).items()}
    again, rate, rss = kn.best_root([x for x in kn.reroot_midpoint(nodes)], when)
    assert rate > 0
    at = kn.node_dates(nodes, when, 1.0)
    assert at[0] == pytest.approx(2000, abs=1e-3)
    assert all(at[p] <= at[v] for v, p, *_ in nodes if p is not None)


def test_modularity_groups():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    w[3, 4] = w[4, 3] = 0.2
    np.fill_diagonal(w, 0)
    assert kn.modularity_groups(w).tolist() == [0] * 4 + [1] * 4
    assert kn.modularity_groups(np.zeros((3, 3))).tolist() == [0, 1, 2]
