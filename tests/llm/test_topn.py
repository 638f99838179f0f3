import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm.topn import LoserTree, latest, top_n


@given(st.lists(st.lists(st.integers(0, 50), max_size=20), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    head = lambda r: (runs[r][at[r]], r) if at[r] < len(runs[r]) else None
    tree = LoserTree([head(r) for r in range(len(runs))] or [None])
    out = []
    while tree.heads[tree.winner()] is not None:
        w = tree.winner()
        out.append(tree.heads[w][0])
        at[w] += 1
        tree.replace(head(w))
    assert out == sorted(x for r in runs for x in r)


def brute(rows, n):
    out = {}
    for g, s, p, i in rows:
        if g is None or i is None or s is None or s != s:
            continue
        none = p is None or p != p
        out.setdefault(g, []).append((-s, none, 0 if none else p, i))
    return {(g, k + 1, x[3]) for g, v in out.items() for k, x in enumerate(sorted(v)[:n])}


def test_against_brute_force(spark):
    rnd = random.Random(9)
    pick = lambda: rnd.choice([0.0, 1.0, 2.0, rnd.random(), float("nan"), None, float("inf")])
    rows = [(rnd.choice([7, 7, 7, rnd.randrange(-30, 200), None]), pick(), rnd.choice([None, 0.1, 0.2, float("nan")]), i) for i in range(4000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "g int, s double, p double, i int, tie string").repartition(6)
    for kw in ({}, {"run_rows": 100, "fan_in": 3, "buckets": 2}):
        got = {(r["grp"], r["rank"], r["item"]) for r in top_n(df, "g", "s", "p", "i", 5, **kw).collect()}
        assert got == brute(rows, 5)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, 2.0, None, 3), (1, 2.0, None, 3)], "g int, s double, p double, i int")
    assert [(r["rank"], r["item"]) for r in top_n(df, "g", "s", "p", "i", 1).collect()] == [(1, 3)]
    assert top_n(df.limit(0), "g", "s", "p", "i").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", None), (2, None, 1.0), (2, "2023-01-01", 0.5), (3, "2024-01-01", 1.0), (3, "2024-01-01", 1.0)], "k int, t string, v double")
    assert {(r["k"], r["v"]) for r in latest(df, ["k"], "t", ["v"]).collect()} == {(1, None), (2, 0.5), (3, 1.0)}


def test_runs_are_cut_into_more_buckets(spark):
    rows = [(g, float((g * 7 + i * 13) % 50), float(i % 3), i) for g in range(300) for i in range(8)]
    df = spark.createDataFrame(rows, "g long, s double, t double, i long")
    few = {tuple(r) for r in top_n(df, "g", "s", "t", "i", 3, buckets=2).collect()}
    many = {tuple(r) for r in top_n(df, "g", "s", "t", "i", 3, buckets=2, bucket_rows=50).collect()}
    assert few == many and len(few) == 900
