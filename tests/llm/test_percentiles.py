import math
import random

import numpy as np
import pytest

from cladeflow.llm.percentiles import merge_counts, percentiles, value_counts

QS = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def rows():
    rnd = random.Random(1)
    out = [(1, rnd.choice([0.0, 0.0, rnd.lognormvariate(0, 3)]), i % 5) for i in range(3000)]
    out += [(g, round(rnd.random(), 1), i % 5) for i, g in enumerate(rnd.randrange(2, 40) for _ in range(500))]
    return out


def frame(spark, r):
    return spark.createDataFrame(r, "g int, x double, val int")


@pytest.mark.parametrize("parts", [1, 7])
def test_exact(spark, parts):
    data = rows() + [(None, 1.0, 0), (1, None, 0), (1, float("nan"), 0)]
    got = percentiles(value_counts(frame(spark, data), "g", "x"), QS, parts).collect()
    by = {}
    for g, x, _ in data:
        if g is not None and x is not None and x == x:
            by.setdefault(g, []).append(x)
    assert len(got) == len(by) * len(QS)
    for r in got:
        v = sorted(by[r["grp"]])
        assert r["n"] == len(v)
        assert r["lower_value"] == v[max(1, math.ceil(r["q"] * len(v) - 1e-9)) - 1]
        assert r["value"] == pytest.approx(np.quantile(v, r["q"]), rel=1e-12, abs=1e-12)


def test_days_combine(spark):
    df = frame(spark, rows())
    days = None
    for k in range(5):
        c = value_counts(df.where(f"val = {k}"), "g", "x")
        days = c if days is None else days.unionByName(c)
    key = lambda r: (r["grp"], r["q"])
    assert sorted(percentiles(merge_counts(days), QS).collect(), key=key) == sorted(percentiles(value_counts(df, "g", "x"), QS).collect(), key=key)


def test_bounded_error(spark):
    df = frame(spark, [(1, -(i + 1) / 7, 0) for i in range(500)] + [(1, (i + 1) * 1e5, 0) for i in range(500)] + [(1, 0.0, 0)])
    exact = {r["q"]: r["lower_value"] for r in percentiles(value_counts(df, "g", "x"), QS).collect()}
    near = percentiles(value_counts(df, "g", "x", 0.02), QS).collect()
    assert all(abs(r["lower_value"] - exact[r["q"]]) <= 0.0201 * abs(exact[r["q"]]) for r in near)
    assert value_counts(df, "g", "x", 0.02).count() < 450


def test_infinities_and_empty(spark):
    inf = float("inf")
    df = frame(spark, [(1, inf, 0), (1, inf, 0), (1, -inf, 0), (2, 5.0, 0)])
    got = {(r["grp"], r["q"]): r["lower_value"] for r in percentiles(value_counts(df, "g", "x"), [0.0, 0.5, 1.0]).collect()}
    assert got == {(1, 0.0): -inf, (1, 0.5): inf, (1, 1.0): inf, (2, 0.0): 5.0, (2, 0.5): 5.0, (2, 1.0): 5.0}
    assert percentiles(value_counts(df.limit(0), "g", "x"), QS).count() == 0
