import random

from cladeflow.operators.graphs import components, spectral_bisection


def test_large_components_are_split_like_small_ones(spark):
    """Two components of two dense halves each: the same paths whether the dense kernel or the edge table splits them."""
    rnd = random.Random(2)
    rows = []
    for base in (0, 100):
        for part in (0, 20):
            rows += [(base + part + a, base + part + b, 0.5 + rnd.random()) for a in range(15) for b in range(a) if rnd.random() < 0.7 or b == a - 1]
        rows += [(base + k, base + 20 + k, 0.1) for k in range(3)]
    df = spark.createDataFrame(rows, "i long, j long, w double")
    label = components(df)
    paths = lambda most: {r["node"]: r["path"] for r in spectral_bisection(df, label, "w", max_depth=1, max_nodes=most).collect()}
    small, large = paths(4096), paths(10)
    assert large == small
    assert len(set(large.values())) == 4
    assert all(p.startswith("0:" if n < 100 else "100:") for n, p in large.items())
