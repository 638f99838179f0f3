import random

from cladeflow.llm.components import linked_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id1 string, id2 string, bayes_factor double, group_id string")


def run(df):
    got = [(r["record_id"], r["group_id"]) for r in linked_groups(df).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_chain_hub_and_random(spark):
    rnd = random.Random(3)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)] + [("hub", f"h{i}") for i in range(500)]
    pairs += [(f"r{rnd.randrange(400)}", f"r{rnd.randrange(400)}") for _ in range(250)]
    rnd.shuffle(pairs)
    rows = [(a, b, 5.0, "x") if rnd.random() < 0.5 else (b, a, float("inf"), None) for a, b in pairs] + [(a, b, 4.0, None) for a, b in pairs[:50]]
    assert run(frame(spark, rows)) == brute([p for p in pairs if p[0] != p[1]])


def test_rows_that_do_not_count(spark):
    rows = [("a", "b", 2.99, None), ("a", "b", None, None), ("a", "c", float("nan"), None), (None, "b", 9.0, None), ("d", None, 9.0, None), ("e", "e", 9.0, None), ("B", "a", 3.0, None), ("a", "é", 3.0, None), ("", "z", 3.0, None)]
    assert run(frame(spark, rows)) == {"B": "B", "a": "B", "é": "B", "": "", "z": ""}


def test_empty(spark):
    assert run(frame(spark, [])) == {}
