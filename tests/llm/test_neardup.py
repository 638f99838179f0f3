import random

import numpy as np
import pyarrow as pa

from cladeflow.llm import neardup as nd


def grams(s):
    s = (s or "").replace("-", "").upper()
    return {s[i : i + 16] for i in range(len(s) - 15) if set(s[i : i + 16]) <= set("ACGT")}


def mutate(rnd, s, rate):
    out = []
    for c in s:
        x = rnd.random()
        if x < rate:
            out.append(rnd.choice("ACGT"))
        elif x < 1.3 * rate:
            out.append(c + rnd.choice("ACGT"))
        elif x > 1 - 0.3 * rate:
            pass
        else:
            out.append(c)
    return "".join(out)


def test_against_brute_force(spark):
    rnd = random.Random(11)
    seqs = [None, "", "ACGT", "-" * 40, "N" * 50, "acgt" * 4, "ACGTACGTACGTACGT"]
    for _ in range(12):
        base = "".join(rnd.choice("ACGT") for _ in range(rnd.choice([60, 300, 900])))
        seqs += [base, base.lower(), base[:20] + "--" + base[20:], base]
        seqs += [mutate(rnd, base, r) for r in (0.002, 0.005, 0.01, 0.015, 0.02, 0.05)]
        seqs += [base[: len(base) // 2] + "N" + base[len(base) // 2 :], base[len(base) // 3 :] + base[: len(base) // 3]]
    long = "".join(rnd.choice("ACGT") for _ in range(60_000))
    seqs += [long, mutate(rnd, long, 0.01)]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(seqs)], "rid long, seq string, id string")
    got = {(r["row_a"], r["row_b"]): r["similarity"] for r in nd.near_duplicates(df, "rid", "seq").collect()}
    sets = [grams(s) for s in seqs]
    want = {}
    for i in range(len(seqs)):
        for j in range(i + 1, len(seqs)):
            if sets[i] and sets[j]:
                sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if sim >= 0.5:
                    want[i, j] = sim
    assert set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert len(got) >= 0.999 * len(want)
    assert {k for k, v in want.items() if v == 1} <= set(got)
    exact = {(r["row_a"], r["row_b"]): r["similarity"] for r in nd.near_duplicates(df, "rid", "seq", exact=True).collect()}
    assert exact == want
    near = {k for k, v in want.items() if v >= 0.9}
    assert {(r["row_a"], r["row_b"]) for r in nd.near_duplicates(df, "rid", "seq", least=0.9, exact=True).collect()} == near


def test_hot_keys_are_paired_in_cells(spark):
    held = [(7, i) for i in range(23)] + [(8, i) for i in range(0, 40, 10)] + [(9, 50), (9, 51), (10, 50)] + [(11, i) for i in range(40, 46)]
    keys = spark.createDataFrame(held, "key long, id long")
    got = {tuple(r) for r in nd.candidates(keys, 1, rare=2, hot=5).collect()}
    want = {(i, j) for i in range(23) for j in range(i + 1, 23)} | {(i, j) for i in range(0, 40, 10) for j in range(i + 10, 40, 10)} | {(50, 51)} | {(i, j) for i in range(40, 46) for j in range(i + 1, 46)}
    assert got == want
    # a pair counts from a rare key alone or from two common ones
    assert {tuple(r) for r in nd.candidates(keys, 2, rare=2, hot=5).collect()} == {(0, 10), (0, 20), (10, 20), (50, 51)}


def test_pairs_leave_a_task_once_and_are_shuffled_once(spark):
    """A pair that shares several keys is summed before the shuffle, and its sum lies where row_a's body does."""
    key = np.repeat(np.arange(6), 4)
    ids = np.tile([5, 3, 9, 3], 6)
    b = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])
    got = [tuple(r.values()) for x in nd._pairer(16, 2048)(iter([b, b[:0]])) for r in x.to_pylist()]
    assert got == [(3, 5, 24), (3, 9, 24), (5, 9, 12)]
    keys = spark.createDataFrame(list(zip(key.tolist(), ids.tolist(), strict=True)), "key long, id long")
    pairs = nd.candidates(keys, 2)
    join = pairs.join(spark.range(10).withColumnRenamed("id", "row_a").repartition("row_a").hint("merge"), "row_a")
    plan = join._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row_a") == 2
    assert sorted(tuple(r) for r in join.collect()) == [(3, 5), (3, 9), (5, 9)]


def test_kmers_and_packing_round_trip():
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGTacgtN-RY") for _ in range(rnd.randrange(0, 200))) for _ in range(60)] + ["", "A" * 40]
    codes, lengths = nd._letters(pa.array([*seqs, None]))
    assert lengths.tolist() == [len(s.replace("-", "")) for s in seqs] + [0]
    odd = np.arange(len(lengths) * 4, dtype=np.uint64).reshape(-1, 4)
    bodies = nd._pack(odd, codes, lengths)
    assert (nd._odd_of(bodies) == odd).all()
    again = nd._unpack(bodies)
    assert [len(x) for x in nd._unpack(bodies[:0])] == [0, 0]
    assert (nd._unpack(bodies[5:9])[1] == lengths[5:9]).all()
    assert (again[0] == codes).all()
    assert (again[1] == lengths).all()
    kmers, row = nd._kmers(codes, lengths)
    text = lambda k: "".join("ACGT"[(int(k) >> 2 * (15 - i)) & 3] for i in range(16))
    for i, s in enumerate(seqs):
        assert {text(k) for k in kmers[row == i]} == grams(s)


def test_odd_sketch_estimates_similarity():
    rnd = np.random.default_rng(4)
    for share in (0.5, 0.7, 0.9):
        est = []
        for _ in range(40):
            a = rnd.integers(0, 2**32, 1000, dtype=np.uint32)
            b = a.copy()
            k = int(1000 * (1 - share) / (1 + share))
            b[:k] = rnd.integers(0, 2**32, k, dtype=np.uint32)
            row = np.zeros(1000, np.int32)
            x, y = (nd._odd(nd._minhash(v, row, 1)) for v in (a, b))
            est.append(nd.odd_similarity(np.bitwise_count(x ^ y).sum()))
        assert abs(np.mean(est) - share) < 0.04


def test_classes_and_empty(spark):
    base = "".join(random.Random(1).choices("ACGT", k=200))
    df = spark.createDataFrame([(1, base), (2, base), (3, base + "ACGTAC"), (4, "ACGT"), (5, None), (6, "ACGT"), (7, "NN"), (None, base)], "rid long, seq string")
    got = {(r["row_id"], r["class_id"], r["links"]) for r in nd.same_record_classes(df, "rid", "seq").collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0)}
    assert nd.near_duplicates(df.limit(0), "rid", "seq").count() == 0
    assert nd.same_record_classes(df.limit(0), "rid", "seq").count() == 0


def test_a_sequence_delivered_for_a_third_of_all_records(spark):
    rnd = random.Random(8)
    hot = "".join(rnd.choices("ACGT", k=120))
    rows = [(i, hot if i % 3 == 0 else "".join(rnd.choices("ACGT", k=120))) for i in range(3000)]
    got = {r["row_id"]: (r["class_id"], r["links"]) for r in nd.same_record_classes(spark.createDataFrame(rows, "rid long, seq string"), "rid", "seq").collect()}
    assert all(got[i] == ((0, 999) if i % 3 == 0 else (i, 0)) for i in range(3000))
