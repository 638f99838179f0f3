import math
import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from cladeflow.functions import kmers as km
from cladeflow.functions import sequences as sq
from cladeflow.plans.alignments import _six, canonical_kmers, kmer_sketch, sketch_distances


def test_kernels_agree_with_expressions(spark):
    rnd = random.Random(12)
    seqs = ["".join(rnd.choice("ACGTacgt-N") if rnd.random() < 0.1 else rnd.choice("ACGT") for _ in range(rnd.randrange(0, 300))) for _ in range(60)] + [None, "", "A" * 40, "ACGT" * 3_000]
    df = spark.createDataFrame(list(enumerate(seqs)), "k long, seq string").repartition(3)
    want = sq.kmer_rows(df, "seq", 15, "k").select("k", sq.kmer_hash(sq.canonical(F.col("kmer"))).alias("h")).groupBy("k").agg(F.array_sort(F.collect_set("h")).alias("h")).select("k", F.slice("h", 1, 50).alias("h"))
    got = df.mapInArrow(km.bottom_sketches(50), "k long, h array<long>")
    assert {(r["k"], tuple(r["h"])) for r in got.collect()} == {(r["k"], tuple(r["h"])) for r in want.collect()}
    counts = {r["code"]: r["n"] for r in df.select("seq").mapInArrow(km.kmer_counts(15), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    texts = {r["c"]: r["n"] for r in sq.kmer_rows(df, "seq", 15).groupBy(sq.canonical(F.col("kmer")).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert {km.text_of(c, 15): n for c, n in counts.items()} == texts


def test_canonical_kmers_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "row_ord long, seq string").write.parquet(f"{tmp_path}/fasta_record.parquet")
    assert canonical_kmers(spark, str(tmp_path)).count() == 0


def test_sketch_distances_against_brute_force(spark, tmp_path):
    """All pairs that share a hash, few shared ones included; sketches cut at 1024 hashes."""
    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(1600))
    other = "".join(rnd.choice("ACGT") for _ in range(700))
    mutated = "".join(rnd.choice("ACGT") if rnd.random() < 0.05 else c for c in base)
    seqs = [base, mutated, base[100:1500], base[:40] + other, other, base[:400] + other[:20], "ACGT", None]
    spark.createDataFrame(list(enumerate(seqs)), "row_ord long, seq string").write.parquet(f"{tmp_path}/fasta_record.parquet")
    flip = str.maketrans("ACGT", "TGCA")
    least = {}
    for n, x in enumerate(seqs):
        kmers = {x[i : i + 15] for i in range(len(x) - 14)} if x else set()
        least[n] = sorted({zlib.crc32(min(k, k.translate(flip)[::-1]).encode(), 0x12345678) for k in kmers})[:1024]
    assert max(map(len, least.values())) == 1024
    want = {}
    for a in least:
        for b in range(a + 1, len(seqs)):
            joint = sorted({*least[a], *least[b]})[: max(len(least[a]), len(least[b]))]
            if both := {*least[a]} & {*least[b]}:
                j = len(both & {*joint}) / len(joint)
                want[a, b] = (round(j, 6), round(max(0.0, -math.log(2 * j / (1 + j)) / 15), 6) if j else 1.0)
    got = {(r["a"], r["b"]): (r["jaccard"], r["distance"]) for r in sketch_distances(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 2e-6 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert any(j < 0.05 for j, _ in want.values())
    assert {r["row_ord"]: r["size"] for r in kmer_sketch(spark, str(tmp_path)).collect()} == {n: len(h) for n, h in least.items() if h}


def test_sketch_distances_shuffle_no_hashes(spark, tmp_path, monkeypatch):
    """Rows of (pair, shared hash) grow with the square of the records: blocks meet where their letters lie, and many
    small blocks and small lots give what one block gives."""
    rnd = random.Random(4)
    motif = "".join(rnd.choice("ACGT") for _ in range(40))
    seqs = [*("".join(rnd.choice("ACGT") for _ in range(60)) + motif[: rnd.randrange(10, 41)] for _ in range(60)), None, "", "ACGT", "-" * 30, motif]
    spark.createDataFrame([(7 * i % 1009, x) for i, x in enumerate(seqs)], "row_ord long, seq string").repartition(3).write.parquet(f"{tmp_path}/fasta_record.parquet")
    got = sketch_distances(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert "Exchange" not in plan
    rows = sorted(got.collect())
    assert len(rows) == len({r[:2] for r in rows}) > 500
    tb = pa.RecordBatch.from_arrays([pa.array([7 * i % 1009 for i in range(len(seqs))], pa.int64()), pa.array(seqs)], names=["key", "seq"])
    monkeypatch.setattr(km, "_HELD", 50)
    monkeypatch.setattr(km, "LOT_LETTERS", 300)
    blocks = [b.columns for b in km.record_blocks(500)(iter([tb]))]
    assert len(blocks) > 5
    met = [pa.RecordBatch.from_arrays([*x, *y], names=list("abcdef")) for i, x in enumerate(blocks) for y in blocks[i:]]
    small = [(r["a"], r["b"], r["inside"], r["whole"]) for b in km.sketch_pairs(1024)(iter(met)) for r in b.to_pylist()]
    assert sorted((a, b, (2_000_000 * n + m) // (2 * m) / 1e6) for a, b, n, m in small) == [(r["a"], r["b"], r["jaccard"]) for r in rows]


def test_sketch_pairs_of_one_similarity_stand_together(monkeypatch):
    """The result grows with the square of the records: a column file keeps runs of equal values once. The pairs of
    several blocks are ordered together, in lots that are bounded."""
    rnd = random.Random(5)
    motif = "".join(rnd.choice("ACGT") for _ in range(40))
    seqs = ["".join(rnd.choice("ACGT") for _ in range(60)) + motif[: rnd.randrange(18, 22)] for _ in range(80)]
    keys = rnd.sample(range(1000), len(seqs))
    monkeypatch.setattr(km, "LOT_LETTERS", 500)
    blocks = [b.columns for b in km.record_blocks(2_000)(iter([pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seqs)], names=["key", "seq"])]))]
    assert len(blocks) > 2
    met = [pa.RecordBatch.from_arrays([*x, *y], names=list("abcdef")) for i, x in enumerate(blocks) for y in blocks[i:]]
    (got,) = km.sketch_pairs(1024)(iter(met))
    rows = [tuple(r.values()) for r in got.to_pylist()]
    assert len({r[:2] for r in rows}) == len(rows) == 80 * 79 // 2
    assert all(a < b for a, b, _, _ in rows)
    kinds = [(n, m) if n else (0, 0) for _, _, n, m in rows]
    runs = 1 + sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    assert runs == len({*kinds}) < len(rows) / 20
    monkeypatch.setattr(km, "_HELD", 300)
    lots = list(km.sketch_pairs(1024)(iter(met)))
    assert len(lots) > 5
    assert {tuple(r.values()) for b in lots for r in b.to_pylist()} == {*rows}


def test_six_places_as_by_round(spark):
    x = spark.range(1, 2049, 37).select(F.col("id").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), "id")).alias("n")).select((F.col("n") / F.col("m")).alias("j"))
    x = x.select(F.explode(F.array("j", sq.mash_distance(F.col("j"), 15))).alias("x")).unionByName(spark.createDataFrame([(0.0640625,), (0.5046875,), (0.5203125,)], "x double"))
    assert x.where(_six(F.col("x")) != F.round("x", 6)).count() == 0
