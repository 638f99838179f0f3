import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cladeflow.operators import timestamps
from cladeflow.operators.orphans import ForeignKey, References, loose_name, orphan_cascade, references_at_load
from cladeflow.operators.prefix_sums import known_around, running_sums, suffix_min
from cladeflow.operators.timestamps import estimate_offsets, normalise_times, read_times
from cladeflow.plans.core_problems import p4_cascade, p6_estimated, p6_found

T0 = datetime(2024, 1, 1)


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i % 50, i, i % 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v int")
    got = {r["id"]: (r["v_run"], r["v_all"]) for r in running_sums(df, ["g"], ["o", "id"], {"v": F.col("v")}, parts=8).collect()}
    for g in {r[0] for r in rows}:
        run, mine = 0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        total = sum(r[3] for r in mine)
        for r in mine:
            run += r[3]
            assert got[r[2]] == (run, total)


def test_running_sums_null_group_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "g string, o int, v int")
    assert sorted(r["v_run"] for r in running_sums(df, ["g"], ["o"], {"v": F.col("v")}).collect()) == [2, 4, 5]
    assert running_sums(df.limit(0), ["g"], ["o"], {"v": F.col("v")}).count() == 0


def test_suffix_min(spark):
    vals = [(i, (i * 7919) % 101) for i in range(500)]
    df = running_sums(spark.createDataFrame(vals, "o int, x int"), [], ["o"], {"k": F.lit(1)}, parts=6, keep_part=True)
    got = {r["o"]: r["m"] for r in suffix_min(df, [], ["o"], "x", "m").collect()}
    assert all(got[o] == min(x for p, x in vals if p >= o) for o, _ in vals)


def judge(recs, refs):
    norm = lambda s: None if s is None or not s.strip() else s.strip().lower().replace("/", "_").replace(" ", "_")
    out = set()
    for rid, key, t in refs:
        if norm(key) is None:
            continue
        mine = [r for r in recs if norm(r[0]) == norm(key)]
        if any(a is not None and a <= t and (w is None or w > t) for _, a, w in mine):
            continue
        out.add((rid, "missing" if not mine else "late" if any(a is None or a > t for _, a, _ in mine) else "withdrawn"))
    return out


def test_references_against_brute_force(spark):
    rnd = random.Random(5)
    at = lambda: T0 + timedelta(hours=rnd.randrange(60))
    names = ["a/b", "A_B ", " c d", "c_d", "x", "", "  ", None, "y"]
    recs = []
    for _ in range(150):
        a = at() if rnd.random() > 0.05 else None
        recs.append((rnd.choice(names[:6] + ["hot"] * 5), a, at() if rnd.random() < 0.5 else None))
    refs = [(i, rnd.choice([*names, "hot", "HOT", "q"]), at()) for i in range(400)]
    df = spark.createDataFrame(recs, "name string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz")
    rf = spark.createDataFrame([(*r, "z") for r in refs], "rid long, key string, loaded_at timestamp_ntz, reason string")
    got = references_at_load(df, "name", "loaded_at", "withdrawn_at", [References("t", rf, "rid", "key", "loaded_at")]).collect()
    assert {(r["row_id"], r["reason"]) for r in got} == judge(recs, refs)
    assert len(got) == len({r["row_id"] for r in got})
    assert {r["load_month"] for r in got} == {"2024-01"}


def test_references_empty_and_null_time(spark):
    recs = spark.createDataFrame([], "name string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz")
    rf = spark.createDataFrame([(1, "a", None), (2, None, T0)], "rid long, key string, loaded_at timestamp_ntz")
    got = references_at_load(recs, "name", "loaded_at", "withdrawn_at", [References("t", rf, "rid", "key", "loaded_at")]).collect()
    assert [(r["row_id"], r["load_month"], r["reason"]) for r in got] == [(1, None, "missing")]
    assert references_at_load(recs, "name", "loaded_at", "withdrawn_at", [References("t", rf.limit(0), "rid", "key", "loaded_at")]).count() == 0


def test_cascade_direct_and_inherited(spark):
    a = spark.createDataFrame([(1, "k1"), (2, "k2")], "id int, name string")
    b = spark.createDataFrame([(1, "K1", "b1"), (2, "zz", "b2"), (3, None, "b3"), (4, "zz", "b4"), (5, "k2", "b4")], "id int, ref string, name string")
    c = spark.createDataFrame([(1, "b1"), (2, "b2"), (3, "b4"), (4, "nope"), (5, None), (6, "b2")], "id int, ref string")
    d = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "id int, ref int")
    fks = [ForeignKey("b", "ref", "a", "name"), ForeignKey("c", "ref", "b", "name"), ForeignKey("d", "ref", "c", "id")]
    compare = lambda n: loose_name(F.col(n).cast("string"))
    got = orphan_cascade({"a": a, "b": b, "c": c, "d": d}, dict.fromkeys("abcd", "id"), fks, compare=compare).collect()
    found = {(r["tab"], r["row_id"], r["kind"], r["depth"]) for r in got}
    # b4 has one sound row, so its child is in order
    assert found == {("b", "2", "direct", 0), ("b", "4", "direct", 0), ("c", "2", "inherited", 1), ("c", "6", "inherited", 1), ("c", "4", "direct", 0), ("d", "1", "inherited", 2), ("d", "3", "inherited", 1)}


def test_cascade_ends_on_cycles_and_empty(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 4)], "id int, boss int")
    got = orphan_cascade({"a": a}, {"a": "id"}, [ForeignKey("a", "boss", "a", "id")]).collect()
    assert {(r["row_id"], r["depth"]) for r in got} == {("3", 0), ("2", 1), ("1", 2)}
    assert orphan_cascade({"a": a.limit(0)}, {"a": "id"}, [ForeignKey("a", "boss", "a", "id")]).count() == 0


def test_read_times_nulls_long_texts_and_clashing_names(spark):
    rows = [(1, None, None, 7), (2, "", "UTC", 7), (3, "2020-01-01", None, 7), (4, "x" * 200_000, None, 7), (5, "2020-01-01 10:00", None, 7), (6, "2020-01-01", None, 7)]
    df = spark.createDataFrame(rows, "id int, v string, z string, utc_us long")
    got = {r["id"]: (r["utc_us"], r["local_us"]) for r in read_times(df, "v", "z").collect()}
    day = 1577836800000000
    assert got == {1: (None, None), 2: (None, None), 3: (day, None), 4: (None, None), 5: (None, day + 36000000000), 6: (day, None)}
    assert read_times(df.limit(0), "v", "z").count() == 0
    full = normalise_times(df.withColumns({"loaded_at": F.lit(None).cast("timestamp_ntz"), "src": F.lit("a")}), "v", "loaded_at", ["src"], "z", order="id")
    assert {r["id"]: (r["utc_us"], r["how"]) for r in full.collect()} == {1: (None, None), 2: (None, None), 3: (day, "moment"), 4: (None, None), 5: (None, "estimated"), 6: (day, "moment")}
    assert full.limit(0).count() == 0


def test_offset_is_found_from_ingestion(spark):
    """A laboratory five hours west until the tenth of March, four from then on; another at +05:45, in the same
    table; rows arrive within a quarter of an hour. The change is found inside the month."""
    rows = []
    for i in range(240):
        loaded = datetime(2024, 3, 1, 6) + timedelta(hours=2 * i)
        for src, off in (("west", -5 if loaded < datetime(2024, 3, 10, 5) else -4), ("east", 5.75)):
            rows.append((src, f"{loaded + timedelta(hours=off) - timedelta(minutes=i % 15):%Y-%m-%d %H:%M:%S}", loaded, int((loaded - timedelta(minutes=i % 15) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000))
    df = spark.createDataFrame(rows, "src string, v string, loaded_at timestamp_ntz, true_us long")
    hist = estimate_offsets(read_times(df, "v"), ["src"], "loaded_at", max_lag_hours=0.25).collect()
    found = {src: {(datetime(1970, 1, 1) + timedelta(microseconds=r["day"])).day: r["offset_min"] for r in hist if r["src"] == src} for src in ("west", "east")}
    assert set(found["east"].values()) == {345}
    assert {d: o for d, o in found["west"].items() if d < 10} == dict.fromkeys(range(1, 10), -300) and {o for d, o in found["west"].items() if d > 10} == {-240}
    got = normalise_times(df, "v", "loaded_at", ["src"], max_lag_hours=0.25)
    assert got.where("utc_us is not null or how <> 'estimated'").count() == 0
    assert got.where("src = 'east' and est_utc_us <> true_us or est_utc_us is null").count() == 0
    assert got.where("src = 'west' and est_utc_us <> true_us").count() <= 4


def test_offset_is_found_from_the_sequence(spark):
    """Rows arrive years later, but in the order in which they were written, every other with its offset."""
    rows = []
    for i in range(200):
        at = datetime(2015, 5, 1) + timedelta(minutes=10 * i)
        local = at + timedelta(hours=9)
        rows.append((i, "lab", f"{local:%Y-%m-%dT%H:%M:%S}" + ("+09:00" if i % 2 else ""), datetime(2024, 1, 1), int((at - datetime(1970, 1, 1)).total_seconds()) * 1_000_000))
    # the same rows in no order tell nothing
    rows += [((i * 7919) % 200, "mixed", *r[2:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "n int, src string, v string, loaded_at timestamp_ntz, true_us long")
    got = normalise_times(df, "v", "loaded_at", ["src"], order="n").where("how = 'estimated'")
    assert got.where("src = 'lab' and est_utc_us = true_us").count() == 100
    assert got.where("src = 'mixed' and est_utc_us is not null").count() == 0


def test_known_around_against_a_loop(spark):
    rnd = random.Random(6)
    rows = [(g, i, rnd.randrange(100) if rnd.random() < 0.3 else None) for g in ("a", "b", None) for i in range(120 if g else 15)]
    got = {(r["g"], r["i"]): (r["b"], r["f"]) for r in known_around(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], "v", "b", "f", parts=7).collect()}
    for g, i, _ in rows:
        line = [v for h, _, v in rows if h == g]
        back, front = [v for v in line[:i] if v is not None], [v for v in line[i + 1 :] if v is not None]
        assert got[g, i] == (back[-1] if back else None, front[0] if front else None)


def test_offset_stays_open_without_evidence(spark):
    df = spark.createDataFrame([("lab", "2010-01-01 10:00:00", datetime(2024, 1, 1)), ("lab", "2010-01-01 10:00:00", None)], "src string, v string, loaded_at timestamp_ntz")
    assert normalise_times(df, "v", "loaded_at", ["src"]).where("est_utc_us is not null").count() == 0


def test_p4_cascade_judges_at_load_time(spark, tmp_path):
    """Late and withdrawn records, both metadata tables, repeated links and months, counted by hand."""
    day = lambda k: T0 + timedelta(days=k)
    write = lambda n, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{n}.parquet")
    write("fasta_record", [(1, "a", day(0), None), (2, "late", day(20), None), (3, "gone", day(0), day(5)), (4, "h", day(0), None), (5, "b", day(0), None)], "row_ord long, name string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz")
    write("meta", [(1, "A", day(1)), (2, "late", day(10)), (3, "gone", day(40)), (4, "none", day(1)), (5, None, day(1)), (6, "late", day(50))], "meta_row long, id string, loaded_at timestamp_ntz")
    write("h5n1_ha_metadata", [(1, "h", day(1)), (2, "lost", day(1))], "h5_row long, taxon string, loaded_at timestamp_ntz")
    # the first two are one row delivered twice; the late record's second metadata row, in order, serves only the last link
    edges = [("a", "none", day(35)), ("a", "none", day(35)), ("h", "lost", day(2)), ("h", "b", day(2)), ("a", "late", day(45)), ("late", "h", day(60))]
    write("supported_edges", edges, "id1 string, id2 string, loaded_at timestamp_ntz")
    got = {(r["tab"], r["load_month"], r["kind"], r["depth"], r["reason"], r["orphans"]) for r in p4_cascade(spark, str(tmp_path)).collect()}
    assert got == {
        ("meta", "2024-01", "direct", 0, "missing", 1),
        ("meta", "2024-01", "direct", 0, "late", 1),
        ("meta", "2024-02", "direct", 0, "withdrawn", 1),
        ("h5n1_ha_metadata", "2024-01", "direct", 0, "missing", 1),
        ("supported_edges", "2024-01", "direct", 0, "missing", 1),
        ("supported_edges", "2024-01", "inherited", 1, None, 1),
        ("supported_edges", "2024-02", "inherited", 1, None, 3),
    }


def test_p6_found_estimates_nothing(spark, tmp_path, monkeypatch):
    """Estimates cannot add a row to p6_found, so it makes none; p6_estimated does, and both agree on what is certain."""
    rows = [(1, "2020-01-01 10:00", "Asia/Tokyo"), (2, "2020-01-01 10:00", None), (3, "2020-01-01", None), (4, "x", None), (5, "2018-03-11 02:30:00", "America/New_York"), (6, "2020-01-01 10:00", "No/Where"), (7, None, "UTC")]
    for name, kind in (("date_oracle", "oracle_row long, input string, zone_name string, kind string"), ("meta", "meta_row long, date string, zone_name string, id string"), ("h5n1_ha_metadata", "h5_row long, date string, zone_name string, location string")):
        spark.createDataFrame([(*r, "meta") for r in rows], kind).withColumn("loaded_at", F.lit(T0)).write.parquet(f"{tmp_path}/{name}.parquet")
    called = []
    estimate = timestamps.estimate_offsets
    monkeypatch.setattr(timestamps, "estimate_offsets", lambda *a: called.append(a) or estimate(*a))
    day = 1577836800000000
    found = {tuple(r) for r in p6_found(spark, str(tmp_path)).collect()}
    assert found == {(t, *r) for t in ("date_oracle", "meta", "h5n1_ha_metadata") for r in ((1, day + 3600_000_000), (3, day))}
    assert not called
    full = p6_estimated(spark, str(tmp_path))
    assert called
    assert {(r["tab"], r["row_id"], r["utc_us"]) for r in full.collect() if r["utc_us"] is not None} == found
    assert full.where("how = 'estimated'").count() == 6
