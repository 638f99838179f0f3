import random

from cladeflow.operators.screening import ClockModel, draw_anchors
from cladeflow.streaming.screen import run_to_table, screen

MODEL = ClockModel(rate=0.001, d0=0.01, t_ref=2010.0, sigma=0.002, origin=2000.0, span=20.0, median_distance=0.02)


def test_screen_uses_the_nearest_anchors(spark, tmp_path):
    """Chimeras, contaminants near the root by their divergence, and the date of the nearest anchor; table and stream alike."""
    rnd = random.Random(1)
    change = lambda s, share: "".join(rnd.choice("ACGT".replace(c, "")) if rnd.random() < share else c for c in s)
    root = "".join(rnd.choice("ACGT") for _ in range(1200))
    old, new = change(root, 0.02), change(root, 0.02)
    anchors = spark.createDataFrame([(1, 2001.0, old), (2, 2019.0, new), (3, None, root)], "taxon long, date double, seq string")
    fit = lambda t: 0.01 + 0.001 * (t - 2010)
    rows = [
        (10, 2010.0, old[:600] + new[600:], fit(2010)),
        (11, 2010.0, old, fit(2010)),
        (12, 2010.0, change(root, 0.5), fit(2010)),
        # too divergent by the clock, but close to an anchor of another time
        (13, 2010.0, new, fit(2010) + 0.006),
        (14, 2018.5, new, fit(2018.5) + 0.006),
        (15, None, old, 0.01),
    ]
    want = {10: "SUS_CHIMERIC", 11: "PASS", 12: "SUS_CONTAMINANT", 13: "SUS_DATE_MISMATCH", 14: "SUS_HYPERMUTATED", 15: "FLAG_MISSING_DATE"}
    x = spark.createDataFrame(rows, "taxon long, date double, seq string, d double")
    got = {r["taxon"]: r for r in screen(x, MODEL, anchors, "taxon", "d", "date", "seq").collect()}
    assert {k: r["status"] for k, r in got.items()} == want
    assert (got[11]["nn_anchor"], got[11]["nn"], got[11]["nn_date"]) == (1, 0.0, 2001.0)
    x.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(x.schema).parquet(f"{tmp_path}/in")
    out = run_to_table(screen(stream, MODEL, anchors, "taxon", "d", "date", "seq"), f"{tmp_path}/at")
    assert {r["taxon"]: r["status"] for r in out.collect()} == want


def test_draw_anchors(spark):
    df = spark.range(4000).selectExpr("id taxon", "case when id % 7 > 0 then 2000 + id % 100 / 10.0d end date")
    got = [r["taxon"] for r in draw_anchors(df, "taxon", "date", most=64, bins=8).collect()]
    assert len(got) == len(set(got)) == 64
    bins = [min(7, int((t % 100 / 10) / 9.9 * 8)) for t in got]
    assert all(bins.count(k) == 8 for k in range(8))
    assert draw_anchors(df.where("taxon < 50"), "taxon", "date").count() == df.where("taxon < 50 and date is not null").count()
