"""Problem 8: records of several sources mixed to target shares of the total size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.session import stored

#: hash bits resolved per round: histograms have sources x 2^STEP rows at most
STEP = 12


def loose_source(c: Column | str) -> Column:
    """A source as it is compared: trimmed, any case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


@dataclass
class Share:
    source: str
    target: float
    repeats: int
    available: int = 0
    copies: int = 0  # whole copies of the source
    rest: float = 0.0  # size still wanted from one more, partial copy
    prefix: int = 0  # unsigned hash threshold found so far
    bits: int = 0
    taken: int = 0  # size below the threshold
    stated: float = 0.0  # the share as the targets state it, of sources without records too


def shares_of(targets: DataFrame) -> list[Share]:
    """The targets, one per source (a bounded table); shares are brought to sum one.
    Sources that are null, shares that are null or not positive and repeats below one are left out."""
    rows = targets.select(loose_source("source").alias("s"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("int").alias("r")).where("s is not null and t > 0 and not isnan(t) and r >= 1").groupBy("s").agg(F.sum("t").alias("t"), F.max("r").alias("r")).orderBy("s").collect()
    whole = sum(x["t"] for x in rows)
    return [Share(x["s"], x["t"] / whole, x["r"], stated=x["t"] / whole) for x in rows]


def sized(docs: DataFrame, key: str, source: str, size: str, shares: list[Share]) -> DataFrame:
    """id, source, size and hash of the records that can be drawn, written once."""
    d = docs.select(F.col(key).alias("id"), loose_source(source).alias("source"), F.col(size).cast("long").alias("size"))
    d = d.where(F.col("source").isin([s.source for s in shares]) & (F.col("size") > 0) & F.col("id").isNotNull())
    return stored(d.withColumn("h", F.xxhash64("id")))


def _unsigned_top(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def reachable(shares: list[Share]) -> float:
    """The largest total size at which every source can still give its share."""
    return min((s.available * s.repeats / s.target for s in shares if s.available), default=0.0)


def thresholds(rows: DataFrame, shares: list[Share], totals: list[float]) -> list[list[Share]]:
    """For each total size and source the number of whole copies and the hash below
    which records get one more copy.

    A histogram of sizes by (source, top hash bits) shows in which bucket the wanted size
    is reached; only that bucket is split further by the next bits, until it holds at
    most one hash. All totals share the histograms, and since thresholds grow with
    the total, the draws are nested. Nothing is sorted; the driver sees only histograms.
    """
    plans = []
    for total in totals:
        plan = []
        for s in shares:
            want = min(s.target * total, s.available * s.repeats)
            copies = min(int(want // s.available), s.repeats) if s.available else 0
            rest = want - copies * s.available if copies < s.repeats else 0.0
            plan.append(Share(s.source, s.target, s.repeats, s.available, copies, rest, stated=s.stated))
        plans.append(plan)
    bits = 0
    open_ = {(p, k) for p, plan in enumerate(plans) for k, s in enumerate(plan) if s.rest > 0}
    while open_ and bits < 64:
        step = min(STEP, 64 - bits)
        keys = sorted({(plans[p][k].source, plans[p][k].prefix) for p, k in open_})
        inside = F.lit(False)
        for src, prefix in keys:
            inside = inside | ((F.col("source") == src) & (_unsigned_top("h", bits) == prefix if bits else F.lit(True)))
        hist: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
        got = rows.where(inside).groupBy("source", _unsigned_top("h", bits + step).alias("b")).agg(F.sum("size").alias("size"), F.count_distinct("h").alias("hashes") if bits else F.count("*").alias("hashes")).collect()
        for x in got:
            # a prefix of all 64 bits comes back as a signed number
            b = x["b"] & (1 << (bits + step)) - 1
            hist.setdefault((x["source"], b >> step if bits else 0), {})[b] = (x["size"], x["hashes"])
        for p, k in list(open_):
            s = plans[p][k]
            below = s.taken
            cell = hist.get((s.source, s.prefix if bits else 0), {})
            for b in sorted(cell):
                if below + cell[b][0] > s.rest:
                    s.prefix, s.bits, s.taken = b, bits + step, below
                    if cell[b][1] <= 1:
                        # the record at the boundary is drawn if that comes closer
                        if 2 * (s.rest - below) > cell[b][0]:
                            s.prefix, s.taken = b + 1, below + cell[b][0]
                        open_.discard((p, k))
                    break
                below += cell[b][0]
            else:
                # all of the bucket fits: the threshold is its end
                s.prefix, s.bits, s.taken = (s.prefix + 1) if bits else 1 << step, bits or step, below
                open_.discard((p, k))
        bits += step
    return plans


def draw(rows: DataFrame, plan: list[Share]) -> DataFrame:
    """id, source, size, copies (at least 1) of the records drawn by a plan."""
    copies = F.lit(0)
    for s in plan:
        partial = F.lit(0)
        if s.bits and s.prefix >= 1 << s.bits:
            partial = F.lit(1)
        elif s.bits:
            cut = s.prefix << (64 - s.bits)
            # unsigned comparison by flipping the sign bit
            signed = (cut ^ (1 << 63)) - (1 << 64 if (cut ^ (1 << 63)) >= 1 << 63 else 0)
            partial = F.when(F.col("h").bitwiseXOR(F.lit(-(1 << 63))) < F.lit(signed), 1).otherwise(0)
        copies = F.when(F.col("source") == s.source, F.lit(s.copies) + partial).otherwise(copies)
    return rows.withColumn("copies", copies.cast("int")).where("copies > 0").select("id", "source", "size", "copies")


def plan_mix(docs: DataFrame, targets: DataFrame, key: str, source: str, size: str, fractions: list[float]) -> tuple[DataFrame, list[list[Share]]]:
    """The rows that can be drawn and one plan per fraction of the largest reachable total.
    A source without records would make the reachable total zero: its target becomes 0 and
    those of the others are brought to sum one; `stated` keeps what was asked for."""
    shares = shares_of(targets)
    rows = sized(docs, key, source, size, shares)
    have = {x["source"]: x["n"] for x in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    for s in shares:
        s.available = have.get(s.source, 0)
    whole = sum(s.target for s in shares if s.available)
    for s in shares:
        s.target = s.target / whole if s.available else 0.0
    most = reachable(shares)
    return rows, thresholds(rows, shares, [f * most for f in fractions])


def mix_report(drawn: DataFrame, plan: list[Share]) -> DataFrame:
    """Per source of the targets, those without records too: the share stated, the share aimed at,
    the actual one, records, total size, most copies of one record."""
    spark = drawn.sparkSession
    want = spark.createDataFrame([(s.source, s.stated, s.target, s.repeats, s.available) for s in plan], "source string, target_share double, aimed_share double, max_repeats int, available long")
    got = drawn.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("size") * F.col("copies")).alias("total"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("total").alias("whole"))
    out = want.join(got, "source", "left").join(F.broadcast(whole))
    return out.select("source", "target_share", "aimed_share", F.coalesce(F.try_divide("total", "whole"), F.lit(0.0)).alias("actual_share"), "max_repeats", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("total", F.lit(0)).alias("total"), "available")
