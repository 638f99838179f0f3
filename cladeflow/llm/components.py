"""Problem 1: one group identifier for all records linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.session import counted, forget, stored


def counting_pairs(edges: DataFrame, id1: str, id2: str, weight: str | None, least: float) -> DataFrame:
    """Distinct pairs (lo, hi), lo < hi in byte order, of the rows that count: both ids
    non-null and different, weight >= least (infinity counts, null and NaN do not)."""
    e = edges.select(F.col(id1).alias("a"), F.col(id2).alias("b"), *([F.col(weight).alias("w")] if weight else []))
    e = e.where("a is not null and b is not null and a <> b")
    if weight:
        e = e.where(F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") >= least))
    return e.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def _jump(parent: DataFrame) -> DataFrame:
    """Pointer jumping: every v points to its root; parent: stored (v, u) with u < v. A write takes two
    jumps and counts on the way which pointers the second one still moved."""
    while True:
        up = parent.select(F.col("v").alias("w"), F.col("u").alias("uu"))
        once = parent.join(up, parent["u"] == up["w"], "left").select("v", F.coalesce("uu", "u").alias("u"))
        again = parent.select(F.col("v").alias("w"), F.col("u").alias("uu"))
        twice = once.join(again, once["u"] == again["w"], "left").select("v", F.coalesce("uu", "u").alias("u"), F.col("uu").isNotNull().alias("moved"))
        step, n = counted(twice, moved=F.col("moved").cast("long"))
        forget(parent)
        if not n["moved"]:
            return step
        parent = step


def linked_groups(edges: DataFrame, id1: str = "id1", id2: str = "id2", weight: str | None = "bayes_factor", least: float = 3.0) -> DataFrame:
    """record_id, group_id for each id in a counting edge; group_id is the smallest id
    (byte order) of all ids linked to it directly or indirectly.

    Ids get order-preserving numbers (range sort + increasing ids), so the smallest
    label is the smallest id. A round (1) takes at each node the smallest label over
    its edges, with partial aggregation on the map side, so that a hub costs no more
    than its distinct edges; (2) jumps pointers until every node points at a root;
    (3) contracts the edges onto the roots and drops loops and repeats. Over two
    rounds at least half of the nodes that still have edges vanish (a hub with the largest label
    keeps its leaves for one), so the rounds are logarithmic and the work is dominated by the first. Every round is written to the shared folder; it ends when no
    edge is left, that is, when no label would change. In the joins the side that may be
    skewed (edges at a hub, nodes of a giant group) is the one that adaptive skew
    handling splits; the other has one row per key. Empty input gives an empty result;
    repeated edges, either order, loops, null ids and null or NaN weights are harmless.
    """
    pairs = stored(counting_pairs(edges, id1, id2, weight, least))
    ids = pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")).distinct()
    nodes = stored(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("v")))
    a, b = nodes.select(F.col("id").alias("lo"), F.col("v").alias("x")), nodes.select(F.col("id").alias("hi"), F.col("v").alias("y"))
    e, n = counted(pairs.join(a, "lo").join(b, "hi").select("x", "y"), rows=F.lit(1))
    forget(pairs)
    levels: list[DataFrame] = []
    while n["rows"]:
        hooked = stored(e.groupBy(F.col("y").alias("v")).agg(F.min("x").alias("u")))
        level = _jump(hooked)
        levels.append(level)
        px, py = level.select(F.col("v").alias("x"), F.col("u").alias("rx")), level.select(F.col("v").alias("y"), F.col("u").alias("ry"))
        moved = e.join(px, "x", "left").join(py, "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
        last = e
        e, n = counted(moved.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), rows=F.lit(1))
        forget(last)
    label: DataFrame | None = None
    for level in reversed(levels):
        if label is None:
            label = level.select("v", "u")
            continue
        top = label.select(F.col("v").alias("w"), F.col("u").alias("uu"))
        label = level.join(top, level["u"] == top["w"], "left").select("v", F.coalesce("uu", "u").alias("u")).unionByName(label)
    if label is None:
        return nodes.select(F.col("id").alias("record_id"), F.col("id").alias("group_id"))
    member = nodes.join(label, "v", "left").select(F.col("id").alias("record_id"), F.coalesce("u", "v").alias("v"))
    return member.join(nodes.select("v", F.col("id").alias("group_id")), "v").select("record_id", "group_id")
