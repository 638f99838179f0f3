"""Rooted trees as node tables (node, parent, length, name)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.session import counted, forget, stored


def parse_newick(text: str) -> list[tuple[int, int | None, float | None, str | None]]:
    """(node, parent, length, name) in order of appearance, the root is 0. Quoted names, comments
    in [] or {} and labels of inner nodes are read; a text without a tree gives no node."""
    out: list[list] = []
    stack: list[int] = []
    i, n, cur = 0, len(text), None

    def fresh() -> int:
        out.append([len(out), stack[-1] if stack else None, None, None])
        return len(out) - 1

    while i < n:
        c = text[i]
        if c in "[{":
            close = text.find("]" if c == "[" else "}", i)
            i = n if close < 0 else close + 1
            continue
        if c == "(":
            stack.append(fresh())
            cur = None
        elif c in ",)":
            if cur is None and stack:
                fresh()
            cur = None
            if c == ")" and stack:
                cur = stack.pop()
        elif c == ";":
            break
        elif c == ":":
            j = i + 1
            while j < n and text[j] in "0123456789.eE+- \t":
                j += 1
            if cur is None:
                cur = fresh()
            try:
                out[cur][2] = float(text[i + 1 : j])
            except ValueError:
                pass
            i = j
            continue
        elif not c.isspace():
            j = i
            if c in "'\"":
                j = text.find(c, i + 1)
                j = n if j < 0 else j
                name, j = text[i + 1 : j], j + 1
            else:
                while j < n and text[j] not in "():,;[]{}":
                    j += 1
                name = text[i:j].strip()
            if cur is None:
                cur = fresh()
            out[cur][3] = name or None
            i = j
            continue
        i += 1
    return [tuple(x) for x in out]


def closure(nodes: DataFrame) -> DataFrame:
    """node, ancestor, steps: every node with itself and all its ancestors, by doubling, so the rounds are
    logarithmic in the depth of the tree."""
    up = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    jump = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))
    span = 1
    while not jump.isEmpty():
        # up holds all pairs of fewer than `span` steps, jump those of exactly `span`
        far = jump.select(F.col("node").alias("n"), F.col("ancestor").alias("a"), F.col("steps").alias("s"))
        more = far.join(up, far["a"] == up["node"]).select(F.col("n").alias("node"), "ancestor", (F.col("s") + F.col("steps")).alias("steps"))
        up = stored(up.unionByName(more))
        far2 = jump.select(F.col("node").alias("b"), F.col("ancestor").alias("c"), F.col("steps").alias("s2"))
        jump = stored(far.join(far2, far["a"] == far2["b"]).select(F.col("n").alias("node"), F.col("c").alias("ancestor"), (F.col("s") + F.col("s2")).alias("steps")))
        span *= 2
    return up


def depths(nodes: DataFrame, close: DataFrame) -> DataFrame:
    """node, depth: branch lengths from the root, null lengths as 0."""
    a = nodes.select(F.col("node").alias("ancestor"), F.coalesce("length", F.lit(0.0)).alias("l"))
    return close.join(a, "ancestor").groupBy("node").agg(F.sum("l").alias("depth"))


def shared_depth(pairs: DataFrame, close: DataFrame, depth: DataFrame) -> DataFrame:
    """i, j, shared (depth of the last common ancestor), distance (patristic) of given pairs."""
    a = close.select(F.col("node").alias("i"), "ancestor")
    b = close.select(F.col("node").alias("j"), F.col("ancestor").alias("anc"))
    d = depth.select(F.col("node").alias("ancestor"), "depth")
    m = pairs.select("i", "j").join(a, "i").join(b, "j").where("ancestor = anc").join(d, "ancestor").groupBy("i", "j").agg(F.max("depth").alias("shared"))
    di, dj = depth.select(F.col("node").alias("i"), F.col("depth").alias("di")), depth.select(F.col("node").alias("j"), F.col("depth").alias("dj"))
    return m.join(di, "i").join(dj, "j").select("i", "j", "shared", (F.col("di") + F.col("dj") - 2 * F.col("shared")).alias("distance"))


def node_levels(nodes: DataFrame) -> DataFrame:
    """node, level: steps from the root, by pointer doubling: a row per node, rounds logarithmic in the depth."""
    at = stored(nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")))
    left = True
    while left:
        a = at.select(F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("level").alias("l2"))
        step = at.join(a, at["up"] == a["n2"], "left").select("node", F.col("up2").alias("up"), (F.col("level") + F.coalesce("l2", F.lit(0))).alias("level"))
        last = at
        at, n = counted(step, open=F.col("up").isNotNull().cast("long"))
        forget(last)
        left = bool(n["open"])
    return at.select("node", "level")


def _least_state(s: Column) -> Column:
    return F.log2(s.bitwiseAND(-s).cast("double")).cast("int")


def fitch_sets(nodes: DataFrame, tips: DataFrame) -> list[DataFrame]:
    """node, parent, set (bits of states) per level from the root, by Fitch's upward pass. A tip without a state may be in any state
    that occurs. Each level is one grouped aggregation over the level below, written once."""
    known = tips.where("state is not null").select(F.col("node").alias("k"), F.expr("shiftleft(1L, cast(state as int))").alias("own"))
    any_state = known.agg(F.bit_or("own")).first()[0]
    if any_state is None:
        return []
    inner = nodes.where("parent is not null").select(F.col("parent").alias("p")).distinct()
    n = nodes.join(node_levels(nodes), "node").join(known, F.col("node") == F.col("k"), "left").join(inner, F.col("node") == F.col("p"), "left")
    n = n.select("node", "parent", "level", F.coalesce("own", F.when(F.col("p").isNull(), F.lit(any_state))).alias("own"))
    # sorted by level, so that a level's read skips the others
    n = stored(n.repartitionByRange("level").sortWithinPartitions("level"))
    top = n.agg(F.max("level")).first()[0]
    below: DataFrame | None = None
    levels: list[DataFrame] = []
    for lvl in range(top, -1, -1):
        here = n.where(F.col("level") == lvl)
        if below is None:
            below = here.select("node", "parent", F.col("own").alias("set"))
        else:
            kids = below.groupBy(F.col("parent").alias("p")).agg(F.bit_and("set").alias("both"), F.bit_or("set").alias("any"))
            of_kids = F.when(F.col("both") != 0, F.col("both")).otherwise(F.col("any"))
            below = here.join(kids, here["node"] == kids["p"], "left").select("node", "parent", F.coalesce("own", of_kids).alias("set"))
        below = stored(below)
        levels.append(below)
    return levels[::-1]


def fitch(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """node, parent, state, changed: least-change states by Fitch's two passes over state sets.

    nodes: node, parent; tips: node, state (0 to 61, null or absent: unknown). Downwards a node keeps its parent's state if its
    set has it, else takes its least; the root takes its least. Without any known state there are no rows."""
    done: list[DataFrame] = []
    for sets in fitch_sets(nodes, tips):
        if not done:
            here = sets.select("node", "parent", _least_state(F.col("set")).alias("state"), F.lit(False).alias("changed"))
        else:
            p = done[-1].select(F.col("node").alias("p"), F.col("state").alias("ps"))
            k = sets.join(p, sets["parent"] == p["p"], "left")
            keeps = F.col("set").bitwiseAND(F.expr("shiftleft(1L, ps)")) != 0
            st = F.when(keeps, F.col("ps")).otherwise(_least_state(F.col("set")))
            here = k.select("node", "parent", st.alias("state"), (F.col("ps").isNotNull() & (st != F.col("ps"))).alias("changed"))
        done.append(stored(here))
    if not done:
        return nodes.limit(0).select("node", "parent", F.lit(0).alias("state"), F.lit(False).alias("changed"))
    return reduce(DataFrame.unionByName, done)


def root_states(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """state, share: the states in the root's set, equally likely."""
    levels = fitch_sets(nodes, tips)
    if not levels:
        return nodes.sparkSession.createDataFrame([], "state int, share double")
    bit = F.explode(F.sequence(F.lit(0), F.lit(61))).alias("state")
    return levels[0].select("set", bit).where(F.col("set").bitwiseAND(F.expr("shiftleft(1L, state)")) != 0).select("state", (1.0 / F.bit_count("set")).alias("share"))


def transition_counts(states: DataFrame) -> DataFrame:
    """source, target, n: branches along which the state changes, from the result of fitch."""
    up = states.select(F.col("node").alias("p"), F.col("state").alias("source"))
    moved = states.where("changed").join(up, F.col("parent") == F.col("p"))
    return moved.groupBy("source", F.col("state").alias("target")).agg(F.count("*").alias("n"))


def coalescent_intervals(events: DataFrame, group: list[str]) -> DataFrame:
    """Intervals between consecutive times before present, with the lineages alive in each. events: tau, step (+1 for a
    sampled tip, -1 for a coalescence). A group is one tree; its events are summed along tau."""
    e = events.groupBy(*group, "tau").agg(F.sum("step").alias("step"), F.sum(F.when(F.col("step") < 0, -F.col("step")).otherwise(0)).alias("events"))
    w = Window.partitionBy(*group).orderBy("tau")
    e = e.withColumn("k", F.sum("step").over(w)).withColumn("tau2", F.lead("tau").over(w)).withColumn("events2", F.lead("events").over(w))
    return e.where("tau2 is not null").select(*group, F.col("tau").alias("tau1"), "tau2", "k", F.col("events2").alias("events"))
