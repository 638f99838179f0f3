"""Networks given as edge tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.kernels import modularity_cut
from cladeflow.session import stored


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree over both ends of the edges (i, j)."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the edges (i, j).

    Least neighbour, then pointer jumping, per round; a round's table is written to the
    shared folder. It ends when no label changes. The numbers of nodes may be any comparable type."""
    e = edges.where("i is not null and j is not null and i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    e = stored(e.union(e.select("b", "a")).distinct())
    label = stored(e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = e.join(label, e["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m"))
        hook = label.join(near, label["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("up"))
        hook = stored(hook)
        top = hook.select(F.col("node").alias("w"), F.col("up").alias("next"))
        new = stored(hook.join(top, hook["up"] == top["w"], "left").select("node", F.least("up", F.coalesce("next", "up")).alias("component"), (F.least("up", F.coalesce("next", "up")) != F.col("old")).alias("changed")))
        label = new.select("node", "component")
        if new.where("changed").isEmpty():
            return label


def cluster_summary(edges: DataFrame, label: DataFrame, weight: str) -> DataFrame:
    """component, size, edges and least, mean and greatest weight."""
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    e = edges.join(label, edges["i"] == label["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.min(weight).alias("least"), F.avg(weight).alias("mean"), F.max(weight).alias("greatest"))
    return size.join(e, "component")


def spectral_bisection(edges: DataFrame, label: DataFrame, weight: str, min_size: int = 3, max_depth: int = 3, max_conductance: float = 0.65, max_nodes: int = 4096) -> DataFrame:
    """node, path: each component split along its Fiedler vector, level by level, as long
    as both parts have min_size nodes and the cut's conductance is at most max_conductance. Of the cuts along the vector the one
    with the best modularity is taken.

    A level is one grouped kernel keyed by path. Parts over max_nodes are split on
    the edge table (fiedler_signs) by the vector's sign, as a dense eigenproblem of that size belongs in no task."""
    now = stored(label.select("node", F.concat(F.col("component").cast("string"), F.lit(":")).alias("path"), F.lit(False).alias("stopped")))

    def split(f: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(f["i"]) | set(f["j"]))
        at = {n: k for k, n in enumerate(nodes)}
        a = np.zeros((len(nodes), len(nodes)))
        for i, j, w in zip(f["i"], f["j"], f["w"], strict=True):
            if i != j:
                a[at[i], at[j]] += w
                a[at[j], at[i]] += w
        path, deg = f["path"].iloc[0], a.sum(axis=1)
        stop = pd.DataFrame({"node": nodes, "path": path, "stopped": True})
        if len(nodes) < 2 * min_size or (deg <= 1e-12).any():
            return stop
        s = 1 / np.sqrt(deg)
        vals, vecs = np.linalg.eigh(np.eye(len(nodes)) - s[:, None] * a * s[None, :])
        v = vecs[:, 1] * s
        v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
        order = np.argsort(v, kind="stable")
        k, _ = modularity_cut(a, order, min_size)
        if not k:
            return stop
        side = np.ones(len(nodes), bool)
        side[order[:k]] = False
        cut = a[side][:, ~side].sum()
        low = min(deg[side].sum(), deg[~side].sum())
        if min(side.sum(), (~side).sum()) < min_size or low <= 0 or cut / low > max_conductance:
            return stop
        return pd.DataFrame({"node": nodes, "path": [path + ("R" if x else "L") for x in side], "stopped": False})

    kind = dict(label.dtypes)["node"]
    for _ in range(max_depth):
        x = now.select(F.col("node").alias("n1"), F.col("path"), "stopped").where(~F.col("stopped"))
        y = now.select(F.col("node").alias("n2"), F.col("path").alias("p2"))
        inside = edges.join(x, edges["i"] == x["n1"]).join(y, (edges["j"] == y["n2"]) & (F.col("path") == F.col("p2"))).select("path", "i", "j", F.col(weight).cast("double").alias("w"))
        big = stored(x.groupBy("path").count().where(F.col("count") > max_nodes).select("path"))
        new = inside.join(big, "path", "left_anti").groupBy("path").applyInPandas(split, f"node {kind}, path string, stopped boolean")
        if not big.isEmpty():
            new = new.unionByName(_split_large(stored(inside.join(big, "path", "left_semi")), min_size, max_conductance))
        new = stored(new)
        lone = now.join(new.select("node"), "node", "left_anti").select("node", "path", F.lit(True).alias("stopped"))
        now = stored(new.unionByName(lone))
        if now.where(~F.col("stopped")).isEmpty():
            break
    return now.select("node", "path")


def _both_ways(inside: DataFrame) -> DataFrame:
    e = inside.where("i <> j")
    return e.unionByName(e.select("path", F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def fiedler_signs(inside: DataFrame, rounds: int = 300, tolerance: float = 1e-7) -> DataFrame:
    """path, node, deg, side: the sign of the Fiedler vector of each path's graph, (path, i, j, w).

    The random walk's second vector by conjugate directions: each round is one sparse product (a join of
    the edges with the vector) and the best combination of the vector, its residual and the last step, whose
    products come to the driver, ten numbers for each path. It ends when every path's residual is at most
    `tolerance` of its vector, or after `rounds`. A path with a node without weight is left out."""
    e = _both_ways(inside)
    deg = e.groupBy("path", F.col("i").alias("node")).agg(F.sum("w").alias("deg"))
    deg = stored(deg.join(deg.groupBy("path").agg(F.min("deg").alias("low")).where("low > 1e-12").select("path"), "path", "left_semi"))
    e = stored(e.join(deg.select("path", F.col("node").alias("i"), "deg"), ["path", "i"]).select("path", "i", "j", (F.col("w") / F.col("deg")).alias("w")))

    def walked(v: DataFrame, name: str) -> DataFrame:
        at = v.select("path", F.col("node").alias("j"), F.col(name).alias("v"))
        return e.join(at, ["path", "j"]).groupBy("path", F.col("i").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias(f"m{name}"))

    x = deg.withColumn("x", F.pmod(F.xxhash64("node"), F.lit(1_000_003)) / 500_001.5 - 1)
    x = stored(x.join(walked(x, "x"), ["path", "node"]).withColumns({"r": F.lit(0.0), "p": F.lit(0.0), "mp": F.lit(0.0), "one": F.lit(1.0)}))
    names = ("x", "r", "p", "one")
    image = {"x": "mx", "r": "mr", "p": "mp", "one": "one"}
    for _ in range(rounds):
        q = x.groupBy("path").agg(F.sum(F.col("deg") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("deg") * F.col("x") * F.col("mx")).alias("xm"))
        y = x.drop("r").join(q, "path").withColumn("r", F.col("mx") - F.col("xm") / F.col("xx") * F.col("x")).drop("xx", "xm")
        y = stored(y.join(walked(y, "r"), ["path", "node"]))
        dots = [F.sum(F.col("deg") * F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for a in names for b in names]
        dots += [F.sum(F.col("deg") * F.col(a) * F.col(image[b])).alias(f"h_{a}_{b}") for a in names for b in names]
        rows, steps = y.groupBy("path").agg(*dots).collect(), []
        for s in rows:
            g, h = (np.array([[s[f"{k}_{a}_{b}"] for b in names] for a in names]) for k in "gh")
            plain = np.eye(4)[:, :3]
            plain[3] = -g[3, :3] / g[3, 3]  # the constant vector taken out
            g, h = plain.T @ g @ plain, plain.T @ (h + h.T) @ plain / 2
            scale = np.where(np.diag(g) > 0, 1 / np.sqrt(np.maximum(np.diag(g), 1e-300)), 0.0)
            vals, vecs = np.linalg.eigh(g * scale[:, None] * scale[None, :])
            base = scale[:, None] * vecs[:, vals > 1e-10] / np.sqrt(vals[vals > 1e-10])
            c = plain @ base @ np.linalg.eigh(base.T @ h @ base)[1][:, -1]
            steps.append((s["path"], *map(float, c), bool(g[1, 1] <= tolerance**2 * g[0, 0])))
        done = all(s[-1] for s in steps)
        k = inside.sparkSession.createDataFrame(steps, "path string, cx double, cr double, cp double, c1 double, done boolean")
        move, image_move = F.expr("cr * r + cp * p + c1"), F.expr("cr * mr + cp * mp + c1")
        x = y.join(F.broadcast(k), "path").select("path", "node", "deg", (F.col("cx") * F.col("x") + move).alias("x"), (F.col("cx") * F.col("mx") + image_move).alias("mx"), "r", move.alias("p"), image_move.alias("mp"), "one")
        if done:
            break
        x = stored(x)
    top = x.groupBy("path").agg(F.max_by("x", F.abs("x")).alias("top"))
    return x.join(top, "path").select("path", "node", "deg", (F.col("x") * F.signum("top") > 0).alias("side"))


def _split_large(inside: DataFrame, min_size: int, max_conductance: float) -> DataFrame:
    """node, path, stopped: one level of spectral_bisection for paths of any size. Nodes of paths that are left out come back as lone ones."""
    s = stored(fiedler_signs(inside))
    sides = s.groupBy("path").agg(*(F.count_if(F.col("side") == k).alias(f"n{n}") for n, k in enumerate((False, True))), *(F.sum(F.when(F.col("side") == k, F.col("deg")).otherwise(0.0)).alias(f"d{n}") for n, k in enumerate((False, True))))
    i, j = (s.select("path", F.col("node").alias(c), F.col("side").alias(f"s{c}")) for c in "ij")
    cut = inside.join(i, ["path", "i"]).join(j, ["path", "j"]).where("si <> sj").groupBy("path").agg(F.sum("w").alias("cut"))
    low = F.least("d0", "d1")
    ok = (F.least("n0", "n1") >= min_size) & (low > 0) & (F.coalesce("cut", F.lit(0.0)) / low <= max_conductance)
    verdict = sides.join(cut, "path", "left").select("path", F.coalesce(ok, F.lit(False)).alias("ok"))
    got = s.join(verdict, "path")
    return got.select("node", F.when(F.col("ok"), F.concat("path", F.when(F.col("side"), "R").otherwise("L"))).otherwise(F.col("path")).alias("path"), (~F.col("ok")).alias("stopped"))
