"""Per-group kernels over dated, aligned taxa: one task per group, whatever the number of groups.

A group is a data set or clade, whose distance matrix a task holds; groups over `most`
taxa are an error rather than a task that cannot end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import distances as ds
from cladeflow.operators import kernels as kn
from cladeflow.operators.prefix_sums import running_sums
from cladeflow.session import stored

MOST = 5000


def distance_matrix(seqs: list[str]) -> np.ndarray:
    """Screening distances (see distances.tamura_nei_screen), symmetric, zero diagonal; NaN for pairs with too few
    shared sites, which say nothing and must not be taken for a distance of 1."""
    codes = ds.code_matrix([s or "" for s in seqs])
    d = ds.KERNELS["tn93_screen"](ds.meeting_counts(codes, codes)) if codes.shape[1] else np.full((len(seqs), len(seqs)), np.nan)
    np.fill_diagonal(d, 0.0)
    return d


def filled(d: np.ndarray) -> np.ndarray:
    """The same with unscored pairs as the largest distance, at least 1: for kernels that need every pair."""
    return np.where(np.isnan(d), max(1.0, np.nanmax(d, initial=0.0)), d)


def per_group(df: DataFrame, group: str, kernel: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, most: int = MOST) -> DataFrame:
    """kernel(rows ordered by taxon, their distances) for each group; columns taxon, date, seq. Rows without sequence are left out."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > most:
            raise ValueError(f"a group has more than {most} taxa")
        f = f.sort_values("taxon").reset_index(drop=True)
        out = kernel(f, distance_matrix(f["seq"].tolist()))
        out.insert(0, "grp", f[group].iloc[0])
        return out

    kind = dict(df.dtypes)[group]
    return df.where(F.col("seq").isNotNull()).groupBy(group).applyInPandas(run, f"grp {kind}, {schema}")


def _root_distance(f: pd.DataFrame, d: np.ndarray) -> np.ndarray:
    return d[int(f["date"].argmin())]


def clock_models(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    """Rows model, rss, aicc, rate, origin, detail; the first row has the least AICc."""
    t, y = f["date"].to_numpy(float), _root_distance(f, d)
    known = np.isfinite(y)
    t, y, d = t[known], y[known], filled(d[np.ix_(known, known)])
    n = len(t)
    if n < 5 or np.ptp(t) == 0:
        return pd.DataFrame(columns=["model", "rss", "aicc", "rate", "origin", "detail"])
    rows = []
    x = np.c_[np.ones(n), t]
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(((y - x @ b) ** 2).sum())
    rows.append(("line", rss, kn.aicc(rss, n, 3), b[1], -b[0] / b[1] if b[1] else None, None))
    shared = np.maximum(0.5 * (y[:, None] + y[None, :] - d), 0) + np.diag(np.full(n, 1e-3))
    g = kn.pagel_line(t, y, shared)
    raw = float(((y - g["intercept"] - g["slope"] * t) ** 2).sum())
    rows.append(("generalised", raw, kn.aicc(raw, n, 4), g["slope"], -g["intercept"] / g["slope"] if g["slope"] else None, g["lambda"]))
    p = kn.power_line(t, y)
    rows.append(("power", p["rss"], kn.aicc(p["rss"], n, 5), p["b"], p["origin"], p["exponent"]))
    s = kn.restricted_spline(t, y)
    rows.append(("spline", s["rss"], kn.aicc(s["rss"], n, 4), None, None, s["f"]))
    k = kn.broken_line(t, y)
    rows.append(("broken", k["rss"], kn.aicc(k["rss"], n, 5), None, None, k["at"]))
    return pd.DataFrame(rows, columns=["model", "rss", "aicc", "rate", "origin", "detail"]).sort_values("aicc")


def bootstrap_origin(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    t, y = f["date"].to_numpy(float), _root_distance(f, d)
    t, y = t[np.isfinite(y)], y[np.isfinite(y)]
    low, high = kn.wild_bootstrap(t, y) if len(t) > 2 and np.ptp(t) > 0 else (None, None)
    return pd.DataFrame([{"low": low, "high": high}])


def community(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([kn.community_clock(f["date"].to_numpy(float), _root_distance(f, d), d)])


def coordinates(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    x, _ = kn.classical_mds(filled(d))
    return pd.DataFrame({"taxon": f["taxon"], **{f"x{k}": x[:, k] for k in range(4)}})


def metric_report(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([kn.metricity(filled(d))])


def clusters(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    d = filled(d)
    label, _ = kn.spectral_clusters(np.exp(-(d**2) / (2 * kn.adaptive_sigma(d) ** 2))) if len(f) > 2 else (np.zeros(len(f), int), 1)
    return pd.DataFrame({"taxon": f["taxon"], "cluster": label})


def leaders(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"taxon": f["taxon"], "bin": kn.leader_bins(1 - filled(d), 0.8)})


def landmarks(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    p = kn.farthest_points(filled(d), 8)
    return pd.DataFrame({"taxon": f["taxon"].iloc[p], "pick": range(len(p))})


def joined_tree(f: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
    nodes = kn.reroot_midpoint(kn.neighbour_joining(filled(d), [str(t) for t in f["taxon"]]))
    depth = kn.root_to_tip(nodes)
    when = dict(zip(f["taxon"].astype(str), f["date"], strict=True))
    t, y = np.array([when[k] for k in depth]), np.array(list(depth.values()))
    rate = float(np.polyfit(t, y, 1)[0]) if len(t) > 2 and np.ptp(t) > 0 else None
    return pd.DataFrame([{"newick": kn.newick_text(nodes), "tips": len(depth), "height": float(y.max()) if len(y) else None, "rate": rate}])


@dataclass(frozen=True)
class SplitRules:
    """When a community of taxa is split no further."""

    min_leaf: int = 8
    max_depth: int = 4
    max_k: int = 6
    min_span: float = 1.0
    min_gain: float = 4.0
    min_gap: float = 0.005
    max_rate_spread: float = 0.25


def _line(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(rate, residual sum, share explained) of the line of y on t; a flat one without spread of t."""
    y, t = y[np.isfinite(y)], t[np.isfinite(y)]
    tss = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
    stt = float(((t - t.mean()) ** 2).sum()) if len(t) else 0.0
    if stt < 1e-12:
        return 0.0, tss, 0.0
    b = float(((t - t.mean()) * (y - y.mean())).sum() / stt)
    return b, max(tss - b * b * stt, 0.0), b * b * stt / tss if tss > 0 else 0.0


def split_community(t: np.ndarray, d: np.ndarray, depth: int, parent: tuple[float, float] | None, rules: SplitRules) -> tuple[np.ndarray, str]:
    """(labels, why): the clusters of one community, -1 for taxa of clusters under min_leaf, or all 0 and the rule that stopped it.

    Clusters are those of the affinity's leading vectors, as many as give the least AICc of one clock per cluster.
    Rules in order: depth, size, span of the dates, gain in AICc over a single clock, gap in the spectrum, fewer than two clusters
    of min_leaf, and clusters that tick alike though the parent's clock was a good one (r2 over 0.2)."""
    n = len(t)
    whole = np.zeros(n, int)
    if depth >= rules.max_depth:
        return whole, "max_depth"
    if n < 2 * rules.min_leaf:
        return whole, "min_leaf"
    if np.ptp(t) < rules.min_span:
        return whole, "min_span"
    full = filled(d)
    w = np.exp(-(full**2) / (2 * kn.adaptive_sigma(full) ** 2))
    most = min(rules.max_k, max(2, n // rules.min_leaf))

    def clocks(label: np.ndarray) -> list[tuple[float, float, float]]:
        out = []
        for c in np.unique(label):
            at = np.flatnonzero(label == c)
            out.append(_line(t[at], d[at[t[at].argmin()], at]))
        return out

    tried = {k: kn.clusters_of(w, k) for k in range(1, most + 1)}
    score = {k: kn.aicc(sum(x[1] for x in clocks(label)), n, 3 * k) for k, label in tried.items()}
    best = min(score, key=lambda k: (score[k], k))
    gain = score[1] - score[best]
    if best == 1 or gain < rules.min_gain:
        return whole, "no_gain"
    gaps = np.diff(np.linalg.eigvalsh(kn.normalised_laplacian(w))[: most + 1])
    if gaps.max(initial=0.0) < rules.min_gap and gain < 100:
        return whole, "no_gap"
    label = tried[best].copy()
    names, size = np.unique(label, return_counts=True)
    kept = names[size >= rules.min_leaf]
    if len(kept) < 2:
        return whole, "small_clusters"
    rates = [_line(t[label == c], d[np.flatnonzero(label == c)[t[label == c].argmin()], label == c])[0] for c in kept]
    if parent is not None and parent[1] > 0.2 and min(rates) > 0 and (max(rates) - min(rates)) / max(rates) < rules.max_rate_spread:
        return whole, "alike"
    label[~np.isin(label, kept)] = -1
    return label, "split"


def deconvolve(df: DataFrame, group: str, rules: SplitRules | None = None, most: int = MOST) -> DataFrame:
    """taxon, path, why for every taxon with a sequence and a date: the community it ends in (the group, then the numbers of the clusters
    from level to level) and what stopped there; taxa set aside as outliers of a split have the path of the community split and why
    `outlier`.

    A level is one grouped kernel over the communities still open; levels end with the rules' depth at the latest. A community is one
    task's matrix, so groups over `most` taxa are an error, as in per_group."""
    rules = rules or SplitRules()
    kind = dict(df.dtypes)["taxon"]
    now = stored(df.where(F.col("seq").isNotNull() & F.col("date").isNotNull()).select("taxon", "date", "seq", F.col(group).cast("string").alias("path"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("r2")))
    done: list[DataFrame] = []

    def at(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def level(f: pd.DataFrame) -> pd.DataFrame:
            if len(f) > most:
                raise ValueError(f"a community has more than {most} taxa")
            f = f.sort_values("taxon").reset_index(drop=True)
            t, d = f["date"].to_numpy(float), distance_matrix(f["seq"].tolist())
            up = None if np.isnan(f["rate"].iloc[0] if f["rate"].iloc[0] is not None else np.nan) else (f["rate"].iloc[0], f["r2"].iloc[0])
            label, why = split_community(t, d, depth, up, rules)
            rate, _, r2 = _line(t, d[int(t.argmin())])
            path = f["path"].iloc[0]
            f["why"] = [why if why != "split" else "outlier" if x < 0 else "split" for x in label]
            f["path"] = [f"{path}/{x}" if why == "split" and x >= 0 else path for x in label]
            return f.assign(rate=rate, r2=r2)[["taxon", "date", "seq", "path", "rate", "r2", "why"]]

        return level

    for depth in range(rules.max_depth + 1):
        got = stored(now.groupBy("path").applyInPandas(at(depth), f"taxon {kind}, date double, seq string, path string, rate double, r2 double, why string"))
        done.append(got.where("why <> 'split'").select("taxon", "path", "why"))
        now = got.where("why = 'split'").drop("why")
        if now.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


SCHEMAS = {
    clock_models: "model string, rss double, aicc double, rate double, origin double, detail double",
    bootstrap_origin: "low double, high double",
    community: "n long, n_eff double, rate double, se double, r2 double, origin double, low double, high double, state string, tier string",
    coordinates: "taxon long, x0 double, x1 double, x2 double, x3 double",
    metric_report: "negative double, dims90 long, fit double",
    clusters: "taxon long, cluster long",
    leaders: "taxon long, bin long",
    landmarks: "taxon long, pick long",
    joined_tree: "newick string, tips long, height double, rate double",
}


def permutation_excess(edges: DataFrame, labels: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """a, b, observed, mean, sd, z, p, prior, bayes_factor for pairs of labels: how often linked nodes carry them, against label
    shuffles. labels: node, label. A shuffle is an order by hash(seed, replicate, node), so it is the same on every run; all
    replicates go through one plan, their counts are summed before anything is compared. p = (reached + 1) / (times + 1)."""
    n = running_sums(labels.select("node", "label"), [], ["node"], {"at": F.lit(1)})
    reps = labels.select("node", F.explode(F.sequence(F.lit(0), F.lit(times))).alias("rep"))
    # replicate 0 keeps its labels
    reps = reps.withColumn("key", F.when(F.col("rep") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "rep", "node")))
    order = running_sums(reps, ["rep"], ["key", "node"], {"at": F.lit(1)})
    moved = order.select("rep", "node", "at_run").join(n.select("at_run", "label"), "at_run").select("rep", "node", "label")
    e = edges.select("i", "j")
    x = e.join(moved.select("rep", F.col("node").alias("i"), F.col("label").alias("li")), "i").join(moved.select(F.col("rep").alias("r2"), F.col("node").alias("j"), F.col("label").alias("lj")), "j").where("rep = r2")
    c = x.groupBy("rep", F.least("li", "lj").alias("a"), F.greatest("li", "lj").alias("b")).agg(F.count("*").alias("n"))
    obs = c.where("rep = 0").select("a", "b", F.col("n").alias("observed"))
    got = obs.join(c.where("rep > 0"), ["a", "b"], "left").groupBy("a", "b", "observed").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.coalesce(F.count_if(F.col("n") >= F.col("observed")), F.lit(0)).alias("reached"))
    mean = F.coalesce(F.col("s"), F.lit(0)) / times
    sd = F.sqrt(F.greatest(F.coalesce(F.col("ss"), F.lit(0)) / times - mean * mean, F.lit(0.0)))
    kinds = labels.agg(F.countDistinct("label").alias("k"))
    got = got.withColumn("mean", mean).withColumn("sd", sd).join(F.broadcast(kinds))
    p = (F.col("reached") + 1) / (times + 1)
    post = F.greatest(F.lit(0.01), F.least(F.lit(0.99), 1 - p))
    q = F.least(F.lit(0.99), 2 / F.col("k"))
    return got.select("a", "b", "observed", "mean", "sd", ((F.col("observed") - F.col("mean")) / (F.col("sd") + 1e-8)).alias("z"), p.alias("p"), q.alias("prior"), ((post / (1 - post)) / (q / (1 - q))).alias("bayes_factor"))
