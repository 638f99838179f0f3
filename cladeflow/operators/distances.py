"""Distances between aligned taxa, by blocks of taxa.

Every distance follows from how often each pair of letter codes meets at a site. Taxa
are cut into blocks; a task takes two blocks and gets those counts for all its pairs
as matrix products, so a pair costs no row of sites and only pairs that pass the
threshold leave the task. Unscored distances are null, never zero or NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladeflow.functions.sequences import CODE_ORDER, IUPAC

_BASES = [[("ACGT".index(b)) for b in IUPAC[c]] if c in IUPAC else [] for c in CODE_ORDER]
_NUMBER = np.full(256, len(CODE_ORDER) - 1, np.uint8)
for _i, _c in enumerate(CODE_ORDER):
    _NUMBER[ord(_c)] = _NUMBER[ord(_c.lower())] = _i


def code_matrix(seqs: list[str]) -> np.ndarray:
    """Taxa by sites as numbers in CODE_ORDER; short sequences end in gaps."""
    width = max((len(s) for s in seqs), default=0)
    out = np.full((len(seqs), width), len(CODE_ORDER) - 1, np.uint8)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = _NUMBER[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return out


def meeting_counts(a: np.ndarray, b: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(code, code) -> pairs of rows by the number of sites where those codes meet; only codes that occur."""
    hot = lambda m: {c: (m == c).astype(np.float32) for c in np.unique(m).tolist()}
    ha, hb = hot(a), hot(b)
    return {(i, j): x @ y.T for i, x in ha.items() for j, y in hb.items()}


def resolved_counts(meets: dict[tuple[int, int], np.ndarray], mode: str = "resolve") -> np.ndarray:
    """4 x 4 base counts per pair from code counts. One ambiguous code against a base it
    contains agrees with it (`resolve`) or is spread over its bases (`average`); `skip` drops
    ambiguous codes; two ambiguous codes share their common bases, else their product. Gaps are left out
    (`gapmm`: a single gap counts as N)."""
    first = next(iter(meets.values()))
    out = np.zeros((4, 4, *first.shape))
    gap, any_base = len(CODE_ORDER) - 1, CODE_ORDER.index("N")
    for (i, j), n in meets.items():
        if mode == "gapmm" and (i == gap) != (j == gap):
            i, j = (any_base if i == gap else i), (any_base if j == gap else j)
        x, y = _BASES[i], _BASES[j]
        if not x or not y or (mode == "skip" and len(x) + len(y) > 2):
            continue
        merge = mode in ("resolve", "gapmm") and len(x) + len(y) > 2
        shared = [k for k in x if k in y]
        if merge and shared:
            for k in shared:
                out[k, k] += n / len(shared)
        else:
            for p in x:
                for q in y:
                    out[p, q] += n / (len(x) * len(y))
    return out


def _purines(n: np.ndarray):
    total = n.sum(axis=(0, 1))
    safe = np.maximum(total, 1e-300)
    ag, ct = (n[0, 2] + n[2, 0]) / safe, (n[1, 3] + n[3, 1]) / safe
    same = sum(n[k, k] for k in range(4)) / safe
    return total, safe, ag, ct, 1 - same - ag - ct


def _tn93(f: np.ndarray, ag, ct, tv):
    a, c, g, t = f
    r, y = a + g, c + t
    with np.errstate(all="ignore"):
        k1, k2 = 2 * a * g / r, 2 * c * t / y
        k3 = 2 * (r * y - a * g * y / r - c * t * r / y)
        args = 1 - ag / k1 - tv / (2 * r), 1 - ct / k2 - tv / (2 * y), 1 - tv / (2 * r * y)
        return -k1 * np.log(args[0]) - k2 * np.log(args[1]) - k3 * np.log(args[2]), args


def tamura_nei(n: np.ndarray, least: float = 0) -> np.ndarray:
    """Fractional counts; frequencies of the pair; Kimura's distance if a base is
    missing; 1000 where saturated; NaN with `least` sites or fewer."""
    total, safe, ag, ct, tv = _purines(n)
    f = (n.sum(axis=1) + n.sum(axis=0)) / (2 * safe)
    d, args = _tn93(f, ag, ct, tv)
    with np.errstate(all="ignore"):
        k2p = -0.5 * np.log(1 - 2 * (ag + ct) - tv) - 0.25 * np.log(1 - 2 * tv)
    d = np.where((f <= 0).any(axis=0), k2p, d)
    d = np.where(np.isfinite(d), np.maximum(d, 0), 1000.0)
    return np.where(total > least, d, np.nan)


def tamura_nei_masks(meets: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """Codes as base sets: sites agree if the sets meet; frequencies from all bases in
    either set, at least 1e-4; the share of differing sites where the formula fails."""
    first = next(iter(meets.values()))
    p1, p2, q, total = (np.zeros(first.shape) for _ in range(4))
    base = np.zeros((4, *first.shape))
    for (i, j), n in meets.items():
        x, y = (set(_BASES[k]) if len(_BASES[k]) < 4 else set() for k in (i, j))
        if not x or not y:
            continue
        total += n
        for s in (x, y):
            for k in s:
                base[k] += n
        if not x & y:
            both = x | y
            if both <= {0, 2}:
                p1 += n
            elif both <= {1, 3}:
                p2 += n
            else:
                q += n
    safe = np.maximum(total, 1e-300)
    f = np.maximum(base / np.maximum(base.sum(axis=0), 1e-300), 1e-4)
    p = (p1 + p2 + q) / safe
    d, args = _tn93(f, p1 / safe, p2 / safe, q / safe)
    bad = np.any([~(a > 1e-6) for a in args], axis=0) | ~np.isfinite(d) | (d < 0)
    d = np.where(p == 0, 0.0, np.where(bad, p, d))
    return np.where(total > 0, d, np.nan)


def tamura_nei_screen(n: np.ndarray, least: float = 50) -> np.ndarray:
    """Plain bases only, at least `least` shared sites; the share of differing sites where the formula fails; never below zero."""
    total, safe, ag, ct, tv = _purines(n)
    f = np.maximum((n.sum(axis=1) + n.sum(axis=0)) / (2 * safe), 1e-4)
    d, args = _tn93(f, ag, ct, tv)
    bad = np.any([~(a > 0) for a in args], axis=0) | ~np.isfinite(d)
    return np.where(total >= least, np.maximum(np.where(bad, ag + ct + tv, d), 0), np.nan)


def share_differing(n: np.ndarray) -> np.ndarray:
    """Differing sites over sites valid in both; 1 where there are none."""
    total, safe, ag, ct, tv = _purines(n)
    return np.where(total > 0, ag + ct + tv, 1.0)


KERNELS: dict[str, Callable] = {
    "hamming": lambda m: share_differing(resolved_counts(m, "skip")),
    "tn93": lambda m: tamura_nei(resolved_counts(m, "resolve")),
    "tn93_average": lambda m: tamura_nei(resolved_counts(m, "average")),
    "tn93_masks": tamura_nei_masks,
    "tn93_screen": lambda m: tamura_nei_screen(resolved_counts(m, "skip")),
    "overlap": lambda m: resolved_counts(m, "skip").sum(axis=(0, 1)),
}


def pair_blocks(seqs: DataFrame, taxon: str, seq: str, kernels: list[str], reduce: Callable, schema: str, group: str | None = None, keep: tuple[str, ...] = (), block: int = 512) -> DataFrame:
    """What `reduce` makes of every block of pairs: it gets the rows of both sides (t and keep), the distances by kernel and which
    pairs count, and returns rows of `schema`. With `group` only pairs inside a group are formed; null groups are left out.

    Taxa are cut into blocks of about `block`, by group; each is sent once per block it meets, and a task's memory is set by
    `block` alone. Rows with a null sequence are left out."""
    rows = seqs.select(F.col(taxon).cast("long").alias("t"), F.col(seq).alias("s"), *([F.col(group).alias("g")] if group else [F.lit(0).alias("g")]), *keep).where("t is not null and s is not null and g is not null")
    sizes = rows.groupBy(F.col("g").alias("__g")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    rows = rows.join(sizes, F.col("g") == F.col("__g")).withColumn("b", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    cells = rows.select("g", "t", "s", *keep, "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("g", "t", "s", *keep, "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        f = f.sort_values("t")
        left, right = (f["b"] == lo).to_numpy(), (f["b"] == hi).to_numpy()
        codes = code_matrix(f["s"].tolist())
        if not left.any() or not right.any() or not codes.shape[1]:
            return reduce(f[left], f[right], {k: np.full((left.sum(), right.sum()), np.nan) for k in kernels}, np.zeros((left.sum(), right.sum()), bool))
        meets = meeting_counts(codes[left], codes[right])
        t = f["t"].to_numpy()
        ok = t[left][:, None] < t[right][None, :] if lo == hi else np.ones((left.sum(), right.sum()), bool)
        return reduce(f[left], f[right], {k: KERNELS[k](meets) for k in kernels}, ok)

    return cells.groupBy("g", "lo", "hi").applyInPandas(work, schema)


def pair_distances(seqs: DataFrame, taxon: str, seq: str, kernels: list[str], most: float | None = None, block: int = 512) -> DataFrame:
    """i, j (i < j) and one column per kernel; only pairs whose first distance is at most
    `most`, if given. taxon is a unique number. Rows with a null sequence are left out."""

    def rows(left: pd.DataFrame, right: pd.DataFrame, d: dict[str, np.ndarray], ok: np.ndarray) -> pd.DataFrame:
        if most is not None:
            ok = ok & (d[kernels[0]] <= most)
        x, y = np.nonzero(ok)
        i, j = left["t"].to_numpy()[x], right["t"].to_numpy()[y]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), **{k: pd.array(np.where(np.isnan(v[x, y]), None, v[x, y]), dtype="Float64") for k, v in d.items()}})

    return pair_blocks(seqs, taxon, seq, kernels, rows, "i long, j long, " + ", ".join(f"{k} double" for k in kernels), block=block)


def pair_sums(seqs: DataFrame, taxon: str, seq: str, kernel: str, values: dict[str, Callable[[np.ndarray], np.ndarray]], label: str, within: bool = False, block: int = 512) -> DataFrame:
    """same, pairs and, per entry of values, the sum of that function of the distance over all pairs, by whether both taxa have
    one label (or, within: label and sums over the pairs inside each label, no others being formed). Only sums leave a
    task. Pairs without a distance are not counted."""

    def sums(left: pd.DataFrame, right: pd.DataFrame, d: dict[str, np.ndarray], ok: np.ndarray) -> pd.DataFrame:
        v = d[kernel]
        ok = ok & ~np.isnan(v)
        same = left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]
        got = {n: f(np.where(np.isnan(v), 0.0, v)) for n, f in values.items()}
        out = [{"same": flag, "pairs": int((ok & (same == flag)).sum()), **{n: float(x[ok & (same == flag)].sum()) for n, x in got.items()}} for flag in (True, False)]
        out = pd.DataFrame([x for x in out if x["pairs"]], columns=["same", "pairs", *values])
        if within:
            out.insert(0, "label", left["label"].iloc[0] if len(left) else None)
        return out

    kind = dict(seqs.dtypes)[label]
    x = seqs.withColumn("label", F.col(label))
    rows = pair_blocks(x, taxon, seq, [kernel], sums, (f"label {kind}, " if within else "") + "same boolean, pairs long, " + ", ".join(f"{n} double" for n in values), group="label" if within else None, keep=("label",), block=block)
    return rows.groupBy("label" if within else "same").agg(F.sum("pairs").alias("pairs"), *(F.sum(n).alias(n) for n in values))


def imputed(pairs: DataFrame, d: str) -> DataFrame:
    """Unscored distances as the largest observed, at least 1."""
    top = pairs.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(d), F.lit(1.0))).alias("__m"))
    # one row
    return pairs.join(F.broadcast(top)).withColumn(d, F.coalesce(d, "__m")).drop("__m")


def cosine_edges(vectors: DataFrame, key: str, vec: str, least: float, block: int = 512) -> DataFrame:
    """i, j, similarity of the pairs with a cosine of at least `least`, by blocks; null and zero vectors are in no pair."""
    rows = vectors.select(F.col(key).cast("long").alias("t"), F.col(vec).alias("v")).where("t is not null and v is not null")
    blocks = max(1, -(-rows.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int"))
    cells = rows.select("t", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select("t", "v", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(f["v"].to_list()).astype(float)
        norm = np.sqrt((m * m).sum(axis=1))
        m = np.divide(m, norm[:, None], where=norm[:, None] > 0, out=np.zeros_like(m))
        t, b = f["t"].to_numpy(), f["b"].to_numpy()
        a, c = np.flatnonzero(b == key[0]), np.flatnonzero(b == key[1])
        sim = m[a] @ m[c].T
        ok = (sim >= least) & (norm[a] > 0)[:, None] & (norm[c] > 0)[None, :]
        if key[0] == key[1]:
            ok &= t[a][:, None] < t[c][None, :]
        x, y = np.nonzero(ok)
        i, j = t[a][x], t[c][y]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "similarity": sim[x, y]})

    return cells.groupBy("lo", "hi").applyInPandas(work, "i long, j long, similarity double")


def nearest_anchor(queries: DataFrame, anchors: DataFrame, taxon: str, seq: str, limit: int = 4096) -> DataFrame:
    """query, anchor, distance: the anchor at the least screening distance of each query (ties:
    least anchor), null if none can be scored. Anchors are a model's fixed set; more than `limit`
    of them are an error, because they go to every task. Works on streams too."""
    rows = anchors.select(F.col(taxon).cast("long").alias("t"), F.col(seq).alias("s")).where("s is not null").orderBy("t").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} anchors")
    ids, codes = np.array([r["t"] for r in rows], np.int64), code_matrix([r["s"] for r in rows])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q = code_matrix([x or "" for x in f["s"]])
            w = max(q.shape[1], codes.shape[1])
            pad = lambda m: np.pad(m, ((0, 0), (0, w - m.shape[1])), constant_values=len(CODE_ORDER) - 1)
            if not len(f) or not len(ids):
                yield pd.DataFrame({"query": f["t"], "anchor": pd.array([None] * len(f), "Int64"), "distance": pd.array([None] * len(f), "Float64")})
                continue
            d = KERNELS["tn93_screen"](meeting_counts(pad(q), pad(codes)))
            d = np.where(np.isnan(d), np.inf, d)
            k = d.argmin(axis=1)
            best = d[np.arange(len(k)), k]
            none = np.isinf(best)
            yield pd.DataFrame({"query": f["t"], "anchor": pd.array(np.where(none, None, ids[k]), "Int64"), "distance": pd.array(np.where(none, None, best), "Float64")})

    return queries.select(F.col(taxon).cast("long").alias("t"), F.col(seq).alias("s")).mapInPandas(work, "query long, anchor long, distance double")


def anchor_evidence(records: DataFrame, anchors: DataFrame, taxon: str, seq: str, date: str, limit: int = 4096, block: int = 256) -> DataFrame:
    """records plus nn_anchor, nn, nn_date (the nearest anchor, its screening distance and date) and
    left_d, right_d, halves_differ, halves_gap: how much farther the nearest anchor of the other half
    is in the left and in the right half, whether the two anchors differ, and the years between them.

    Distances that cannot be scored count as 1; ties go to the least anchor; a record that is
    an anchor itself finds itself. Anchors as in nearest_anchor; those without a date or sequence are left
    out. A task holds the distances of `block` records at a time. Works on streams too."""
    rows = anchors.select(F.col(taxon).cast("long").alias("t"), F.col(seq).alias("s"), F.col(date).cast("double").alias("d")).where("s is not null and d is not null").orderBy("t").limit(limit + 1).collect()
    if not rows:
        raise ValueError("no dated anchors")
    if len(rows) > limit:
        raise ValueError(f"more than {limit} anchors")
    ids, dates, codes = np.array([r["t"] for r in rows], np.int64), np.array([r["d"] for r in rows]), code_matrix([r["s"] for r in rows])
    width = codes.shape[1]

    def to_anchors(q: np.ndarray, a: np.ndarray) -> np.ndarray:
        d = KERNELS["tn93_screen"](meeting_counts(q, a)) if a.shape[1] else np.full((len(q), len(a)), np.nan)
        return np.where(np.isnan(d), 1.0, d)

    def evidence(seqs: list[str | None]) -> list[np.ndarray]:
        q = code_matrix([(x or "")[:width] for x in seqs])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])), constant_values=len(CODE_ORDER) - 1)
        at, half = np.arange(len(q)), width // 2
        whole, left, right = to_anchors(q, codes), to_anchors(q[:, :half], codes[:, :half]), to_anchors(q[:, half:], codes[:, half:])
        k, kl, kr = (m.argmin(axis=1) for m in (whole, left, right))
        return [ids[k], whole[at, k], dates[k], left[at, kr] - left[at, kl], right[at, kl] - right[at, kr], kl != kr, np.abs(dates[kl] - dates[kr])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, block):
                part = b.slice(k, block)
                got = evidence(part.column(seq).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, got)], [*part.schema.names, *EVIDENCE])

    kinds = ", ".join(f"{n} {k}" for n, k in EVIDENCE.items())
    return records.mapInArrow(work, StructType([*records.schema.fields, *StructType.fromDDL(kinds).fields]))


#: what anchor_evidence adds
EVIDENCE = {"nn_anchor": "long", "nn": "double", "nn_date": "double", "left_d": "double", "right_d": "double", "halves_differ": "boolean", "halves_gap": "double"}


def affinity(d: Column, sigma: Column) -> Column:
    """Radial basis affinity of a distance."""
    return F.exp(-(d * d) / (2 * sigma * sigma))
