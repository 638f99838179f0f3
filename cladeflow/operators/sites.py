"""Per-site scores, in-silico mutants, error patches and codon threading.

No trained weights are available here: a site scorer is an interface, and the one that
comes with it is a plain entropy score, named as such; it stands in for no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cladeflow.functions.sequences import CODON_AMINO, COMPLEMENT
from cladeflow.operators.alignments import merge_intervals
from cladeflow.operators.kernels import affine_align_many


class SiteScorer(Protocol):
    """Scores sites from their state frequencies (sites x states); weights come with the object."""

    def score(self, frequencies: np.ndarray) -> np.ndarray: ...


class EntropyScorer:
    """Deterministic stand-in without weights: the entropy of the states, in nats."""

    def score(self, frequencies: np.ndarray) -> np.ndarray:
        f = frequencies / np.maximum(frequencies.sum(axis=1, keepdims=True), 1e-300)
        return -(f * np.log(np.maximum(f, 1e-300))).sum(axis=1)


def _profiles(sites: DataFrame, states: str) -> DataFrame:
    return sites.groupBy("site").agg(*(F.sum(F.when(F.col("state") == x, 1.0).otherwise(0.0)).alias(f"s{k}") for k, x in enumerate(states)))


def site_scores(sites: DataFrame, scorer: SiteScorer | None = None, states: str = "ACGT") -> DataFrame:
    """site, score: variable sites through the scorer, 0 for invariable ones; sites go in Arrow batches."""
    scorer = scorer or EntropyScorer()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = f.drop(columns="site").to_numpy(float)
            out = np.zeros(len(f))
            var = (m > 0).sum(axis=1) > 1
            if var.any():
                out[var] = scorer.score(m[var])
            yield pd.DataFrame({"site": f["site"], "score": out})

    return _profiles(sites, states).mapInPandas(work, "site int, score double")


def mutant_scan(sites: DataFrame, scorer: SiteScorer | None = None, states: str = "ACGT") -> DataFrame:
    """site, state, shift: the change of a site's score if one taxon with the consensus had `state` instead."""
    scorer = scorer or EntropyScorer()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = f.drop(columns="site").to_numpy(float)
            base = scorer.score(m) if len(m) else np.zeros(0)
            top = m.argmax(axis=1)
            out = []
            for k, x in enumerate(states):
                new = m.copy()
                new[np.arange(len(m)), top] -= 1
                new[:, k] += 1
                ok = top != k
                out.append(pd.DataFrame({"site": f["site"][ok], "state": x, "shift": (scorer.score(new) - base)[ok]}))
            yield pd.concat(out)

    return _profiles(sites, states).mapInPandas(work, "site int, state string, shift double")


@F.pandas_udf(DoubleType())
def _hypergeom_tail(k: pd.Series, n: pd.Series, bad: pd.Series, size: pd.Series) -> pd.Series:
    """P(at least k marked among n drawn of size with bad marked)."""
    top = int(size.max()) + 1 if len(size) else 1
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, top + 1)))]
    comb = lambda a, b: lf[a] - lf[b] - lf[a - b]
    out = []
    for x, m, b, s in zip(*(c.astype(int) for c in (k, n, bad, size)), strict=True):
        i = np.arange(x, min(m, b) + 1)
        i = i[m - i <= s - b]
        out.append(float(np.exp(comb(b, i) + comb(s - b, m - i) - comb(s, m)).sum()) if len(i) else 0.0)
    return pd.Series(out, dtype=float)


def patches(sites: DataFrame, window: int = 10, alpha: float = 1e-4) -> DataFrame:
    """taxon, first, last, parts: windows of sites in which a taxon differs from the consensus more than its overall rate explains
    (hypergeometric tail at most alpha), overlapping windows merged."""
    from cladeflow.operators.alignments import consensus

    c = consensus(sites, F.lit(True)).select("site", F.col("state").alias("c"))
    x = sites.join(c, "site").select("taxon", "site", (F.col("state") != F.col("c")).cast("int").alias("bad"))
    by = Window.partitionBy("taxon").orderBy("site").rangeBetween(0, window - 1)
    whole = Window.partitionBy("taxon")
    w = x.select("taxon", F.col("site").alias("first"), F.sum("bad").over(by).alias("k"), F.count("*").over(by).alias("n"), F.sum("bad").over(whole).alias("b"), F.count("*").over(whole).alias("size"))
    hits = w.where("k >= 3").withColumn("p", _hypergeom_tail("k", "n", "b", "size")).where(F.col("p") <= alpha)
    return merge_intervals(hits.select("taxon", "first", (F.col("first") + window - 1).alias("last")), ["taxon"], "first", "last")


def _amino(seq: str) -> str:
    return "".join(CODON_AMINO.get(seq[i : i + 3], "X") for i in range(0, len(seq) - 2, 3))


#: fixed values: scores of the reference alignment, letters a record needs, stops a frame may have and what one costs
MATCH, MISMATCH, GAP_OPEN, GAP_MORE = 2.0, -1.0, -10.0, -1.0
LEAST_LETTERS, MOST_STOPS, STOP_COST = 30, 3, 15.0
#: records whose frames are scored together
_LOT = 64
_FLIP = str.maketrans(*COMPLEMENT)


def codon_threads(records: DataFrame, key: str, seq: str, reference: str) -> DataFrame:
    """key, strand, frame, stops, placed, score, seq: each record threaded onto the reference's codons.

    Each of six strand-frames is translated and aligned to the reference protein by affine-gap dynamic programming (gaps -10 and
    -1); frames with more than three stops before the last codon are no candidates, each stop costs 15. The best frame, the
    first of equals, is placed codon by codon, gaps elsewhere. Records of fewer than 30 letters, or whose best score is
    negative, have null strand and seq."""
    ref = reference.upper().replace("U", "T").replace("-", "").replace(".", "").strip()
    protein = _amino(ref)
    nothing = (None, None, None, 0, None, None)
    coded = lambda x: np.frombuffer(x.encode("ascii"), np.uint8).astype(np.int32)
    goal = coded(protein)

    def thread(given: list[str | None]) -> list[tuple]:
        """Records of one lot: the frames of all are scored at once, then the best of each is traced."""
        tried = []
        for k, s in enumerate(given):
            s = "".join((s or "").upper().replace("U", "T").replace("-", "").replace(".", "").split())
            for strand, text in ((1, s), (-1, s.translate(_FLIP)[::-1])) if len(s) >= LEAST_LETTERS and protein else ():
                for f in range(3):
                    p = _amino(text[f:])
                    stops = p[:-1].count("*")
                    if 3 * len(p) >= LEAST_LETTERS and stops <= MOST_STOPS:
                        tried.append((k, strand, f, text[f:], stops, coded(p)))
        score, _ = affine_align_many([x[-1] for x in tried], goal, MATCH, MISMATCH, GAP_OPEN, GAP_MORE, paths=False)
        best: dict[int, int] = {}
        for n, (k, _, _, _, stops, _) in enumerate(tried):
            score[n] -= STOP_COST * stops
            if k not in best or score[n] > score[best[k]]:
                best[k] = n
        out = [nothing] * len(given)
        for k, n in best.items():
            out[k] = (*nothing[:4], float(score[n]), None)
        chosen = [n for n in best.values() if score[n] >= 0]
        _, paths = affine_align_many([tried[n][-1] for n in chosen], goal, MATCH, MISMATCH, GAP_OPEN, GAP_MORE, paths=True)
        for n, pairs in zip(chosen, paths, strict=True):
            k, strand, f, text, stops, _ = tried[n]
            codons = ["---"] * len(protein)
            for i, j in pairs:
                codons[j] = text[3 * i : 3 * i + 3]
            out[k] = (strand, f, stops, len(pairs), float(score[n]), "".join(codons))
        return out

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = pd.DataFrame([x for i in range(0, len(f), _LOT) for x in thread(f["s"].iloc[i : i + _LOT].tolist())], columns=["strand", "frame", "stops", "placed", "score", "seq"])
            rows.insert(0, "key", f["key"].to_numpy())
            yield rows.astype({c: "Int64" for c in ("strand", "frame", "stops", "placed")} | {"score": "Float64"})

    return records.select(F.col(key).alias("key"), F.col(seq).alias("s")).mapInPandas(work, f"key {dict(records.dtypes)[key]}, strand int, frame int, stops int, placed int, score double, seq string")
