"""Problem 3: the N best items of every group, by merging sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.session import counted, shuffle_parts, stored

RUN = "bucket int, run long, grp array<long>, score array<double>, tie array<double>, item array<long>"
_ARROW = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("grp", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())), ("tie", pa.list_(pa.float64())), ("item", pa.list_(pa.int64()))])


class LoserTree:
    """Tournament over k run heads: inner nodes keep the loser, node 0 the winner, so
    a new head is replayed against the log2 k losers on its path only."""

    def __init__(self, heads: list):
        self.heads = heads
        k = self.k = max(1, len(heads))
        self.node = [0] * k
        win = [0] * k + list(range(k))
        for i in range(k - 1, 0, -1):
            a, b = win[2 * i], win[2 * i + 1]
            win[i], self.node[i] = (a, b) if self._before(a, b) else (b, a)
        self.node[0] = win[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and x <= y

    def winner(self) -> int:
        return self.node[0]

    def replace(self, head) -> None:
        """The winner's run shows its next head (None: it has ended)."""
        w = self.node[0]
        self.heads[w] = head
        i = (w + self.k) // 2
        while i:
            if self._before(self.node[i], w):
                self.node[i], w = w, self.node[i]
            i //= 2
        self.node[0] = w


def _order(grp: np.ndarray, score: np.ndarray, tie: np.ndarray, item: np.ndarray) -> np.ndarray:
    return np.lexsort((item, tie, np.isnan(tie), -score, grp))


def _kept(cols: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Sorted by group and rank, the first n rows of each group."""
    at = _order(*cols)
    cols = [c[at] for c in cols]
    g = cols[0]
    if not len(g):
        return cols
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return [c[rank < n] for c in cols]


def _bucket(grp: np.ndarray, buckets: int) -> np.ndarray:
    h = grp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _packed(cols: list[np.ndarray], buckets: int, run: int) -> Iterator[pa.RecordBatch]:
    """One row per bucket: the run's columns, ordered by group and score."""
    b = _bucket(cols[0], buckets)
    at = np.argsort(b, kind="stable")
    b, cols = b[at], [c[at] for c in cols]
    if not len(b):
        return
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    offsets = pa.array(np.r_[first, len(b)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in cols]
    yield pa.RecordBatch.from_arrays([pa.array(b[first]), pa.array(np.full(len(first), run, np.int64)), *lists], schema=_ARROW)


def _merge(runs: list[list[list]], n: int) -> list[list]:
    """Multiway merge; once a group has n outputs every run seeks to its next group."""
    def head(r: int):
        i = pos[r]
        grp, score, tie, item = runs[r]
        if i >= len(grp):
            return None
        t = tie[i]
        missing = t != t
        return grp[i], -score[i], missing, 0.0 if missing else t, item[i], r

    pos = [0] * len(runs)
    after = []  # for each run, position -> start of the next group
    for grp, *_ in runs:
        g = np.asarray(grp)
        last = np.r_[np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        after.append(np.repeat(last, np.diff(np.r_[0, last])).tolist())
    tree = LoserTree([head(r) for r in range(len(runs))])
    out: list[list] = [[], [], [], []]
    now, count = None, 0
    while True:
        r = tree.winner()
        top = tree.heads[r]
        if top is None:
            return out
        i = pos[r]
        if top[0] != now:
            now, count = top[0], 0
        if count < n:
            for o, c in zip(out, runs[r], strict=True):
                o.append(c[i])
            count += 1
            pos[r] = i + 1
        else:
            pos[r] = after[r][i]
        tree.replace(head(r))


def sorted_runs(items: DataFrame, n: int, buckets: int, run_rows: int) -> DataFrame:
    """Every partition's rows as sorted runs, one packed row per run and bucket.

    A run never keeps more than n rows of a group, so a group that holds a third of all
    rows sends n rows per run; a run is closed at run_rows rows that are still needed.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 32, 0
        kept: list[np.ndarray] | None = None
        more: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            more.append([b.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate((np.int64, np.float64, np.float64, np.int64))])
            rows += b.num_rows
            if rows >= run_rows:
                kept = _kept([np.concatenate(c) for c in zip(*([kept] if kept else []), *more, strict=True)], n)
                more, rows = [], 0
                if len(kept[0]) >= run_rows:
                    yield from _packed(kept, buckets, base + k)
                    kept, k = None, k + 1
        if more or kept:
            yield from _packed(_kept([np.concatenate(c) for c in zip(*([kept] if kept else []), *more, strict=True)], n), buckets, base + k)

    return items.mapInArrow(work, RUN)


def _rebucketed(buckets: int):
    """Packed runs cut into more buckets, in place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cols = [b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("grp", "score", "tie", "item")]
                yield from _packed(cols, buckets, b.column("run")[r].as_py())

    return work


def top_n(df: DataFrame, group: str, score: str, tie: str, item: str, n: int = 10, buckets: int | None = None, run_rows: int = 200_000, fan_in: int = 256, bucket_rows: int = 200_000) -> DataFrame:
    """grp, rank, item, score, tie: the n rows of each group with the highest score, by
    tie ascending (null and NaN last), then item ascending. n or fewer rows: all.

    Rows with null group, null item or null or NaN score are left out. group and item
    are integers. Bucketed runs, each ordered by group and score, are stored in the
    shared folder; a task merges the runs of its bucket with a loser tree and seeks past
    the rest of a group after n outputs. If the rows that the runs kept are more than bucket_rows
    to a bucket, however many groups there are, the runs are first cut into more buckets, so a
    merge holds about bucket_rows rows. More than fan_in runs are merged in rounds,
    so a task reads at most fan_in runs, each with n rows at most of a hot group.
    """
    buckets = buckets or 4 * shuffle_parts(df.sparkSession)
    items = df.select(F.col(group).cast("long").alias("grp"), F.col(score).cast("double").alias("score"), F.col(tie).cast("double").alias("tie"), F.col(item).cast("long").alias("item"))
    items = items.where("grp is not null and item is not null and score is not null and not isnan(score)")
    runs, kept = counted(sorted_runs(items, n, buckets, run_rows), rows=F.size("grp"))
    if kept["rows"] > bucket_rows * buckets:
        runs = stored(runs.mapInArrow(_rebucketed(-(-kept["rows"] // bucket_rows)), RUN))

    def lists(t: pa.Table) -> list[list[list]]:
        return [[t.column(c)[r].values.to_pylist() for c in ("grp", "score", "tie", "item")] for r in range(t.num_rows)]

    def again(key: tuple, t: pa.Table) -> pa.Table:
        cols = [np.asarray(c, np.float64 if k in (1, 2) else np.int64) for k, c in enumerate(_merge(lists(t), n))]
        return pa.table([pa.array([x], f.type) if x is not None else None for x, f in zip((key[0].as_py(), key[1].as_py(), *(c.tolist() for c in cols)), _ARROW, strict=True)], schema=_ARROW)

    def last(t: pa.Table) -> pa.Table:
        g, s, x, i = _merge(lists(t), n)
        rank, seen = [], None
        for v in g:
            k = k + 1 if v == seen else 1
            seen = v
            rank.append(k)
        return pa.table({"grp": pa.array(g, pa.int64()), "rank": pa.array(rank, pa.int32()), "item": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64()), "tie": pa.array([None if v != v else v for v in x], pa.float64())})

    most = runs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    while most > fan_in:
        groups = -(-most // fan_in)
        lot = F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long")
        runs = stored(runs.withColumn("run", lot).groupBy("bucket", "run").applyInArrow(again, RUN))
        most = groups
    return runs.groupBy("bucket").applyInArrow(last, "grp long, rank int, item long, score double, tie double")


def latest(df: DataFrame, keys: list[str], when: str, values: list[str]) -> DataFrame:
    """For each key the values of the row with the latest `when` (null is earliest);
    exact copies count once, of different rows at the same time the largest counts."""
    best = F.max(F.struct(F.col(when), *(F.col(v) for v in values))).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__b.{v}").alias(v) for v in values))


