"""Problem 7: documents into containers of fixed capacity."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.session import parts_for, stored

PIECES = "spec_id int, capacity long, shard long, bin long, doc_id long, piece_no long, token_start long, tokens long, loose boolean"


def _best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the first packing that the search improves."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(gaps, (s, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > s:
            insort(gaps, (gap - s, b))
    return bins


def improve(sizes: np.ndarray, capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Local search: from the emptiest bin on, documents are moved into other bins,
    exchanged one for one, or two for one, whenever that raises the sum of squared
    fills; bins that run empty are closed. It ends at the lower bound of bins or when a
    pass over all bins that have room empties none."""
    where = np.empty(len(sizes), np.int64)
    for b, x in enumerate(bins):
        where[x] = b
    fill = np.bincount(where, sizes, minlength=len(bins)).astype(np.int64)
    held = [list(x) for x in bins]
    open_bins = len(bins)
    bound = -(-int(sizes.sum()) // capacity)

    def put(i: int, to: int) -> None:
        a = where[i]
        held[a].remove(i)
        held[to].append(i)
        fill[a] -= sizes[i]
        fill[to] += sizes[i]
        where[i] = to

    def step(a: int) -> bool:
        """The exchange that brings most from bin a into a bin at least as full."""
        room = capacity - fill
        takes = (room > 0) & (fill >= fill[a])
        takes[a] = False
        other = np.flatnonzero(takes[where])
        if not len(other):
            return False
        most = int(room[takes].max())
        o_size, o_room = sizes[other], room[where[other]]
        best, act = 0, None
        mine = sorted(held[a], key=lambda i: -sizes[i])
        for i in mine:
            s = int(sizes[i])
            if s <= best:
                break
            if s <= most:
                fits = np.flatnonzero(takes & (room >= s))
                return put(i, int(fits[np.argmin(room[fits])])) or True
            gain = s - o_size
            gain = np.where(gain <= o_room, gain, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, act = int(gain[k]), ((i,), int(other[k]))
                if best == most:
                    break
        if best < most and len(mine) > 1:
            for x, i in enumerate(mine[:-1]):
                for j in mine[x + 1 :]:
                    s = int(sizes[i] + sizes[j])
                    if s <= best:
                        break
                    gain = s - o_size
                    gain = np.where(gain <= o_room, gain, 0)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, act = int(gain[k]), ((i, j), int(other[k]))
        if act is None:
            return False
        give, back = act
        b = int(where[back])
        put(back, a)
        for i in give:
            put(i, b)
        return True

    emptied = True
    while emptied and open_bins > bound:
        emptied = False
        for a in np.argsort(fill, kind="stable").tolist():
            if not held[a] or fill[a] >= capacity:
                continue
            # every step takes at least one token out of the bin, so this ends
            while held[a] and step(a):
                pass
            if not held[a]:
                emptied, open_bins = True, open_bins - 1
                if open_bins <= bound:
                    break
    return [x for x in held if x]


def pack_shard(pdf: pd.DataFrame, loose_rows: int) -> pd.DataFrame:
    """One shard's pieces with their bins, the same in whatever order they come; the emptiest bins
    that have room, up to loose_rows pieces (but one bin at least, unless 0), are marked loose."""
    pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable", ignore_index=True)
    sizes = pdf["tokens"].to_numpy(np.int64)
    capacity = int(pdf["capacity"].iloc[0])
    bins = improve(sizes, capacity, _best_fit(sizes, capacity))
    number = np.empty(len(sizes), np.int64)
    for b, x in enumerate(bins):
        number[x] = b
    fill = np.bincount(number, sizes, minlength=len(bins))
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    held = np.cumsum(np.bincount(number, minlength=len(bins))[order])
    loose = np.zeros(len(bins), bool)
    if loose_rows:
        loose[order[: max(1, int((held <= loose_rows).sum()))]] = True
    return pdf.assign(bin=number, loose=loose[number])


def _packer(loose_rows: int):
    return lambda pdf: pack_shard(pdf, loose_rows)


def pack(docs: DataFrame, specs: DataFrame, shard_rows: int = 10_000, fan_in: int = 16) -> DataFrame:
    """spec_id, bin_id, doc_id, piece_no, token_start, tokens: every document with tokens
    in bins of each capacity.

    docs: doc_id (unique), tokens; specs: spec_id, capacity_tokens. A document is split
    only if larger than the capacity: into full pieces, each its own bin, and a rest that is
    packed like a document. Documents with null, zero or negative tokens and specs with null or
    non-positive capacity are left out. Pieces are packed in shards of about shard_rows by the hash of the document
    (the number of shards follows the number of documents), best fit first and then by
    local search. Then the emptiest bins of fan_in neighbouring shards are
    opened and packed together, and so on until one shard is left, so that space left over
    at the shards' ends is used. A shard opens bins of shard_rows / fan_in pieces in all, one
    bin at least, so a task holds about shard_rows pieces, or fan_in bins where single bins hold
    more pieces than that. The result does not depend on the order of the rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens")).where("tokens > 0")
    s = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0")
    specs_held = s.distinct().collect()
    d = stored(d)
    shards = parts_for(d.count(), shard_rows)
    cells = F.explode(F.array(*(F.struct(F.lit(r["spec_id"]).alias("spec_id"), F.lit(r["capacity"]).alias("capacity")) for r in specs_held))) if specs_held else None
    out_schema = "spec_id int, bin_id string, doc_id long, piece_no long, token_start long, tokens long"
    if cells is None:
        return docs.sparkSession.createDataFrame([], out_schema)
    each = d.select("doc_id", "tokens", cells.alias("c")).select("doc_id", "tokens", "c.*")
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("long")
    full = each.where("tokens >= capacity").select("spec_id", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece_no"))
    full = full.select("spec_id", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("bin_id"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("tokens"))
    rest = F.col("tokens") % F.col("capacity")
    items = each.where(rest > 0).select("spec_id", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.lit(None).cast("long").alias("bin"), "doc_id", whole.alias("piece_no"), (whole * F.col("capacity")).alias("token_start"), rest.alias("tokens"), F.lit(False).alias("loose"))
    done = [full]
    level = 0
    while True:
        last = shards <= 1
        packed = items.groupBy("spec_id", "shard").applyInPandas(_packer(0 if last else shard_rows // fan_in), PIECES)
        if not last:
            packed = stored(packed)
        bin_id = F.concat_ws("-", F.lit(f"l{level}"), "shard", "bin").alias("bin_id")
        done.append(packed.where(~F.col("loose")).select("spec_id", bin_id, "doc_id", "piece_no", "token_start", "tokens"))
        if last:
            return reduce(DataFrame.unionByName, done)
        shards = -(-shards // fan_in)
        items = packed.where("loose").withColumn("shard", F.floor(F.col("shard") / fan_in).cast("long"))
        level += 1
