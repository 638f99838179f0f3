"""Problem 5: near-duplicate sequences by banded MinHash and odd sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm.components import linked_groups
from cladeflow.session import stored

K = 16
#: MinHash samples of a record (one-permutation bins), of which the first
#: BANDS * ROWS make the bands and all are folded into an odd sketch of BITS bits
BINS, BANDS, ROWS, BITS = 128, 30, 2, 256
#: a key shared by at most RARE records makes their pairs candidates at once, a commoner one
#: counts half; the pairs of a key held by more than HOT records are spread over tasks
RARE, HOT = 16, 2048
#: how far an estimate may lie below the threshold: over four standard errors (0.08 at 0.5)
SLACK = 0.35
#: pairs of a task that are summed before they are shuffled
_PAIRS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a string column in one array, and the rows' lengths."""
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)


def _letters(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0-3, 4 for any other letter, gaps taken out, and the rows' lengths. A row
    is one run of codes; a null row has none."""
    data, lengths = _bytes_of(seqs)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    keep = data != ord("-")
    return _CODE[data[keep]], np.bincount(row[keep], minlength=len(lengths))


def _kmers(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every 16-letter substring of the rows as 32 bits, with its row; those with other
    letters or across a row's end are left out. Repeats are kept."""
    if len(codes) < K:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    bad = np.cumsum(np.r_[0, codes > 3])
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    n = len(codes) - K + 1
    ok = (bad[K:] == bad[:-K]) & (row[K - 1 :] == row[:n])
    two = (codes & 3).astype(np.uint32)
    # 16 letters by doubling: words of 2, 4, 8, then 16 letters
    width = 1
    while width < K:
        two = (two[: len(two) - width] << np.uint32(2 * width)) | two[width:]
        width *= 2
    return two[ok], row[:n][ok]


def _minhash(kmers: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) one-permutation MinHash, empty bins filled from others by hashing the
    bin's number (equal sets fill equally); rows without substrings hold all ones."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = kmers.astype(np.uint64)
    h = (h + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    sig = np.full(n * BINS, none, np.uint64)
    np.minimum.at(sig, row.astype(np.int64) * BINS + (h >> np.uint64(57)).astype(np.int64), h)
    sig = sig.reshape(n, BINS)
    empty = sig == none
    usable = ~empty.all(axis=1)
    todo = empty & usable[:, None]
    attempt = 1
    out = sig.copy()
    while todo.any():
        r, c = np.nonzero(todo)
        x = (c.astype(np.uint64) + np.uint64(1)) * _MIX + np.uint64(attempt * int(_MIX2) % 2**64)
        x ^= x >> np.uint64(31)
        x *= _MIX
        source = (x >> np.uint64(57)).astype(np.int64)
        fill = ~empty[r, source]
        out[r[fill], c[fill]] = sig[r[fill], source[fill]]
        todo[r[fill], c[fill]] = False
        attempt += 1
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """One key of 48 bits per band, the band's number mixed in."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX2, (len(sig), BANDS)).copy()
    for j in range(ROWS):
        key = (key ^ sig[:, j : BANDS * ROWS : ROWS]) * _MIX
        key ^= key >> np.uint64(32)
    return (key >> np.uint64(16)).view(np.int64)


def _odd(sig: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) parity bitmaps: each sample (bin, value) flips one bit."""
    place = (sig * _MIX + np.arange(BINS, dtype=np.uint64) * _MIX2) * _MIX
    place = (place >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((np.arange(len(sig))[:, None] * BITS + place).ravel(), minlength=len(sig) * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64)


def odd_similarity(differing: np.ndarray) -> np.ndarray:
    """The similarity that a number of differing bits stands for: the symmetric
    difference of the samples is -BITS/2 ln(1 - 2 d / BITS), and BINS samples each."""
    x = np.clip(1 - 2 * np.asarray(differing, float) / BITS, 1e-9, 1)
    return 1 + BITS / 4 * np.log(x) / BINS


#: a body: the odd sketch, the numbers of letters and of other letters, the places of those,
#: two bits a letter
_ODD = BITS // 8
_HEAD = _ODD + 8
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)


def _places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for all i, in one array."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _pack(odd: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Each row as one body."""
    lengths = lengths.astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    other = np.flatnonzero(codes > 3)
    others = np.bincount(row[other], minlength=len(lengths))
    quads = -(-lengths // 4)
    two = np.zeros(4 * int(quads.sum()), np.uint8)
    two[_places(4 * (np.cumsum(quads) - quads), lengths)] = codes & 3
    q = two.reshape(-1, 4)
    ends = np.cumsum(_HEAD + 4 * others + quads)
    at = ends - (_HEAD + 4 * others + quads)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    head = np.concatenate([odd.view(np.uint8).reshape(len(lengths), _ODD), np.stack([lengths, others], axis=1).astype(np.uint32).view(np.uint8).reshape(len(lengths), 8)], axis=1)
    out[at[:, None] + np.arange(_HEAD)] = head
    out[_places(at + _HEAD, 4 * others)] = (other - first[row[other]]).astype(np.uint32).view(np.uint8)
    out[_places(at + _HEAD + 4 * others, quads)] = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _raw(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and where each row starts."""
    bodies = bodies.cast(pa.large_binary())
    offsets = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
    return np.frombuffer(bodies.buffers()[2] or b"", np.uint8), offsets[:-1]


def _odd_of(bodies: pa.Array) -> np.ndarray:
    data, at = _raw(bodies)
    return np.ascontiguousarray(data[at[:, None] + np.arange(_ODD)]).view(np.uint64)


def _unpack(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of the rows, as _letters gives them."""
    if not len(bodies):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    data, at = _raw(bodies)
    lengths, others = np.ascontiguousarray(data[at[:, None] + np.arange(_ODD, _HEAD)]).view(np.uint32).astype(np.int64).T
    quads = -(-lengths // 4)
    four = (data[_places(at + _HEAD + 4 * others, quads)][:, None] >> _SHIFTS) & 3
    codes = four.ravel()[_places(4 * (np.cumsum(quads) - quads), lengths)]
    if others.any():
        place = data[_places(at + _HEAD, 4 * others)].view(np.uint32)
        codes[np.repeat(np.cumsum(lengths) - lengths, others) + place] = 4
    return codes, lengths


#: rows worked on at a time, so that the letters' arrays stay in the processor's cache
_LOT = 250


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, _LOT):
            yield b.slice(i, _LOT)


def _payload_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, seq -> id, body: the odd sketch and the packed letters."""
    for b in _lots(batches):
        codes, lengths = _letters(b.column(1))
        kmers, row = _kmers(codes, lengths)
        odd = _odd(_minhash(kmers, row, b.num_rows))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _pack(odd, codes, lengths)], names=["id", "body"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, substrings and their rows of lots of bodies."""
    for b in _lots(batches):
        yield b.column(0).to_numpy(zero_copy_only=False), *_kmers(*_unpack(b.column(1)))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, kmers, row in _unpacked(batches):
        use = np.flatnonzero(np.bincount(row, minlength=len(ids)))
        keys = _bands(_minhash(kmers, row, len(ids))[use])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[use], BANDS))], names=["key", "id"])


def _prefix_rows(least: float):
    """The keys of the exact way: of a record's n substrings, in the order of their hashes,
    the first n - ceil(least n) + 1. Two records at or over `least` share one of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, kmers, row in _unpacked(batches):
            keys, owners = [], []
            ends = np.searchsorted(row, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                one = np.unique(kmers[ends[i] : ends[i + 1]])
                if len(one):
                    # an odd factor permutes the 32-bit numbers
                    h = np.sort(one * np.uint32(0x9E3779B1))[: len(one) - math.ceil(least * len(one) - 1e-9) + 1]
                    keys.append(h.astype(np.int64))
                    owners.append(np.full(len(h), ids[i]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "id"])

    return work


def _pairer(rare: int, hot: int):
    """key, id in the order of keys -> the pairs of each key's records and what the keys count: 2
    if rare, else 1. Keys held by more than `hot` records are passed over; at most `hot` rows of a
    key and a batch are held. Lots of about _PAIRS pairs are summed and put in order, in which their
    numbers compress to less."""
    names = ["row_a", "row_b", "weight"]

    def summed(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, weight = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((b, a))
        a, b, weight = a[order], b[order], weight[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        total = np.diff(np.r_[0, np.cumsum(weight)][np.r_[first, len(a)]]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(total)], names=names)

    def pairs(key: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        later = np.repeat(first + n, n) - np.arange(len(key)) - 1
        size = np.repeat(n, n)
        at = np.flatnonzero((later > 0) & (size <= hot))
        d = 1
        while len(at):
            a, b = ids[at], ids[at + d]
            ok = a != b
            yield np.minimum(a, b)[ok], np.maximum(a, b)[ok], np.where(size[at][ok] <= rare, 2, 1).astype(np.int32)
            d += 1
            at = at[later[at] >= d]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for made in groups(batches):
            out.append(made)
            held += len(made[0])
            if held > _PAIRS:
                yield summed(out)
                out, held = [], 0
        if out:
            yield summed(out)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        key, ids, passed = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            k, i = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if passed is not None:
                go = k != passed
                k, i = k[go], i[go]
            if not len(k):
                continue
            key, ids, passed = np.concatenate([key, k]), np.concatenate([ids, i]), None
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from pairs(key[:whole], ids[:whole])
            key, ids = key[whole:], ids[whole:]
            if len(key) > hot:
                passed, key, ids = key[-1], key[:0], ids[:0]
        if len(key):
            yield from pairs(key, ids)

    return work


def candidates(keys: DataFrame, least_weight: int, rare: int = RARE, hot: int = HOT) -> DataFrame:
    """row_a, row_b of the records that share a rare key or `least_weight` common ones (key, id).

    The keys are shuffled once, and the pairs once, by row_a. A key's pairs are made where its rows lie; those of a key that
    more than `hot` records hold are made in cells of two blocks of at most about `hot`
    records each, spread over the tasks, so that no group is paired in one task."""
    # the filters that the joins infer are stated here, so that all readers share one shuffle
    e = keys.where("key is not null and id is not null").repartition("key")
    cold = e.sortWithinPartitions("key").mapInArrow(_pairer(rare, hot), "row_a long, row_b long, weight int")
    many = e.groupBy("key").agg(F.count("id").alias("n")).where(F.col("n") > hot).hint("shuffle_hash")
    crowd = e.join(many, "key").withColumn("blocks", F.ceil(F.col("n") / hot).cast("long")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cell = crowd.select("key", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j")).select("key", "id", "block", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"))
    a, b = cell.withColumnsRenamed({"id": "row_a", "block": "block_a"}), cell.withColumnsRenamed({"id": "row_b", "block": "block_b"})
    met = a.join(b, ["key", "lo", "hi"]).where("row_a < row_b and (lo = hi or block_a <> block_b)").select("row_a", "row_b", F.lit(1).alias("weight"))
    # summed where row_a lies, so that a join on it needs no shuffle of its own
    pairs = cold.unionByName(met).repartition("row_a")
    return pairs.groupBy("row_a", "row_b").agg(F.sum("weight").alias("w")).where(F.col("w") >= least_weight).select("row_a", "row_b")


_SLOTS = 20


def _set_of(kmers: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A record's substrings (each once) and their slots in a table of 2^_SLOTS; the
    slots are None if two substrings share one."""
    slots = (kmers * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
    order = np.arange(len(kmers), dtype=np.int32)
    seen[slots] = order
    if np.array_equal(seen[slots], order):
        return kmers, slots
    once = np.unique(kmers)
    if len(once) == len(kmers):
        return kmers, None
    return _set_of(once, seen)


def _verifier(least: float, slack: float | None):
    """Pairs with their bodies -> pairs at or over `least`, with the exact similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << _SLOTS, np.int32)
        mark = np.zeros(1 << _SLOTS, np.uint64)
        stamp = 0
        for b in batches:
            at = np.arange(b.num_rows)
            if slack is not None:
                differing = np.bitwise_count(_odd_of(b.column(2)) ^ _odd_of(b.column(3))).sum(axis=1)
                at = np.flatnonzero(odd_similarity(differing) >= least - slack)
            ids = np.concatenate([b.column(k).to_numpy(zero_copy_only=False)[at] for k in (0, 1)])
            _, first, slot = np.unique(ids, return_index=True, return_inverse=True)
            ia, ib = slot[: len(at)], slot[len(at) :]
            bodies = pa.concat_arrays([b.column(2).take(pa.array(at)), b.column(3).take(pa.array(at))]).take(pa.array(first))
            sets = []
            for i in range(0, len(bodies), _LOT):
                lot = bodies.slice(i, _LOT)
                kmers, row = _kmers(*_unpack(lot))
                ends = np.searchsorted(row, np.arange(len(lot) + 1))
                sets += [_set_of(kmers[ends[j] : ends[j + 1]], seen) for j in range(len(lot))]
            sim = np.zeros(len(at))
            marked = -1
            for k in np.argsort(ib, kind="stable").tolist():
                (x, sx), (y, sy) = sets[ia[k]], sets[ib[k]]
                if sx is None or sy is None:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                else:
                    if ib[k] != marked:
                        marked, stamp = ib[k], stamp + 1
                        mark[sy] = y | np.uint64(stamp << 32)
                    common = np.count_nonzero(mark[sx] == (x | np.uint64(stamp << 32)))
                whole = len(x) + len(y) - common
                sim[k] = common / whole if whole else 0.0
            ok = pa.array(at[sim >= least])
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), pa.array(sim[sim >= least])], names=["row_a", "row_b", "similarity"])

    return work


def contents(records: DataFrame, row_id: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(id, seq) of the records that may hold a usable substring, and (id, rep) of those that do and were delivered
    more than once - alike without gaps and in any case - rep being the least id of the copies.

    Copies meet by a digest of 16 bytes, first within each task, so that a sequence
    delivered for a third of all records costs a row per task; the second pass joins ids with
    the repeated digests only, a join whose large side is split where it is skewed."""
    rows = records.select(F.col(row_id).cast("long").alias("id"), F.col(seq).cast("string").alias("seq")).where("id is not null and seq is not null")
    rows = rows.where(F.length("seq") >= K)
    plain = F.upper(F.replace("seq", F.lit("-"), F.lit("")))
    # records without a substring have no keys; only here must they be told apart
    digest = rows.where(plain.rlike(f"[ACGT]{{{K}}}")).select("id", F.unhex(F.md5(plain.cast("binary"))).alias("h"))
    again = stored(digest.groupBy("h").agg(F.min("id").alias("rep"), F.count("id").alias("n")).where("n > 1").select("h", "rep"))
    return rows, stored(digest.join(again, "h").select("id", "rep"))


def representative_pairs(rows: DataFrame, copies: DataFrame, least: float, slack: float | None, exact: bool) -> DataFrame:
    """row_a, row_b, similarity of the different contents that are alike; see near_duplicates."""
    body = rows.mapInArrow(_payload_rows, "id long, body binary").where("id is not null")
    body = body.join(copies.where("id <> rep").select("id"), "id", "left_anti").select("id", "body").repartition("id")
    keys = body.mapInArrow(_prefix_rows(least) if exact else _band_rows, "key long, id long")
    pairs = candidates(keys, 1 if exact else 2)
    a, b = body.select(F.col("id").alias("row_a"), F.col("body").alias("body_a")), body.select(F.col("id").alias("row_b"), F.col("body").alias("body_b"))
    both = pairs.join(a, "row_a").join(b, "row_b").select("row_a", "row_b", "body_a", "body_b")
    return both.mapInArrow(_verifier(least, None if exact else slack), "row_a long, row_b long, similarity double")


def near_duplicates(records: DataFrame, row_id: str, seq: str, least: float = 0.5, slack: float | None = SLACK, exact: bool = False) -> DataFrame:
    """row_a, row_b, similarity of the pairs whose sets of 16-letter substrings overlap by
    `least` or more (Jaccard); row_a < row_b.

    Gaps are taken out, case is ignored, substrings with letters other than A, C, G, T
    left out; null and empty sequences and those without a substring are in no pair.
    row_id is a unique integer. Copies are collapsed first and follow by membership at the end.
    MinHash bands give candidates: a pair is one if it shares a band that at most RARE
    records hold, or two bands. The XOR population count of the two odd sketches then
    estimates the similarity; pairs whose estimate lies `slack` (over four standard
    errors; None: no such filter) below `least` go no further, the others are computed exactly
    from the two-bit packed sequences. With 30 bands of 2 rows a pair at 0.5 shares no band
    with probability 0.0002, at 0.55 with 0.00002, at 0.6 with 2e-6.

    exact: no pair can be missed. The keys are then not bands but the first part of each
    record's substrings in one order of all substrings, of which two records at or over `least`
    must share one (about n (1 - least) keys a record instead of 30), and no sketch filters.

    A record's body is shuffled once, by its id, and read from there for the keys and for both
    sides of the pairs; keys carry only a number. Hashing a body twice, for the sketch and for the
    bands, costs less than carrying 30 keys through that shuffle."""
    rows, copies = contents(records, row_id, seq)
    pairs = representative_pairs(rows, copies, least, slack, exact)
    a, b = copies.select(F.col("rep").alias("row_a"), F.col("id").alias("of_a")), copies.select(F.col("rep").alias("row_b"), F.col("id").alias("of_b"))
    full = pairs.join(a, "row_a", "left").join(b, "row_b", "left").select(F.coalesce("of_a", "row_a").alias("x"), F.coalesce("of_b", "row_b").alias("y"), "similarity")
    full = full.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"), "similarity")
    same = a.join(b, F.col("row_a") == F.col("row_b")).where("of_a < of_b").select(F.col("of_a").alias("row_a"), F.col("of_b").alias("row_b"), F.lit(1.0).alias("similarity"))
    return full.unionByName(same)


def same_record_classes(records: DataFrame, row_id: str, seq: str, least: float = 0.5, exact: bool = False) -> DataFrame:
    """One row per record: row_id, class_id (the smallest record linked to it directly or
    indirectly, itself if none) and links (how many records it is alike).

    Exact copies are collapsed first: pairs are sought between different sequences only and
    copies follow by membership, so they are never expanded into pairs. Records that are
    null, empty or without a usable substring stand alone."""
    rows, copies = contents(records, row_id, seq)
    pairs = stored(representative_pairs(rows, copies, least, SLACK, exact))
    ids = pairs.select(F.format_string("%020d", "row_a").alias("a"), F.format_string("%020d", "row_b").alias("b"))
    groups = linked_groups(ids, "a", "b", weight=None).select(F.col("record_id").cast("long").alias("rep"), F.col("group_id").cast("long").alias("class_id"))
    held = copies.groupBy("rep").agg(F.count("id").alias("copies"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("row_a").alias("rep"), F.col("row_b").alias("other")), F.struct(F.col("row_b").alias("rep"), F.col("row_a").alias("other")))).alias("x")).select("x.*")
    near = both.join(held.withColumnRenamed("rep", "other"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("near"))
    one = groups.join(near, "rep", "full").join(held, "rep", "full").select("rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("near", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"))
    every = records.select(F.col(row_id).cast("long").alias("row_id")).where("row_id is not null").distinct()
    got = every.join(copies, every["row_id"] == copies["id"], "left").select("row_id", F.coalesce("rep", "row_id").alias("rep"))
    return got.join(one, "rep", "left").select("row_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
