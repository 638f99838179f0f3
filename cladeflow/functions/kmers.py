"""k-mers of many sequences at once, as numbers: two bits a letter, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from cladeflow.functions.sequences import CRC_SEED_15

#: letters worked on at a time, so that their arrays stay in the processor's cache
LOT_LETTERS = 1 << 17
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a lot holds about LOT_LETTERS letters of a text column, or one row."""
    for b in batches:
        ends = np.cumsum(np.r_[0, [x.as_buffer().size if x.is_valid else 0 for x in b.column(column)]])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + LOT_LETTERS)))
            yield b.slice(at, to - at)
            at = to


def kmer_codes(seqs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every k-mer (k up to 16) of the rows that holds only A, C, G, T, gaps taken out, any case;
    repeats are kept, null rows have none. Codes order as the texts do."""
    col = seqs.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(col), dtype=np.int32), np.diff(offsets))
    keep = data != ord("-")
    codes, row = _CODE[data[keep]], row[keep]
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    bad = np.cumsum(np.r_[0, codes > 3])
    ok = (bad[k:] == bad[:-k]) & (row[k - 1 :] == row[:n])
    word = np.zeros(n, np.uint32)
    two = (codes & 3).astype(np.uint32)
    for i in range(k):
        word = (word << np.uint32(2)) | two[i : i + n]
    return word[ok], row[:n][ok]


def canonical_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """The lesser of each k-mer and its reverse complement."""
    x = ~codes
    for shift, mask in ((2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF)):
        m = np.uint32(mask)
        x = ((x >> np.uint32(shift)) & m) | ((x & m) << np.uint32(shift))
    x = (x >> np.uint32(16)) | (x << np.uint32(16))
    return np.minimum(codes, x >> np.uint32(32 - 2 * k))


def text_of(code: int, k: int) -> str:
    return "".join("ACGT"[(code >> 2 * (k - 1 - i)) & 3] for i in range(k))


def _crc_tables(k: int = 15, step: int = 5) -> list[np.ndarray]:
    """A checksum is linear in its bits: that of a text is the exclusive-or of one table entry per five letters,
    each the difference that these letters make to the checksum of all A."""
    base = zlib.crc32(b"A" * k)
    return [np.array([zlib.crc32(("A" * at + text_of(c, step) + "A" * (k - at - step)).encode()) ^ base for c in range(4**step)], np.uint32) for at in range(0, k, step)]


_TABLES = _crc_tables()
_ALL_A = np.uint32(zlib.crc32(b"A" * 15) ^ CRC_SEED_15)


def hash_15(codes: np.ndarray) -> np.ndarray:
    """The seeded checksum of 15-letter k-mers; see sequences.kmer_hash."""
    out = np.full(len(codes), _ALL_A, np.uint32)
    for i, t in enumerate(_TABLES):
        out ^= t[(codes >> np.uint32(10 * (2 - i))) & np.uint32(1023)]
    return out


def sketch_rows(seqs: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, held): the `size` least hashes of the canonical 15-mers of each row, ascending, one row
    after the other, and how many each row has."""
    codes, row = kmer_codes(seqs, 15)
    # np.unique looks numbers up in a table, which takes thirty times as long
    both = np.sort(row.astype(np.uint64) << np.uint64(32) | hash_15(canonical_codes(codes, 15)))
    both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
    row = (both >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(row, np.arange(len(seqs) + 1))
    keep = np.arange(len(row)) - first[row] < size
    return (both[keep] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount(row[keep], minlength=len(seqs))


def bottom_sketches(size: int):
    """Kernel: key, seq -> key, h: the `size` least hashes of the canonical 15-mers, ascending; rows without one are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, 1):
            h, held = sketch_rows(b.column(1), size)
            has = np.flatnonzero(held)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held[has])].astype(np.int32)), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), lists], names=["key", "h"])

    return work


#: letters in a block of records, all of whose pairs with another block are made in one task
BLOCK_LETTERS = 1 << 21
#: shared hashes of pairs, and pairs, that a task holds at a time
_HELD = 1 << 19
#: bits of a place in a sketch, of the sum of two, and of a record's number in its block
_PLACE, _SUM, _RECORD = 10, 11, 22


def record_blocks(letters: int = BLOCK_LETTERS):
    """Kernel: key, seq -> block, keys, seqs: the rows in blocks of about `letters` letters, one row each. Blocks are
    numbered by task and place; rows without letters are left out. The letters are packed, as a block is sent to Python
    once for each block that it meets, and many at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = (c.partitionId() if (c := TaskContext.get()) else 0), 0, [], 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(0).chunk(0))
            with pa.ipc.new_stream(to := pa.BufferOutputStream(), (seqs := t.select(["seq"])).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(seqs)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), keys, pa.array([to.getvalue().to_pybytes()])], names=["block", "keys", "seqs"])

        for b in lots(batches, 1):
            b = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string())], names=["key", "seq"])
            b = b.filter(pc.greater(pc.binary_length(b.column(1)), 0))
            if b.num_rows:
                held.append(b)
                size += pc.sum(pc.binary_length(b.column(1))).as_py()
            if size >= letters or sum(x.num_rows for x in held) >= 1 << (_RECORD - 1):
                yield row()
                made, held, size = made + 1, [], 0
        if held:
            yield row()

    return work


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for all i, in one array."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Block:
    """The sketches of a block by hash: the hashes, each once, where the holders of each start, and the
    holders' (record, place in its sketch) in one number; n: hashes of each record."""

    def __init__(self, keys: pa.Array, seqs: pa.Buffer, size: int) -> None:
        self.keys = keys.to_numpy(zero_copy_only=False).copy()
        got = [sketch_rows(b.column(0), size) for b in lots(pa.ipc.open_stream(seqs), 0)]
        h, self.n = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        both = h.astype(np.uint64)
        both <<= np.uint64(32)
        both |= _runs(np.arange(len(self.n)) << _PLACE, self.n).view(np.uint64)
        both.sort()
        h = (both >> np.uint64(32)).astype(np.uint32)
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        self.hashes, self.first, self.holders = h[new], np.r_[new, len(h)], (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _shared(a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, ...]]:
    """key in a, key in b, inside, whole of the pairs of a record of a and one of b (of a later one, if a is b) that share
    a hash."""
    if not len(a.hashes) or not len(b.hashes):
        return
    at = np.minimum(np.searchsorted(b.hashes, a.hashes), len(b.hashes) - 1)
    common = np.flatnonzero(b.hashes[at] == a.hashes)
    at = at[common]
    # the holders in a of the common hashes, in the order of the records, and those in b of each
    held = np.diff(a.first)[common]
    mine = a.holders[_runs(a.first[common], held)].astype(np.uint64) << np.uint64(32) | np.arange(held.sum(), dtype=np.uint64)
    mine = np.sort(mine)
    of = (mine & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start, n = np.repeat(b.first[at], held)[of], np.repeat(np.diff(b.first)[at], held)[of]
    del of
    mine = (mine >> np.uint64(32)).astype(np.int64)
    # whole records of a at a time, one that has more is made alone
    edge = np.searchsorted(mine, np.arange(len(a.n) + 1) << _PLACE)
    rows = np.r_[0, np.cumsum(n)][edge]
    lo = 0
    while lo < len(a.n):
        hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + _HELD, "right")) - 1)
        i, j = edge[lo], edge[hi]
        lo = hi
        left, right = np.repeat(mine[i:j], n[i:j]), b.holders[_runs(start[i:j], n[i:j])]
        if a is b:
            later = right >> _PLACE > left >> _PLACE
            left, right = left[later], right[later]
        if not len(left):
            continue
        # places rise with the hash in both sketches, so their sums are in its order
        place = (1 << _PLACE) - 1
        both = np.sort((left >> _PLACE) << (_RECORD + _SUM) | (right >> _PLACE) << _SUM | (left & place) + (right & place))
        pair = both >> _SUM
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        count = np.diff(np.r_[begin, len(pair)])
        x, y = pair[begin] >> _RECORD, pair[begin] & ((1 << _RECORD) - 1)
        most, whole = np.maximum(a.n[x], b.n[y]), a.n[x] + b.n[y] - count
        union = (both & ((1 << _SUM) - 1)) + 1 - _runs(np.zeros(len(count), np.int64), count)
        inside = np.add.reduceat(union <= np.repeat(most, count), begin, dtype=np.int64)
        yield a.keys[x], b.keys[y], inside.astype(np.int32), np.minimum(most, whole).astype(np.int32)


def _in_runs(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """a, b, inside, whole of the pairs, those of one similarity next to each other: a column file keeps equal values in a
    run once, and the pairs take half the disk."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        x, y, inside, whole = (np.concatenate(c) for c in zip(*held, strict=True))
        # those whose lesser key is in the first block apart, so that a (or else b) has runs too
        kind = (np.where(inside > 0, inside.astype(np.int64) << (_PLACE + 1) | whole, 0) << 1 | (x > y)) << 40
        by = np.sort(kind | np.arange(len(x))) & ((1 << 40) - 1)
        columns = (c[by] for c in (np.minimum(x, y), np.maximum(x, y), inside, whole))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "inside", "whole"])

    for p in pairs:
        held.append(p)
        n += len(p[0])
        if n >= _HELD:
            full, held, n = batch(), [], 0
            yield full
    if held:
        yield batch()


def sketch_pairs(size: int):
    """Kernel: block_a, keys_a, seqs_a and the same of b -> a, b, inside, whole of the pairs of records whose sketches share a
    hash: how many of the joint hashes count - as many of the least as the larger sketch holds - and how many of these both
    have. The i-th shared hash is at place (place in a) + (place in b) - i of the joint ones. Sketches are made anew in
    each task: they are several times larger than the letters. Pairs come in lots, ordered by similarity. size is at most
    1024."""
    if size > 1 << _PLACE:
        raise ValueError(f"places of sketches over {1 << _PLACE} hashes do not fit")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        name, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name_a, name_b = (batch.column(k)[i].as_py() for k in (0, 3))
                of = lambda k: _Block(batch.column(k)[i].values, batch.column(k + 1)[i].as_buffer(), size)  # noqa: B023, E731
                if name_a != name:
                    block = None  # freed before the next is made
                    name, block = name_a, of(1)
                yield from _shared(block, block if name_b == name_a else of(4))

    return lambda batches: _in_runs(met(batches))


def kmer_counts(k: int):
    """Kernel: seq -> code, n: canonical k-mers counted within each lot before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, 0):
            codes, n = np.unique(canonical_codes(kmer_codes(b.column(0), k)[0], k), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return work
