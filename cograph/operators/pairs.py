"""Counting of feature pairs inside the tasks, for J1 and G4.

A task turns its contexts into sorted feature numbers, forms the pairs ``fi * size + fj`` of a bounded chunk, sorts and counts
them, and sends each range of pairs as one packed block (differences of the sorted pairs, byte by byte, compressed). One
task merges the blocks of a range. Pairs are shuffled once for each chunk that has them, in two to three bytes.
The ranges come from a sample of the contexts; any ranges give the same counts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 23  # pairs that a task holds until it counts and sends them
SLAB = 1 << 20  # pairs formed at once
MERGED = 1 << 23  # different pairs that a merging task holds until it adds up
WIDE = 256  # contexts of more features are paired feature by feature
ROWS = 1 << 17  # rows of a result batch


def count_bits(size: int) -> int:
    """Low bits that hold a count beside a pair; greater counts take several entries."""
    return min(12, 63 - (max(size, 2) ** 2 - 1).bit_length())


def entries(pairs: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Entries ``pair << bits | count`` of pairs and their counts."""
    most = (1 << bits) - 1
    full = counts // most
    rest = counts > full * most
    out = [pairs[rest] << bits | (counts - full * most)[rest]]
    if full.any():
        out.append(np.repeat(pairs, full) << bits | most)
    return np.concatenate(out)


def add_up(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different pairs of entries (which are sorted in place) and their counts."""
    found.sort()
    pairs = found >> bits
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[at], np.add.reduceat(found & ((1 << bits) - 1), at) if len(at) else np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Values of 0 or more, byte by byte without the bytes that are 0 in all of them."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return width, values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    """A block of sorted different pairs and their counts."""
    w, a = _planes(np.diff(pairs, prepend=0))
    v, b = _planes(counts)
    return struct.pack("<IBB", len(pairs), w, v) + pa.compress(a + b, codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, w, v = struct.unpack_from("<IBB", block)
    data = np.frombuffer(pa.decompress(block[6:], n * (w + v), codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((2, n, 8), np.uint8)
    out[0, :, :w], out[1, :, :v] = data[: n * w].reshape(w, n).T, data[n * w :].reshape(v, n).T
    gaps, counts = out.view(np.int64)[:, :, 0]
    return np.cumsum(gaps), counts


def numbered(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each row's first element, closed by the end; feature numbers, sorted inside a row; frequencies).

    ``known``: sorted hashes of the kept features, their numbers and frequencies, for a column of hashes; without
    it the columns are the numbers and the frequencies themselves."""
    sizes = np.diff(batch.column(0).offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    if known is None:
        number, frequency = first.astype(np.int64), batch.column(1).flatten().to_numpy(zero_copy_only=False)
    else:
        hashes, numbers, frequencies = known
        at = np.minimum(np.searchsorted(hashes, first), max(len(hashes) - 1, 0))
        hit = hashes[at] == first if len(hashes) else np.zeros(len(first), bool)
        row, at = row[hit], at[hit]
        number, frequency = numbers[at].astype(np.int64), frequencies[at]
    order = np.lexsort((number, row))
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    return starts, number[order], frequency[order]


def formed(starts: np.ndarray, number: np.ndarray, frequency: np.ndarray, size: int, hopeful: Callable) -> Iterator[np.ndarray]:
    """The pairs of every row in arrays of about ``SLAB``; ``hopeful`` (n_i, n_j) says which may become edges."""
    sizes = np.diff(starts)
    for s in np.unique(sizes[sizes >= 2]).tolist():
        begin = starts[:-1][sizes == s]
        if s > WIDE:
            for b in begin:
                for i in range(b, b + s - 1):
                    keep = hopeful(frequency[i], frequency[i + 1 : b + s])
                    yield (number[i] * size + number[i + 1 : b + s])[keep]
            continue
        left, right = np.triu_indices(s, 1)
        step = max(1, SLAB // len(left))
        for k in range(0, len(begin), step):
            at = np.arange(s)[:, None] + begin[None, k : k + step]
            f, n = number[at], frequency[at]
            keep = hopeful(n[left], n[right])
            yield ((f * size)[left] + f[right])[keep]


def sender(known, size: int, cuts: np.ndarray, hopeful: Callable):
    """mapInArrow function: contexts -> blocks (part, block) of each chunk, dealt at the pairs ``cuts``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used = np.empty(CHUNK, np.int64), 0

        def blocks() -> pa.RecordBatch:
            d = held[:used]
            d.sort()
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            pairs, counts = d[at], np.diff(at, append=used)
            ends = [0, *np.searchsorted(pairs, cuts).tolist(), len(pairs)]
            parts = [i for i in range(len(ends) - 1) if ends[i] < ends[i + 1]]
            packed = [pack(pairs[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]) for i in parts]
            return pa.record_batch([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["part", "block"])

        for batch in batches:
            for found in formed(*numbered(batch, known and known.value), size, hopeful):
                for i in range(0, len(found), CHUNK):  # a slab may be longer than a chunk
                    some = found[i : i + CHUNK]
                    if used + len(some) > CHUNK:
                        yield blocks()
                        used = 0
                    held[used : used + len(some)] = some
                    used += len(some)
        if used:
            yield blocks()

    return send


def merger(size: int, min_count: int):
    """mapInArrow function: all blocks of whole ranges -> (fi, fj, n_ij) with n_ij >= ``min_count``."""
    bits = count_bits(size)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, most = 0, MERGED
        for batch in batches:
            for block in batch.column(1):
                held.append(entries(*unpack(block.as_py()), bits))
                rows += len(held[-1])
                if rows > most:
                    held = [entries(*add_up(np.concatenate(held), bits), bits)]
                    rows = len(held[0])
                    most = max(MERGED, 2 * rows)
        if not held:
            return
        pairs, counts = add_up(np.concatenate(held), bits)
        del held
        kept = np.flatnonzero(counts >= min_count)
        for i in range(0, len(kept), ROWS):
            p, n = pairs[kept[i : i + ROWS]], counts[kept[i : i + ROWS]]
            yield pa.record_batch([pa.array((p // size).astype(np.int32)), pa.array((p % size).astype(np.int32)), pa.array(n)], names=["fi", "fj", "n_ij"])

    return merge


def sampled(sample: pa.RecordBatch, known, size: int, hopeful: Callable, draws: int = 500_000) -> tuple[float, np.ndarray]:
    """(hopeful pairs of the sampled contexts, some of them, sorted)."""
    starts, number, frequency = numbered(sample, known)
    sizes = np.diff(starts).astype(float)
    pairs = sizes * (sizes - 1) / 2
    if not pairs.sum():
        return 0.0, np.zeros(0, np.int64)
    rng = np.random.default_rng(42)
    row = rng.choice(len(sizes), draws, p=pairs / pairs.sum())
    i = (rng.random(draws) * sizes[row]).astype(np.int64)
    j = (rng.random(draws) * (sizes[row] - 1)).astype(np.int64)
    j += j >= i
    i, j = starts[row] + np.minimum(i, j), starts[row] + np.maximum(i, j)
    keep = hopeful(frequency[i], frequency[j])
    return float(pairs.sum() * keep.mean()), np.sort((number[i] * size + number[j])[keep])
