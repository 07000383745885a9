"""Words of Arrow string arrays as hashes, in numpy, without a Python loop over characters.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. Its hash is a polynomial of
its bytes modulo 2**64, taken as a difference of running sums and finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 18  # bytes hashed at once
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """One-to-one bit mixer of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _SPAN)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of first text, bytes, text bounds in them) for runs of texts of about ``size`` bytes; null is empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and bounds[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the index of the first word of each text (one more at the end)."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([np.ones(1, bool), blank])[: len(data)] | edge[:-1]
    after = np.concatenate([blank, np.ones(1, bool)])[1:] | edge[1:]
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    hashes = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _SPAN, "right")))
        part = low[start[a] : end[b - 1]]
        up, down = _powers(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        s, e = start[a:b] - start[a], end[a:b] - start[a]
        hashes[a:b] = (run[e] - run[s]) * down[s]
        a = b
    return mix(hashes), start, end, np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its distinct shingle hashes in ascending order); fewer words: the whole as one."""
    factors = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64)) for k in range(width)]
    for first, data, bounds in chunks(texts):
        h, _, _, at = words(data, bounds)
        joint = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            joint += h[k : k + len(joint)] * factors[k]
        joint = mix(joint)
        for i in range(len(bounds) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= width:
                yield first + i, np.unique(joint[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for k in range(b - a):
                    short = np.uint64((int(short) * _BASE + int(h[a + k])) & (2**64 - 1))
                yield first + i, mix(np.array([short], np.uint64))
            else:
                yield first + i, np.zeros(0, np.uint64)
