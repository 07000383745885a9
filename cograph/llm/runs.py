"""Operator 13, periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``max(min_length, 2 q)`` long, that no neighbouring word
extends. Documents are independent, so Spark deals them out and nothing is shuffled; a task joins the documents of about
``CHUNK_BYTES`` of text to one sequence of numbers (a word has another number in every document, and a number of its own
ends each document, so nothing matches across documents) and works on the whole sequence in numpy:

* prefix doubling gives every position the rank of its block of 2^k words, for every k, and with them the suffix array:
  the occurrences of a block are an interval of it;
* every dyadic block (2^k words that start at a multiple of 2^k) asks a wavelet tree over the suffix array for the next
  occurrences of itself in the window behind it in which a run that holds it could repeat it;
* occurrences closer than half a block form an arithmetic progression whose difference is the block's own period; one
  query and one extension finds a whole progression, and its members are candidate periods;
* each candidate is extended to both sides by comparing ranks of halving blocks; of candidates with the same stretch the
  smallest period stays.

A run of length L and period q holds, in its first L - q words, a dyadic block of every length b with 2 b - 1 <= L - q;
the level of q is the largest such b for the least L, so every run is found at the level of its period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bytes of text worked on at once (a longer text is worked on alone).
CHUNK_BYTES = 1 << 20
#: Dyadic blocks that query together.
QUERIES = 1 << 18


def ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(ranks of blocks of 1, 2, 4... words at every position, suffix array). A rank is the first place of the block's
    occurrences in the suffix array; the last list tells all positions apart. The last symbol must occur once."""
    n = len(symbols)
    kinds = np.bincount(symbols)
    rank = (np.cumsum(kinds) - kinds)[symbols].astype(np.int64)
    active = np.flatnonzero(kinds[symbols] > 1)
    levels, width = [rank], 1
    while len(active):
        rank = rank.copy()
        # a block that repeats does not hold the last symbol, so the next one starts inside
        key = rank[active] * np.int64(n) + levels[-1][active + width]
        order = np.argsort(key)
        active, key = active[order], key[order]
        first = np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        old = levels[-1][active]
        # place of each new group inside the old one
        start = np.flatnonzero(np.concatenate([np.ones(1, bool), old[1:] != old[:-1]]))
        inside = np.arange(len(active)) - np.repeat(start, np.diff(np.append(start, len(active))))
        rank[active] = old + inside[at][group]
        active = active[np.diff(np.append(at, len(key)))[group] > 1]
        levels.append(rank)
        width *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return levels, suffixes


class WaveletTree:
    """Bits of an array of numbers, level by level (the pointerless form), for queries on many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            low = (values >> bit & 1) == 0
            self.zeros.append(np.concatenate([np.zeros(1, np.int64), np.cumsum(low)]))
            values = np.concatenate([values[low], values[~low]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value >= ``least`` in each range [lo, hi), or -1."""
        if not len(lo):
            return np.zeros(0, np.int64)
        a, b, rank = lo, hi, np.zeros(len(lo), np.int64)
        over = least >> self.bits > 0
        for depth, zeros in enumerate(self.zeros):  # how many values of the range are smaller
            one = (least >> (self.bits - 1 - depth) & 1).astype(bool)
            za, zb = zeros[a], zeros[b]
            rank += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        rank = np.where(over, hi - lo, rank)
        found = np.flatnonzero(rank < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        a, b, rank, value = lo[found], hi[found], rank[found], np.zeros(len(found), np.int64)
        for depth, zeros in enumerate(self.zeros):  # the value of that rank
            za, zb = zeros[a], zeros[b]
            one = rank >= zb - za
            rank -= np.where(one, zb - za, 0)
            value += one.astype(np.int64) << (self.bits - 1 - depth)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        out[found] = value
        return out


def _forward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of words that agree from x and from y on (x < y)."""
    n, same = len(levels[0]), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x + same, y + same
        equal = levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        same += np.where(equal & (j < n), 1 << k, 0)
    return same


def _backward(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of words that agree before x and before y (x < y)."""
    same = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = x - same - (1 << k), y - same - (1 << k)
        equal = levels[k][np.maximum(i, 0)] == levels[k][np.maximum(j, 0)]
        same += np.where(equal & (i >= 0), 1 << k, 0)
    return same


def period_ranges(min_length: int, longest: int) -> dict[int, tuple[int, int]]:
    """Level k -> (smallest, largest) period whose runs are found by blocks of 2^k words, up to period ``longest``."""
    out: dict[int, tuple[int, int]] = {}
    for q in range(1, min(longest, min_length) + 1):
        k = (max(min_length - q, q) + 1).bit_length() - 2
        out[k] = (min(out.get(k, (q, q))[0], q), q)
    q = min_length + 1
    while q <= longest:  # from here on the shortest run has two periods
        k = (q + 1).bit_length() - 2
        last = min((4 << k) - 2, longest)
        out[k] = (min(out.get(k, (q, q))[0], q), last)
        q = last + 1
    return out


def _candidates(levels, suffixes, tree, place, size, k: int, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the repeats of dyadic blocks of 2^k words at distances from ``least`` to ``most``."""
    n, b = len(suffixes), 1 << k
    blocks = np.arange(0, n - b, b)
    blocks = blocks[size[k][levels[k][blocks]] > 1]
    for i in range(0, len(blocks), QUERIES):
        s = blocks[i : i + QUERIES]
        rank = levels[k][s]
        lo, hi = place[rank], place[rank + size[k][rank]]
        # the block's own period, if at most half of it: all its repeats up to the end of that stretch are multiples
        own = tree.successor(lo, hi, s + 1) - s
        near = np.flatnonzero((own > 0) & (own <= b // 2))
        d, at = np.zeros(len(s), np.int64), s + least
        d[near] = own[near]
        beyond = s[near] + d[near] + _forward(levels, s[near], s[near] + d[near]) - b + 1
        at[near] = np.maximum(at[near], beyond)
        inside = near[(d[near] >= least) & (d[near] <= most)]
        yield s[inside], d[inside]
        left = np.arange(len(s))
        while len(left):
            x = tree.successor(lo[left], hi[left], at[left])
            hit = (x >= 0) & (x <= s[left] + most)
            left, x = left[hit], x[hit]
            if not len(left):
                break
            count, step = np.ones(len(left), np.int64), d[left]
            many = np.flatnonzero(step > 0)
            agree = _forward(levels, x[many], np.minimum(x[many] + step[many], n - 1))
            # the progression from x: all places from which the block's period goes on for a block
            members = np.maximum((agree + step[many] - b) // step[many], 0) + 1
            at[left] = x + 1
            at[left[many]] = x[many] + (members - 1) * step[many] + 1
            count[many] = np.minimum(members, (s[left[many]] + most - x[many]) // step[many] + 1)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(s[left], count)
            yield start, np.repeat(x, count) + nth * np.repeat(step, count) - start
    return


def runs_of(symbols: np.ndarray, min_length: int, longest: int) -> np.ndarray:
    """All runs (start, end, period) of a sequence of numbers from 0 on whose last occurs once, by start, then end."""
    levels, suffixes = ranks(symbols)
    ranges = {k: r for k, r in period_ranges(min_length, longest).items() if k < len(levels)}
    found = [np.zeros((0, 3), np.int64)]
    if ranges:
        size = [np.bincount(level, minlength=len(symbols)) for level in levels]
        # only blocks that repeat are asked for: the tree leaves out the rest
        repeats = size[min(ranges)][levels[min(ranges)][suffixes]] > 1
        place = np.concatenate([np.zeros(1, np.int64), np.cumsum(repeats)])
        tree = WaveletTree(suffixes[repeats])
        for k, (least, most) in ranges.items():
            for s, p in _candidates(levels, suffixes, tree, place, size, k, least, most):
                end = s + p + _forward(levels, s, s + p)
                start = s - _backward(levels, s, s + p)
                long = end - start >= np.maximum(min_length, 2 * p)
                found.append(np.stack([start[long], end[long], p[long]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[first]


def _chunks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in runs of texts of about CHUNK_BYTES."""
    part, held = [], 0
    for text in texts:
        data = text.encode() if text else b""
        if held and held + len(data) > CHUNK_BYTES:
            yield part
            part, held = [], 0
        part.append(data.split())  # of bytes: at space and 0x09-0x0D
        held += len(data)
    if part:
        yield part


def _symbols(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, each document ended by a number of its own; where the documents start, and the end)."""
    out, used = [], 0
    for words in docs:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), used)}
        out.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        used += len(number)
        out.append(np.array([used], np.int64))
        used += 1
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(words) + 1 for words in docs])])
    return np.concatenate(out), bounds


def _rows(docs: list[list[bytes]], min_length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(runs of all documents, how many each has, each one's text without repeats)."""
    symbols, bounds = _symbols(docs)
    found = runs_of(symbols, min_length, max(map(len, docs)) // 2)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(bounds, found[:, 0], "right") - 1
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 1], -1)
    kept, counts, texts = np.cumsum(cover) == 0, np.bincount(owner, minlength=len(docs)), []
    for i, words in enumerate(docs):
        if counts[i]:
            words = [words[j] for j in np.flatnonzero(kept[bounds[i] : bounds[i] + len(words)])]
        texts.append(b" ".join(words))
    rows = np.stack([found[:, 0] - bounds[owner], found[:, 1] - found[:, 0], found[:, 2]], 1)
    return rows, counts, texts


def find_runs(docs: DataFrame, min_length: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``.

    Runs are ordered by start, then period; ``collapsed`` is the words that no run holds after its first period, joined
    by one space. Null and empty texts have no words, no runs and an empty ``collapsed``; a text without repeats comes
    back with its white space as single spaces. Rows that repeat an id are worked on one by one, a null id stays null;
    other columns are not used; an empty table gives an empty result. A text of n words takes about 8 n (log2 r + 12)
    bytes, r its longest repeat.
    """
    if min_length < 2:
        raise ValueError("min_length must be at least 2")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _chunks(batch.column(1).to_pylist()):
                rows, counts, texts = _rows(part, min_length)
                columns = [pa.array(rows[:, i], pa.int64()) for i in range(3)]
                runs = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(list(map(len, part)), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(part)

    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
