"""G1 on whole small components inside the tasks.

But for the sum of all weights, Louvain's rounds in one component know nothing of the others. ``parts_of`` names the
components that a few rounds find closed, and a task runs all sweeps, levels and rounds of ``louvain`` on the small ones dealt to
it: moves that hold together, refinement, contraction, again from single nodes until nothing moves. Many components are
worked on side by side in arrays; each ends by its own rounds, so the result does not depend on which ones share a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEED = 42  # fixed value: the reference's seed
CLASSES = 40  # classes of gains (powers of two)
BUCKETS = 32  # hash buckets of a class
HOPS = 8  # rounds that join parts to components
BATCH = 1 << 18  # edges that a task works on at once; more only where one component has more


# ---------------------------------------------------------------- which components there are
def first_parts(edges: DataFrame) -> DataFrame:
    """(id, part): the least hash in a node's neighbourhood. ``edges``: (src, dst)."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).union(edges.select("dst", "src"))
    return both.groupBy("id").agg(F.min(F.xxhash64("nbr")).alias("m")).select("id", F.least(F.xxhash64("id"), "m").alias("part"))


def parts_of(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` (with the parts ``p_src`` and ``p_dst`` of their ends) by components of at most ``most`` edges: (edges of
    these with the component as ``part``, other edges or None).

    Parts that an edge joins take the least name next to them, and that one's; what is not closed after HOPS rounds is left to
    the others, whatever its size. Equal hashes put two components in one part, which then is worked on as one."""
    ends = (F.least("p_src", "p_dst").alias("p_src"), F.greatest("p_src", "p_dst").alias("p_dst"))
    crossing = cut_lineage(edges.where("p_src <> p_dst").select(*ends).distinct())
    names = None
    for _ in range(HOPS):
        if crossing.isEmpty():
            break
        both = crossing.union(crossing.select("p_dst", "p_src")).toDF("part", "near")
        step = both.groupBy("part").agg(F.min("near").alias("near")).select("part", F.least("part", "near").alias("to"))
        step = cut_lineage(step.join(step.toDF("to", "further"), "to").select("part", F.col("further").alias("to")))
        names = step if names is None else cut_lineage(names.join(step.toDF("to", "further"), "to", "left").select("part", F.coalesce("further", "to").alias("to")))
        for end in ("p_src", "p_dst"):
            crossing = crossing.join(step.toDF(end, "to"), end).drop(end).withColumnRenamed("to", end)
        crossing = cut_lineage(crossing.where("p_src <> p_dst").select(*ends).distinct())
    if names is None:
        edges = edges.withColumn("part", F.col("p_src"))
    else:
        edges = cut_lineage(edges.join(names.toDF("p_src", "to"), "p_src", "left").withColumn("part", F.coalesce("to", "p_src")).drop("to"))
    edges = edges.drop("p_src", "p_dst")
    large = edges.groupBy("part").count().where(F.col("count") > most).select("part")
    large = cut_lineage(large.union(crossing.select(F.explode(F.array("p_src", "p_dst")))).distinct())
    if large.isEmpty():
        return edges, None
    return edges.join(large, "part", "left_anti"), edges.join(large, "part", "left_semi")


# ---------------------------------------------------------------- rounds in arrays
@dataclass
class _Nodes:
    """Nodes 0, 1, ... of many components, with both directions of all edges but loops."""

    name: np.ndarray  # number in the whole graph
    comp: np.ndarray
    k: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray

    def keep(self, comps: np.ndarray) -> tuple[_Nodes, np.ndarray]:
        """The components that ``comps`` marks, and the places of their nodes."""
        stays = comps[self.comp]
        if stays.all():
            return self, np.arange(len(stays))
        to, e = np.cumsum(stays) - 1, stays[self.a]
        return _Nodes(self.name[stays], self.comp[stays], self.k[stays], to[self.a[e]], to[self.b[e]], self.w[e]), np.flatnonzero(stays)


def _starts(x: np.ndarray) -> np.ndarray:
    """Places where a sorted array takes a new value."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _spread(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, size)))


def _least(labels: np.ndarray) -> np.ndarray:
    """The first place of each one's label."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return first[at]


def _hash(name: np.ndarray, round_no: int) -> np.ndarray:
    x = name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((SEED << 32) + round_no)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _wants(g: _Nodes, comm: np.ndarray, tot: np.ndarray, here: np.ndarray, two_m: float, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best community of the nodes ``here`` and what they gain by it; -1 - node stands for one of its own."""
    n, asked = len(comm), np.zeros(len(comm), bool)
    asked[here] = True
    e = asked[g.a]
    key = np.concatenate([g.a[e] * n + comm[g.b[e]], here * n + comm[here]])
    order = np.argsort(key)
    key = key[order]
    at = _starts(key)
    k_c = np.add.reduceat(np.concatenate([g.w[e], np.zeros(len(here))])[order], at)
    v = key[at] // n
    c = key[at] - v * n
    own = c == comm[v]
    value = k_c - g.k[v] * (tot[c] - np.where(own, g.k[v], 0.0)) / two_m
    first = _starts(v)
    top, stay = np.maximum.reduceat(value, first), value[own]
    hit = np.flatnonzero(value == _spread(top, first, len(v)))
    best = c[hit[_starts(v[hit])]]  # ties fall to the smaller name
    if not alone:
        best, top = np.where(top <= 0, -1 - here, best), np.maximum(top, 0.0)
    return best, top - stay


def _together(g: _Nodes, here: np.ndarray, own: np.ndarray, best: np.ndarray, gain: np.ndarray, two_m: float, round_no: int) -> np.ndarray:
    """Which of the wanted moves are made: as ``louvain._together``, they raise Q at once, among them the best one. Of
    equal gains the least hash is the best: by number, a chain's nodes would wait for one another."""
    n, m, k, luck = len(g.k), len(here), g.k[here], _hash(g.name[here], round_no)
    spare = gain * two_m / k
    rank = (np.minimum(np.floor(np.log2(two_m / spare)), CLASSES).astype(np.int64) + 2) * BUCKETS + (luck % np.uint64(BUCKETS)).astype(np.int64)
    c, move, takes = np.concatenate([own, best]) + n, np.tile(np.arange(m), 2), np.repeat([False, True], m)
    order = np.lexsort((luck[move], -gain[move], c))
    at = _starts(c[order])
    lead, group = order[at], np.empty(2 * m, np.int64)
    group[order] = _spread(np.arange(len(at)), at, 2 * m)
    side = np.flatnonzero(takes == takes[lead][group])  # a community gives or takes, as its best move does
    side = side[np.argsort(group[side] * (BUCKETS * (CLASSES + 3)) + rank[move[side]])]
    mine, by = k[move[side]], group[side]
    upto, start, last = np.cumsum(mine), _starts(by), _starts(by * (BUCKETS * (CLASSES + 3)) + rank[move[side]])
    upto = _spread(upto[np.append(last[1:], len(side)) - 1], last, len(side)) - _spread((upto - mine)[start], start, len(side))
    before = np.full(2 * m, np.inf)
    before[side] = np.where(move[lead][by] == move[side], 0.0, k[move[lead]][by] - mine + upto)
    return before[:m] + before[m:] <= spare / 2


def _settle(g: _Nodes, comm: np.ndarray, comps: int, two_m: float, min_gain: float, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rounds until a scoring of all nodes of a component finds no mover: (communities, rounds with moves of each component).
    Other rounds score the neighbours of movers outside the mover's new community, and movers that had to wait. ``free``: only
    these nodes move, while they are still alone, and only to a neighbour's community (refinement)."""
    comm, rounds, step = comm.copy(), np.zeros(comps, np.int64), 0
    live, everyone, active = np.ones(comps, bool), np.ones(comps, bool), np.zeros(len(g.k), bool)
    while live.any():
        tot, ask = np.bincount(comm, g.k, len(g.k)), live[g.comp] & (everyone[g.comp] | active)
        here = np.flatnonzero(ask if free is None else ask & free & (tot[comm] == g.k))
        moving, active = np.zeros(comps, bool), np.zeros(len(g.k), bool)
        if len(here):
            best, gain = _wants(g, comm, tot, here, two_m, free is not None)
            want = (best != comm[here]) & (gain > min_gain * g.k[here])
            here, best, gain = here[want], best[want], gain[want]
            moving[g.comp[here]] = True
        if len(here):
            made = _together(g, here, comm[here], best, gain, two_m, step)
            comm[here[made]], active[here[~made]] = best[made], True
            moved = np.zeros(len(g.k), bool)
            moved[here[made]] = True
            e = moved[g.a]
            a, b = g.a[e], g.b[e]
            active[b[comm[a] != comm[b]]] = True
            if best.min() < 0:
                comm = np.unique(comm, return_inverse=True)[1]
        rounds, step = rounds + moving, step + 1
        going = live & (moving | ~everyone)
        everyone = ~moving
        if not (going == live).all():
            e = going[g.comp[g.a]]
            g = replace(g, a=g.a[e], b=g.b[e], w=g.w[e])
        live = going
    return comm, rounds


def _refine(g: _Nodes, comm: np.ndarray, comps: int, two_m: float, min_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Connected parts of every community, and the rounds of each component."""
    e = comm[g.a] == comm[g.b]
    inner = replace(g, a=g.a[e], b=g.b[e], w=g.w[e])
    inside, tot = np.bincount(inner.a, inner.w, len(g.k)), np.bincount(comm, g.k)[comm]
    well = (inside > 0) & (inside >= g.k * (tot - g.k) / two_m)
    return _settle(inner, np.arange(len(g.k)), comps, two_m, min_gain, well)


def _contract(g: _Nodes, parts: np.ndarray) -> tuple[_Nodes, np.ndarray, np.ndarray]:
    """The graph of the parts, the part of each node and a node of each part."""
    _, first, at = np.unique(parts, return_index=True, return_inverse=True)
    a, b, n = at[g.a], at[g.b], len(first)
    e = a != b
    key, order = a[e] * n + b[e], np.argsort(a[e] * n + b[e])
    key, w = key[order], g.w[e][order]
    start = _starts(key)
    w = np.add.reduceat(w, start) if len(start) else w
    return _Nodes(g.name[first], g.comp[first], np.bincount(at, g.k, n), key[start] // n, key[start] % n, w), at, first


def _communities(base: _Nodes, comps: int, two_m: float, min_gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sweeps and levels: (smallest node of each node's community, levels and rounds of each component)."""
    found, levels, rounds = np.arange(len(base.k)), np.zeros(comps, np.int64), np.zeros(comps, np.int64)
    going, sweep = np.ones(comps, bool), 0
    while going.any():  # sweeps from single nodes up, until a sweep finds nothing to move
        g, nodes = base.keep(going)  # nodes: of the base graph; up: theirs of this level
        up, comm, moved, level = np.arange(len(nodes)), _least(found[nodes]), np.zeros(comps, np.int64), 0
        inside = going
        while True:
            comm, took = _settle(g, comm, comps, two_m, min_gain)
            moved, rounds = moved + took, rounds + took
            if sweep and not level:  # the last sweep's communities stand where no single node moves
                inside = took > 0
                g, nodes, up, at = _only(g, nodes, up, inside)
                comm = comm[at]
            if not len(nodes):
                break
            levels += inside
            found[nodes] = nodes[_least(comm[up])]
            parts, tries = _refine(g, comm, comps, two_m, min_gain)
            inside = tries > 0  # elsewhere every part is one node: nothing to contract
            g, nodes, up, at = _only(g, nodes, up, inside)
            if not len(nodes):
                break
            g, part, first = _contract(g, parts[at])
            up, comm, level = part[up], _least(comm[at][first]), level + 1
        going, sweep = going & (moved > 0), sweep + 1
    return found, levels, rounds


def _only(g: _Nodes, nodes: np.ndarray, up: np.ndarray, comps: np.ndarray) -> tuple[_Nodes, np.ndarray, np.ndarray, np.ndarray]:
    """The components that ``comps`` marks: the graph, its nodes of the base graph, their places in it, its former places."""
    stays = comps[g.comp[up]]
    some, at = g.keep(comps)
    to = np.zeros(len(g.k), np.int64)
    to[at] = np.arange(len(at))
    return some, nodes[stays], to[up[stays]], at


# ---------------------------------------------------------------- tasks
def _solved(edges: pa.Table, total: float, unit: float, two_m: float, min_gain: float) -> pa.Table:
    """The communities of whole components; ``q``, ``start``, ``levels`` and ``rounds`` only on a community's first node."""
    src, dst, w, part = (edges[c].to_numpy() for c in ("v_src", "v_dst", "weight", "part"))
    name, first, at = np.unique(np.concatenate([src, dst]), return_index=True, return_inverse=True)
    s, d, n = at[: len(src)], at[len(src) :], len(name)
    of_edge = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
    comps, comp = int(of_edge[-1]) + 1, np.empty(n, np.int64)
    comp[s], comp[d] = of_edge, of_edge
    whole = np.maximum(np.rint(w / unit), 1.0)
    k, e = np.bincount(s, whole, n) + np.bincount(d, whole, n), s != d
    base = _Nodes(name, comp, k, np.concatenate([s[e], d[e]]), np.concatenate([d[e], s[e]]), np.tile(whole[e], 2))
    comm, levels, rounds = _communities(base, comps, two_m, min_gain)
    # shares of Q by the weights as given
    degree, same = np.bincount(s, w, n) + np.bincount(d, w, n), comm[s] == comm[d]
    q = np.bincount(comm[s[same]], w[same], n) / total - (np.bincount(comm, degree, n) / (2 * total)) ** 2
    start = np.bincount(comm, np.bincount(s[~e], w[~e], n) / total - (degree / (2 * total)) ** 2, n)
    later = comm != np.arange(n)
    ids = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks]).take(pa.array(first))
    shares = [pa.array(x, mask=later) for x in (q, start, levels[comp], rounds[comp])]
    return pa.table([ids, pa.array(name[comm]), *shares], names=["id", "community", "q", "start", "levels", "rounds"])


def solver(total: float, unit: float, two_m: float, min_gain: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: edges (src, dst, weight, v_src, v_dst, part), ordered by part, of whole components -> ``_solved``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, most = 0, BATCH
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            edges = pa.Table.from_batches(held)
            part = edges["part"].to_numpy()
            ends = int(np.searchsorted(part, part[-1]))  # the last component may go on
            if ends:
                yield from _solved(edges.slice(0, ends), total, unit, two_m, min_gain).to_batches(max_chunksize=1 << 16)
            held, rows = edges.slice(ends).to_batches(), rows - ends
            most = max(BATCH, 2 * rows)
        if rows:
            yield from _solved(pa.Table.from_batches(held), total, unit, two_m, min_gain).to_batches(max_chunksize=1 << 16)

    return solve
