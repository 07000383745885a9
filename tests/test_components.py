"""Louvain of small components inside tasks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cograph.operators import components, louvain


def clique(first, n):
    return [(first + i, first + j, 1.0) for i in range(n) for j in range(i + 1, n)]


def graph(seed, first, n, inside=0.6, outside=0.08, size=6):
    """A connected graph of n nodes with planted groups, some loops and repeated edges."""
    rng = random.Random(seed)
    edges = [(first + rng.randrange(i), first + i, round(rng.uniform(0.1, 1.0), 4)) for i in range(1, n)]
    edges += [(first + i, first + j, round(rng.uniform(0.1, 1.0), 4)) for i in range(n) for j in range(i, n) if rng.random() < (inside if i // size == j // size else outside)]
    return edges


def roots(edges):
    up = {v: v for e in edges for v in e[:2]}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in edges:
        up[root(e[0])] = root(e[1])
    return {v: root(v) for v in up}


def quality(edges, comm):
    """Q in plain Python."""
    m = sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for v in (a, b):
            degree[comm[v]] = degree.get(comm[v], 0.0) + w
        if comm[a] == comm[b]:
            inside[comm[a]] = inside.get(comm[a], 0.0) + w
    return sum(inside.get(c, 0.0) / m - (d / 2 / m) ** 2 for c, d in degree.items())


def settled(edges, comm):
    """Every community is connected, and no single move to a neighbour's or to an own one raises Q."""
    two_m = 2 * sum(w for _, _, w in edges)
    k, links = {}, {}
    for a, b, w in edges:
        for v, y in ((a, b), (b, a)):
            k[v] = k.get(v, 0.0) + w
            if a != b:
                near = links.setdefault(v, {})
                near[comm[y]] = near.get(comm[y], 0.0) + w
    tot = {c: sum(k[v] for v in comm if comm[v] == c) for c in set(comm.values())}
    for v, c in comm.items():
        near = links.get(v, {})
        stay = near.get(c, 0.0) - k[v] * (tot[c] - k[v]) / two_m
        if stay < -1e-6 or any(x - k[v] * tot[o] / two_m > stay + 1e-6 for o, x in near.items() if o != c):
            return False
    inner = [(a, b, w) for a, b, w in edges if comm[a] == comm[b]] + [(v, v, 0.0) for v in comm]
    found = roots(inner)
    return len(set(found.values())) == len(tot)


def frame(spark, edges, parts=3):
    return spark.createDataFrame(edges, "src long, dst long, weight double").repartition(parts)


def test_small_components_take_no_rounds_of_the_whole_graph(spark, monkeypatch):
    """rounds of the whole graph are some hundred jobs, which write and shuffle all its edges each time."""
    monkeypatch.setattr(louvain, "_settle", lambda *a, **k: pytest.fail("a round of the whole graph"))
    edges = [e for c in range(40) for e in clique(10 * c, 2 + c % 6)]
    res = louvain.louvain(frame(spark, edges), threshold=0.0)
    comm = {r.id: r.community for r in res.communities.collect()}
    nodes = sorted(comm)
    assert comm == {v: nodes.index(v - v % 10) for v in nodes} and res.num_communities == 40 and res.converged
    assert abs(res.modularity - quality(edges, comm)) < 1e-12 and res.levels > 1
    assert abs(res.trace[0] - quality(edges, {v: v for v in nodes})) < 1e-12 and res.trace[1:] == (res.modularity,)


def test_small_and_large_components_together(spark):
    """A component beyond ``edges_per_task`` goes on in rounds of Spark, the others in tasks."""
    edges = graph(1, 1_000, 20) + [e for c in range(6) for e in graph(c, 100 * c, 9)] + [(900, 900, 2.0)]
    sizes = {}
    for a, _, _ in edges:
        sizes[a // 100] = sizes.get(a // 100, 0) + 1
    most = max(n for h, n in sizes.items() if h < 9)
    assert most < sizes[10] + sizes.get(11, 0)
    res = louvain.louvain(frame(spark, edges), threshold=0.0, edges_per_task=most)
    comm = {r.id: r.community for r in res.communities.collect()}
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    assert sorted(comm) == nodes and res.converged and res.num_communities == len(set(comm.values()))
    assert all(c == min(nodes.index(v) for v in nodes if comm[v] == c) for c in set(comm.values()))
    assert abs(res.modularity - quality(edges, comm)) < 1e-9 and settled(edges, comm)
    assert all(b > a for a, b in zip(res.trace, res.trace[1:])) and abs(res.trace[-1] - res.modularity) < 1e-9
    assert abs(res.trace[0] - quality(edges, {v: v for v in nodes})) < 1e-9


def test_components_do_not_depend_on_partitions(spark):
    edges = [e for c in range(8) for e in graph(c, 100 * c, 12 + c)]
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            random.Random(parts).shuffle(edges)
            res = louvain.louvain(frame(spark, edges, parts), threshold=0.0)
            results.append((sorted(map(tuple, res.communities.collect())), round(res.modularity, 12), res.rounds, res.levels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_components_do_not_depend_on_who_shares_a_batch(monkeypatch):
    edges = [(a, b, w, c) for c in range(60) for a, b, w in graph(c, 100 * c, 1 + c)] + [(7_000, 7_000, 3.0, 70)]
    total = sum(e[2] for e in edges)
    unit = louvain._unit(total)
    two_m = 2 * sum(max(round(e[2] / unit), 1) for e in edges)
    src, dst, weight, part = (pa.array(x) for x in zip(*edges))
    table = pa.table({"src": pa.array([f"n{x}" for x in src.to_pylist()]), "dst": pa.array([f"n{x}" for x in dst.to_pylist()]), "weight": weight, "v_src": src, "v_dst": dst, "part": part})
    results = []
    for size in (1, 300, 1 << 18):
        monkeypatch.setattr(components, "BATCH", size)
        out = pa.Table.from_batches(components.solver(total, unit, two_m, 1e-9)(iter(table.to_batches(max_chunksize=50))))
        results.append(sorted(out.select(["id", "community", "levels", "rounds"]).to_pylist(), key=lambda r: r["id"]))
        comm = {int(i[1:]): c for i, c in zip(out["id"].to_pylist(), out["community"].to_pylist())}
        assert settled([e[:3] for e in edges], comm) and all(c <= v for v, c in comm.items())
        assert abs(np.nansum(out["q"].to_numpy()) - quality([e[:3] for e in edges], comm)) < 1e-12
    assert results[0] == results[1] == results[2]


def test_a_chain_takes_few_rounds():
    """Equal gains along a chain: its nodes do not wait for one another in the order of their numbers."""
    n = 3_000
    src = np.arange(n)
    table = pa.table({"src": src, "dst": src + 1, "weight": np.ones(n), "v_src": src, "v_dst": src + 1, "part": np.zeros(n, np.int64)})
    unit = louvain._unit(n)
    out = pa.Table.from_batches(components.solver(float(n), unit, 2.0 * n / unit, 1e-9)(iter(table.to_batches())))
    assert np.nansum(out["q"].to_numpy()) > 0.95 and max(out["rounds"].drop_null().to_pylist()) < 300


@pytest.mark.parametrize("hops", [0, 1, 8])
def test_parts_are_components(spark, monkeypatch, hops):
    """Small components are whole; what the hops do not close and what is large is left to the others. Nothing is lost."""
    monkeypatch.setattr(components, "HOPS", hops)
    chain = [(5_000 + i, 5_001 + i, 1.0) for i in range(200)]
    edges = [e for c in range(30) for e in graph(c, 100 * c, 2 + c % 9)] + graph(3, 4_000, 30) + chain + clique(9_000, 5)
    df = frame(spark, edges)
    part = {r.id: r.part for r in components.first_parts(df).collect()}
    rows = [(a, b, w, part[a], part[b]) for a, b, w in edges]
    small, others = components.parts_of(spark.createDataFrame(rows, "src long, dst long, weight double, p_src long, p_dst long"), 60)
    inside = [tuple(r) for r in small.select("src", "dst", "weight", "part").collect()]
    left = [tuple(r) for r in others.select("src", "dst", "weight").collect()]
    assert sorted([r[:3] for r in inside] + left) == sorted(edges)
    of = roots(edges)
    assert not {of[r[0]] for r in inside} & {of[r[0]] for r in left}
    assert len({r[3] for r in inside}) == len({(r[3], of[r[0]]) for r in inside}) == len({of[r[0]] for r in inside})
    assert {4_000, 5_000} <= {a for a, _, _ in left} and 9_000 in {r[0] for r in inside}
    if hops == 8:
        assert {of[a] for a, _, _ in left} == {of[4_000], of[5_000]}


def test_odd_edges_by_components(spark):
    none = louvain.louvain(spark.createDataFrame([], "src string, dst string, weight double"), threshold=0.0)
    assert none.communities.collect() == [] and none.modularity == 0.0 and none.converged
    odd = [("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), (None, "c", 1.0), ("c", "d", None), ("e", "f", 0.0), ("g", "h", 2.0), ("z", "z", 1.0)]
    res = louvain.louvain(spark.createDataFrame(odd, "src string, dst string, weight double"), threshold=0.0)
    assert {r.id: r.community for r in res.communities.collect()} == {"a": 0, "b": 0, "g": 2, "h": 2, "z": 4}
    mixed = louvain.louvain(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1)], "src int, dst long, weight int"), threshold=0.0)
    assert mixed.communities.schema["id"].dataType.simpleString() == "bigint" and mixed.num_communities == 1


def test_rounds_of_the_whole_graph_to_the_last_move(spark):
    """What test_mechanisms checks with threshold 0, without tasks for small components."""
    edges = [(2 * c, 2 * c + 1, 1.0) for c in range(6)]
    res = louvain.louvain(frame(spark, edges), threshold=0.0, edges_per_part=6, edges_per_task=0)
    assert sorted((r.id, r.community) for r in res.communities.collect()) == [(v, v - v % 2) for v in range(12)] and res.converged
    edges = graph(5, 0, 13)
    whole, tasks = (louvain.louvain(frame(spark, edges), threshold=0.0, edges_per_task=n) for n in (0, 1_000))
    for res in (whole, tasks):
        comm = {r.id: r.community for r in res.communities.collect()}
        assert settled(edges, comm) and abs(res.modularity - quality(edges, comm)) < 1e-9
