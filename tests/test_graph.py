"""Golden G-1 (FIXTURES.md): phi graph, modularity, Louvain, degrees, ego graph."""

import pytest
from pyspark.sql import functions as F

from cograph.operators import community as CM
from cograph.operators import dictionary as D
from cograph.operators import graph as G

CTXS = [[1, 2, 3], [1, 2], [1, 2, 3], [4, 5], [4, 5, 6], [4, 5], [1, 4], [], [3, 6], [7]]


@pytest.fixture(scope="module")
def contexts(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(CTXS)], "ctx bigint, features array<int>")


def edges_of(e):
    return {(r.src, r.dst): round(r.weight, 6) for r in e.collect()}


def test_phi_min_cooc_1(contexts):
    e, n = G.build_graph(contexts, 1, 0.05)
    assert edges_of(e) == {
        (1, 2): 0.801784, (1, 3): 0.356348, (2, 3): 0.52381, (3, 6): 0.218218,
        (4, 5): 0.801784, (4, 6): 0.102062, (5, 6): 0.218218,
    }
    assert sorted(tuple(r) for r in n.collect()) == [(1, 4), (2, 3), (3, 3), (4, 4), (5, 3), (6, 2)]
    c = G.graph_counts(e, n).first()
    assert (c.nodes, c.edges, round(c.density, 6)) == (6, 7, 0.466667)


def test_phi_min_cooc_2(contexts):
    e, n = G.build_graph(contexts, 2, 0.05)
    assert set(edges_of(e)) == {(1, 2), (1, 3), (2, 3), (4, 5)}
    c = G.graph_counts(e, n).first()
    assert (c.nodes, c.edges, round(c.density, 6)) == (5, 4, 0.4)


def test_empty_context_counts_in_n(contexts):
    assert G.context_count(contexts).first()[0] == 10
    freq = {r.feature: r.frequency for r in G.feature_frequency(contexts).collect()}
    assert freq == {1: 4, 2: 3, 3: 3, 4: 4, 5: 3, 6: 2, 7: 1}


def test_feature_in_every_context_has_no_edge(spark):
    ctxs = [c + [9] for c in CTXS]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(ctxs)], "ctx bigint, features array<int>")
    e, _ = G.build_graph(df, 1, 0.05)
    assert all(9 not in k for k in edges_of(e))
    assert len(edges_of(e)) == 7


def test_negative_threshold_never_emits_absent_pairs(contexts):
    e, _ = G.build_graph(contexts, 1, -1.0)
    got = edges_of(e)
    assert (1, 4) in got and round(got[(1, 4)], 2) == -0.25
    assert (1, 5) not in got  # never co-occur


def test_vocabulary_size(spark, contexts):
    assert G.vocabulary_size(contexts).first()[0] == 8
    empty = spark.createDataFrame([(0, [])], "ctx bigint, features array<int>")
    assert G.vocabulary_size(empty).first()[0] == 1


@pytest.mark.parametrize("mc,best_q,single_q", [(1, 0.410636, -0.176602), (2, 0.437211, -0.209068)])
def test_modularity_and_louvain(spark, contexts, mc, best_q, single_q):
    e, n = G.build_graph(contexts, mc, 0.05)
    single = n.select("id", F.col("id").alias("community"))
    assert round(CM.modularity_value(e, single), 6) == single_q
    res = CM.louvain(e)
    assert round(res.modularity, 6) == best_q
    assert round(CM.modularity_value(e, res.communities), 6) == best_q
    groups = {}
    for r in res.communities.collect():
        groups.setdefault(r.community, set()).add(r.id)
    expected = [{1, 2, 3}, {4, 5, 6}] if mc == 1 else [{1, 2, 3}, {4, 5}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected))
    # every node has exactly one community
    assert res.communities.count() == n.count()


def test_weighted_degree(contexts):
    e, _ = G.build_graph(contexts, 1, 0.05)
    wd = {r.id: round(r.weighted_degree, 6) for r in G.weighted_degree(e).collect()}
    assert wd == {1: 1.158132, 2: 1.325593, 3: 1.098376, 4: 0.903846, 5: 1.020002, 6: 0.538498}


def test_ego_graph(contexts):
    e, _ = G.build_graph(contexts, 1, 0.05)
    nodes, edges = D.ego_graph(e, 3)
    assert sorted(r.id for r in nodes.collect()) == [1, 2, 3, 6]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(1, 2), (1, 3), (2, 3), (3, 6)]
    missing_nodes, missing_edges = D.ego_graph(e, 42)
    assert missing_nodes.count() == 0 and missing_edges.count() == 0


def test_neighbours_and_format(spark, contexts):
    e, _ = G.build_graph(contexts, 1, 0.05)
    ids = spark.createDataFrame([(3,), (7,)], "feature int")
    out = {r.feature: r.neighbors for r in D.format_neighbours(D.neighbours(e, ids, 4)).collect()}
    assert out[3] == "1(0.36) | 2(0.52)".replace("1(0.36) | 2(0.52)", "2(0.52) | 1(0.36) | 6(0.22)")
    assert out[7] == "ISOLATED"


def test_verdict(spark):
    stats = spark.createDataFrame(
        [("a", 1, 1, 0.1, 0.40, 2), ("b", 1, 1, 0.1, 0.46, 2)],
        "graph string, nodes bigint, edges bigint, density double, modularity double, num_communities bigint",
    )
    v = CM.polarization_verdict(stats, "a", "b").first()
    assert v.verdict == CM.VERDICT_POLARIZED
    v = CM.polarization_verdict(stats, "b", "a").first()
    assert v.verdict == CM.VERDICT_INTEGRATED


def test_empty_graph_analysis(spark):
    e = spark.createDataFrame([], "src int, dst int, weight double")
    row = CM.analyze_graph(e, "empty").first()
    assert (row.edges, row.modularity, row.num_communities) == (0, 0.0, 0)


# ---------------------------------------------------------------- pairs counted inside the tasks
def _brute(rows, low):
    from collections import Counter

    found = Counter()
    for fs in rows:
        fs = sorted(fs)
        found.update((a, b) for i, a in enumerate(fs) for b in fs[i + 1 :])
    return {p: n for p, n in found.items() if n >= low}


def test_pairs_are_shuffled_as_blocks(spark):
    rows = [(i, [f"w{(i * k) % 37}" for k in range(1, 12)]) for i in range(400)]
    ctx = spark.createDataFrame(rows, "ctx long, features array<string>")
    pairs = G.cooccurrence_pairs(ctx, 3)
    plan = pairs._jdf.queryExecution().toString()
    assert "hashpartitioning(fi" not in plan and "block" in plan
    want = _brute([set(fs) for _, fs in rows], 3)
    assert {(r.i, r.j): r.n_ij for r in pairs.collect()} == want


def test_more_features_than_tasks_are_sent_and_repeated_contexts(spark, monkeypatch):
    rows = [(i % 90, [(i * k) % 23 if k % 9 else None for k in range(1, 12)]) for i in range(120)] + [(None, [1, 2]), (None, [2, 3]), (200, None), (201, [])]
    ctx = spark.createDataFrame(rows, "ctx long, features array<int>")
    groups = {}
    for key, fs in rows:
        groups.setdefault(key, []).extend(set(fs or []) - {None})
    want = _brute(groups.values(), 1)
    for most in (G.KNOWN_FEATURES, 0):
        monkeypatch.setattr(G, "KNOWN_FEATURES", most)
        assert {(r.i, r.j): r.n_ij for r in G.cooccurrence_pairs(ctx).collect()} == want


def test_blocks_hold_every_pair(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from cograph.operators import pairs as P

    for name, value in (("CHUNK", 500), ("SLAB", 64), ("MERGED", 300), ("WIDE", 20), ("ROWS", 50)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(60, rng.integers(0, 40), replace=False).tolist()) for _ in range(80)]
    batch = pa.record_batch([pa.array(rows, pa.list_(pa.int32())), pa.array([[5] * len(r) for r in rows], pa.list_(pa.int64()))], names=["fids", "ns"])
    cuts = np.array([700, 1500, 2600])
    sent = [b for part in (batch.slice(0, 30), batch.slice(30)) for b in P.sender(None, 60, cuts, lambda a, b: np.ones(np.shape(b), bool))(iter([part]))]
    got = {}
    for part in range(4):
        blocks = [pa.record_batch([b.column(0).filter(pa.compute.equal(b.column(0), part)), b.column(1).filter(pa.compute.equal(b.column(0), part))], names=["part", "block"]) for b in sent]
        for out in P.merger(60, 2)(iter(blocks)):
            got.update({(r["fi"], r["fj"]): r["n_ij"] for r in out.to_pylist()})
    assert got == _brute(rows, 2)


def test_counts_beyond_an_entry():
    import numpy as np

    from cograph.operators import pairs as P

    p, n = np.array([3, 9, 2**50]), np.array([1, 100_000, 4095])
    assert [x.tolist() for x in P.unpack(P.pack(p, n))] == [p.tolist(), n.tolist()]
    assert [x.tolist() for x in P.add_up(P.entries(p, n, 12), 12)] == [p.tolist(), n.tolist()]
    assert P.count_bits(2**31) == 1 and P.count_bits(10) == 12
