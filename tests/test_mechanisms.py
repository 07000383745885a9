"""Louvain with a frontier and refinement, cutoffs without ranking, dictionaries in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cograph.operators import corpus, dictionary, louvain, order, splits
from cograph.operators.modularity import modularity_value


def planted(seed=1, groups=3, size=7, inside=0.7, outside=0.06):
    rng = random.Random(seed)
    n = groups * size
    return [(f"n{i:03d}", f"n{j:03d}", round(rng.uniform(0.1, 1.0), 6)) for i in range(n) for j in range(i + 1, n)
            if rng.random() < (inside if i // size == j // size else outside)]


def components(nodes, pairs):
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        up[root(a)] = root(b)
    return len({root(v) for v in nodes})


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


def frame(spark, edges, parts=3):
    return spark.createDataFrame(edges, "src string, dst string, weight double").repartition(parts)


def test_louvain_finds_planted_communities_that_no_single_move_improves(spark):
    edges = planted()
    res = louvain.louvain(frame(spark, edges), threshold=0.0)
    comm = {r.id: r.community for r in res.communities.collect()}
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    assert sorted(comm) == nodes and res.converged and res.num_communities == len(set(comm.values()))
    q = quality(edges, comm)
    truth = quality(edges, {v: int(v[1:]) // 7 for v in nodes})
    assert abs(q - res.modularity) < 1e-9 and q >= truth - 1e-9
    # Q rises in every round, and the differences add up to it
    assert all(b > a for a, b in zip(res.trace, res.trace[1:])) and abs(res.trace[-1] - q) < 1e-6
    assert abs(res.trace[0] - quality(edges, {v: v for v in nodes})) < 1e-6
    for v in nodes:  # neither to another community nor to one of its own
        for c in {*comm.values(), "new"} - {comm[v]}:
            assert quality(edges, comm | {v: c}) <= q + 1e-9
    for c in set(comm.values()):
        members = [v for v in nodes if comm[v] == c]
        assert components(members, [(a, b) for a, b, _ in edges if comm[a] == comm[b] == c]) == 1
        assert c == min(nodes.index(v) for v in members)


def test_louvain_does_not_depend_on_partitions(spark):
    edges = planted(seed=4, groups=2, size=7)
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            random.Random(parts).shuffle(edges)
            res = louvain.louvain(frame(spark, edges, parts), max_levels=1, max_rounds=2)
            results.append((sorted(map(tuple, res.communities.collect())), [round(x, 12) for x in res.trace], res.rounds))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_louvain_reads_directories_of_active_nodes(spark):
    edges = planted(seed=2, groups=2, size=6)
    whole, dealt = (louvain.louvain(frame(spark, edges), max_levels=1, max_rounds=2, edges_per_part=n) for n in (louvain.EDGES_PER_PART, 20))
    assert sorted(map(tuple, whole.communities.collect())) == sorted(map(tuple, dealt.communities.collect()))
    sym = spark.createDataFrame([(i, i + 1, 1.0, 2.0) for i in range(200)], "id long, nbr long, weight double, k double")
    adj = louvain._Adjacency.write(sym, 200, 20)
    near = adj.near(spark.createDataFrame([(7,)], "id long"))
    assert adj.parts == 10 and near.where("id = 7").count() == 1 and near.count() < 60


def test_louvain_on_cliques_with_directories(spark):
    """Contracted cliques leave a graph of loops: no edges between nodes, so no directory is written."""
    edges = [(2 * c, 2 * c + 1, 1.0) for c in range(6)]
    res = louvain.louvain(spark.createDataFrame(edges, "src long, dst long, weight double"), threshold=0.0, edges_per_part=6)
    assert sorted((r.id, r.community) for r in res.communities.collect()) == [(v, v - v % 2) for v in range(12)] and res.converged


def test_refinement_splits_a_community_that_is_not_connected(spark):
    """Two triangles in one community without an edge between them become two parts."""
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    edges = spark.createDataFrame([(a, b, 4.0) for a, b in pairs], "src long, dst long, weight double")
    k = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k"))
    sym = edges.selectExpr("src AS id", "dst AS nbr", "weight").union(edges.selectExpr("dst", "src", "weight")).join(k, "id")
    adj = louvain._Adjacency.write(sym, 12, 1_000)
    comm = k.select("id", F.lit(0).cast("long").alias("community"), "k", F.lit(48.0).alias("tot"))
    parts, _ = louvain._refine(adj, comm, 48.0, 1e-9, 0, 1_000, 0.0)
    found = {r.id: r.community for r in parts.collect()}
    assert len({found[v] for v in (0, 1, 2)}) == len({found[v] for v in (3, 4, 5)}) == 1 and found[0] != found[3]


def test_moves_made_together_raise_q_as_told(spark):
    """One round on a random partition: what it says Q gains is what it gains, and neighbours never swap."""
    edges = planted(seed=7, groups=4, size=10, inside=0.3, outside=0.1)
    names = sorted({v for a, b, _ in edges for v in (a, b)})
    ints = [(names.index(a), names.index(b), float(round(w * 1_000))) for a, b, w in edges]
    rng = random.Random(3)
    start = {i: rng.randrange(6) for i in range(len(names))}
    e = spark.createDataFrame(ints, "src long, dst long, weight double")
    k = {i: sum(w for a, b, w in ints if i in (a, b)) for i in start}
    tot = {c: sum(k[i] for i in start if start[i] == c) for c in range(6)}
    comm = spark.createDataFrame([(i, c, k[i], tot[c]) for i, c in start.items()], "id long, community long, k double, tot double")
    two_m = 2 * sum(w for _, _, w in ints)
    sym = e.selectExpr("src AS id", "dst AS nbr", "weight").union(e.selectExpr("dst", "src", "weight")).join(comm.select("id", "k"), "id")
    adj = louvain._Adjacency.write(sym, 2 * len(ints), 1_000_000)
    comm = comm.withColumn("free", F.lit(True))
    wants = louvain.cut_lineage(louvain._wants(adj, comm, True, two_m, 1e-9, 0, False))
    after = louvain.cut_lineage(louvain._after(adj, comm, wants, louvain.cut_lineage(louvain._together(wants, two_m, 0))))
    gain = louvain._settle(adj, comm, two_m, 1e-9, 0, 1)[1][0]
    rows = {r.id: r for r in after.collect()}
    moved = {i: r.community for i, r in rows.items()}
    assert abs(quality(ints, moved) - quality(ints, start) - gain) < 1e-12 and gain > 0
    for c in set(moved.values()):
        assert {rows[i].tot for i in moved if moved[i] == c} == {sum(k[i] for i in moved if moved[i] == c)}
    movers = {i for i in start if moved[i] != start[i]}
    assert not {start[i] for i in movers} & {moved[i] for i in movers}
    asked = {r.id for r in rows.values() if r.active}
    waiting = {r.id for r in wants.collect()} - movers
    assert waiting <= asked and all(i in asked for a, b, _ in ints for i, v in ((a, b), (b, a)) if v in movers and moved[i] != moved[v])


def test_louvain_edge_cases(spark):
    none = louvain.louvain(spark.createDataFrame([], "src string, dst string, weight double"))
    assert none.communities.collect() == [] and none.modularity == 0.0 and none.converged
    odd = [("a", "a", 1.0), ("a", "b", 0.5), ("a", "b", 0.5), (None, "c", 1.0), ("c", "d", None), ("e", "f", 0.0), ("g", "h", 2.0)]
    res = louvain.louvain(spark.createDataFrame(odd, "src string, dst string, weight double"))
    comm = {r.id: r.community for r in res.communities.collect()}
    assert sorted(comm) == ["a", "b", "g", "h"] and comm["a"] == comm["b"] != comm["g"] == comm["h"]
    assert not louvain.louvain(spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double"), max_levels=0).converged


# ---------------------------------------------------------------- order without ranking
@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(5)
    rows = [(i, [f"w{j}" for j in range(rng.randint(0, 9))]) for i in range(900)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, ids array<string>").repartition(5)


@pytest.mark.parametrize("strategy", ["first", "last", "random"])
def test_accumulate_is_a_prefix_of_whole_batches(tokens, strategy):
    ordered = corpus.sample_order(tokens, strategy)
    rows = sorted(ordered.collect(), key=lambda r: tuple(r.order_key))
    for target in (1, 500, 2_000, sum(len(r.ids) for r in rows), 10**9):
        total, expected = 0, []
        for a in range(0, len(rows), 25):
            if total >= target:
                break
            expected += [r.doc_id for r in rows[a : a + 25]]
            total += sum(len(r.ids) for r in rows[a : a + 25])
        got = corpus.accumulate_tokens(ordered, target, 25)
        assert sorted(r.doc_id for r in got.collect()) == sorted(expected)
        assert got.columns == ordered.columns
    assert corpus.accumulate_tokens(ordered, 0).count() == 0


def test_accumulate_filters_the_scan(spark, tokens, tmp_path):
    tokens.write.parquet(f"{tmp_path}/t")
    ordered = corpus.sample_order(spark.read.parquet(f"{tmp_path}/t"), "first")
    plan = corpus.accumulate_tokens(ordered, 500, 25)._jdf.queryExecution().toString()
    assert "LessThan(doc_id" in plan and "Exchange" not in plan


def test_truncate_takes_the_first_contexts(tokens):
    c = tokens.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("win"), "ids")
    whole = sorted((r.doc_id, r.win) for r in c.collect())
    for n in (0, 1, 777, 1_800, 5_000):
        assert sorted((r.doc_id, r.win) for r in corpus.truncate_contexts(c, n, ["doc_id", "win"]).collect()) == whole[:n]


def test_keys_at_ranks_and_totals(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKET_ROWS", 3)
    monkeypatch.setattr(order, "HEX_DIGITS", 1)
    rows = [(i, f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k string")
    expected = sorted((r["h"], r["k"]) for r in df.select(F.md5("k").alias("h"), "k").collect())
    got = order.hash_cutoffs(df, F.md5("k"), "k", [0, 17, 250, 499, 500, 9_999])
    assert [tuple(x) if x else None for x in got] == [expected[0], expected[17], expected[250], expected[499], None, None]
    ranges = order.Ranges(df, "i", F.col("i"))
    assert [ranges.key_at(i) for i in (0, 123, 499)] == [0, 123, 499] and ranges.count == 500
    for total in (0, 1, 3, 4, 1_000, 124_750, 124_751):
        upto, n = 0, 0
        while n < 500 and upto < total:
            upto += n
            n += 1
        assert ranges.rank_reaching(total) == (None if upto < total else n)
    none = df.where("false")
    assert order.hash_cutoffs(none, F.md5("k"), "k", [0]) == [None] and order.Ranges(none, "i").rank_reaching(1) is None


def test_split_sizes_are_exact_and_nothing_is_shuffled(spark):
    df = spark.range(1_003).withColumnRenamed("id", "key")
    s = splits.split_3way(df, "key")
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert (sizes["train"], sizes["valid"], sizes["test"]) == splits.split_sizes(1_003, 0.7, 0.15, 0.15)
    assert "Exchange" not in s._jdf.queryExecution().toString()
    again = splits.split_3way(df.repartition(7), "key")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))
    assert splits.split_3way(df.where("false"), "key").count() == 0


# ---------------------------------------------------------------- dictionaries in blocks
def test_blocks_cover_the_dictionary_and_rows_are_read_once(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(23, 5))
    table = spark.createDataFrame([(i, w[i].tolist(), 0.01 * i, (2 * w[i]).tolist()) for i in range(23)], "feature int, w_enc array<double>, b_enc double, w_dec array<double>")
    d = dictionary.load_dictionary(table, broadcast_cells=0, block_cells=20)
    blocks = list(d.blocks(["w_enc", "b_enc", "w_dec"]))
    assert len(blocks) > 2 and sorted(np.concatenate([b[0] for b in blocks]).tolist()) == list(range(23))
    for feats, enc, bias, dec in blocks:
        assert np.array_equal(enc, w[feats]) and np.array_equal(dec, 2 * w[feats]) and np.allclose(bias, 0.01 * feats)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    x = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(40)], "ctx long, vector array<double>")
    rows = dictionary.encode_features(x.mapInPandas(count, x.schema), d, "ctx", "vector", threshold=None).count()
    assert rows == 40 * 23 and seen.value == 40


def test_modularity_module(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0), (1, 1, 0.5)], "src long, dst long, weight double")
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, community long")
    assert abs(modularity_value(e, c) - (1.5 / 2.5 - (3 / 5) ** 2 + 1 / 2.5 - (2 / 5) ** 2)) < 1e-12
