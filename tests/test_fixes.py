"""Hand-made rows for cases that the table queries do not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cograph.operators import classify, community, contrast, corpus, dictionary
from cograph.sources import io


def test_confusion_matrix_keeps_absent_classes(spark):
    pred = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "label int, pred int")
    rows = classify.confusion_matrix(pred).orderBy("true_label").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (1, 1, 2)]


def test_ego_graph_of_radius_two_holds_the_target_once(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4), (3, 4, 0.3)], "src int, dst int, weight double")
    nodes, kept = dictionary.ego_graph(edges, 1, radius=2)
    assert sorted((r.id, r.is_target) for r in nodes.collect()) == [(1, True), (2, False), (3, False)]
    assert sorted((r.src, r.dst) for r in kept.collect()) == [(1, 2), (2, 3)]


@pytest.mark.parametrize(("kind", "keys"), [("string", ["b", "ab", "a", "abc"]), ("long", [3, 1, 2])])
def test_sample_order_last_descends(spark, kind, keys):
    df = spark.createDataFrame([(k,) for k in keys], f"doc_id {kind}")
    got = corpus.sample_order(df, "last").orderBy("order_key").collect()
    assert [r.doc_id for r in got] == sorted(keys, reverse=True)


def test_tables_by_suffix(spark, tmp_path):
    src = str(tmp_path / "t.CSV")
    with open(src, "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    dst = io.csv_to_parquet(spark, src)
    assert dst == src[:-4] + ".parquet" and io.read_table(spark, dst).count() == io.read_table(spark, src).count() == 2
    assert io.read_table(spark, src).agg(F.sum("a")).first()[0] == 3
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "t.txt").write_text("x")
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "t.txt"))


def test_large_dictionary_runs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(7, 3))
    table = spark.createDataFrame([(i, w[i].tolist(), 0.1 * i, (-w[i]).tolist()) for i in range(7)], "feature int, w_enc array<double>, b_enc double, w_dec array<double>")
    x = spark.createDataFrame([(i, f"t{i}", rng.normal(size=3).tolist()) for i in range(11)], "ctx bigint, token string, vector array<double>")
    whole, blocked = dictionary.load_dictionary(table, [0.1, 0.2, 0.3]), dictionary.load_dictionary(table, [0.1, 0.2, 0.3], broadcast_cells=4)
    assert isinstance(whole, dictionary.Dictionary) and isinstance(blocked, dictionary.DictionaryTable)
    monkeypatch.setattr(dictionary, "BLOCK_CELLS", 6)
    monkeypatch.setattr(dictionary, "TILE_CELLS", 5)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for threshold in (0.0, None):
        a, b = (rows(dictionary.encode_features(x, dic, "ctx", "vector", threshold)) for dic in (whole, blocked))
        assert a == b and (threshold == 0.0 or len(a) == 77)
    a, b = (rows(dictionary.label_features(dic, x, 2, "token", "vector")) for dic in (whole, blocked))
    assert a == b and len(a) == 14


def test_pairwise_cosine_in_tiles(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    v[3] = 0
    t = spark.createDataFrame([(f"t{i}", i, v[i].tolist()) for i in range(30)], "topic string, ord int, delta array<double>")
    for blocks in (1, 4):
        got = {(r.topic1, r.topic2): r.cosine_similarity for r in contrast.pairwise_cosine(t, blocks=blocks).collect()}
        assert len(got) == 30 * 29 // 2
        assert got["t0", "t3"] is None and got["t3", "t4"] is None
        assert abs(got["t0", "t9"] - v[0] @ v[9] / np.linalg.norm(v[0]) / np.linalg.norm(v[9])) < 1e-12
    assert all(r.cosine_similarity >= 0.5 for r in contrast.pairwise_cosine(t, min_cosine=0.5).collect())


def test_cubic_svm_uses_all_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(x[9] > 0), x.tolist()) for x in rng.normal(size=(200, 10)) + 0.0]
    df = spark.createDataFrame(rows, "label int, z array<double>")
    train, _ = classify.svm_poly(df, df)
    assert classify.accuracy(train).first()[0] > 0.8


def test_louvain_on_cliques_converges(spark):
    edges = [(b + i, b + j, 1.0) for b in (0, 10, 20) for i in range(5) for j in range(i + 1, 5)]
    e = spark.createDataFrame(edges, "src int, dst int, weight double")
    res = community.louvain(e)
    assert res.converged and res.num_communities == 3
    assert not community.louvain(e, max_levels=0).converged


def test_louvain_queries_use_all_documents(spark, monkeypatch):
    from types import SimpleNamespace

    from cograph.plans import bindings, catalog

    seen, d = [], "/root/testdata/sf0.001"
    edges, nodes = bindings.words_graph(spark, d)
    monkeypatch.setattr(bindings, "_memo", {k: v for k, v in bindings._memo.items() if k[2] != "words_communities"})
    monkeypatch.setattr(catalog.CM, "louvain", lambda e: seen.append(e) or SimpleNamespace(communities=e))
    monkeypatch.setattr(catalog.CM, "analyze_graph", lambda e, name, n, found: seen.extend([found.communities, n]))
    catalog.QUERIES["louvain"](spark, d), catalog.QUERIES["analyze_graph"](spark, d)
    assert [x.count() for x in seen] == [edges.count(), edges.count(), nodes.count()]
    assert edges.count() > bindings.corpus_graph(spark, d, "anchor")[0].count()


def test_read_dictionary_of_any_size(spark, monkeypatch):
    from cograph.plans import catalog

    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, catalog.QUERIES["read_dictionary"](spark, d).collect()))
    load = dictionary.load_dictionary
    monkeypatch.setattr(io, "load_dictionary", lambda table, b_dec=None: load(table, b_dec, broadcast_cells=0))
    assert sorted(map(tuple, catalog.QUERIES["read_dictionary"](spark, d).collect())) == want and want


def test_kernel_features_hold_one_slab(spark):
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(2).normal(size=(4000, 8))
    rows = pa.array(x.tolist(), pa.list_(pa.float64()))
    for udf, n in ((classify._cubic_udf(8, 1024, 0.1, 1), 1024), (classify._rff_udf(8, 512, 0.1, 1), 512)):
        tracemalloc.start()
        out = udf.func(rows.slice(1))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 3999 and len(out[0]) == n
        assert peak < 1.5 * 8 * n * 4000  # the result and a slab
    with pytest.raises(ValueError):
        udf.func(pa.array([[1.0]], pa.list_(pa.float64())))


def test_corpus_directory_has_a_file_for_every_partition_of_the_input(spark, tmp_path):
    from cograph.plans import catalog

    spark.range(60).selectExpr("id AS doc_id", "'a' AS source", "id AS n_chars", "'t' AS text", "'de' AS lang").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        out = catalog.QUERIES["read_corpus_dir"](spark, str(tmp_path))
        assert out.count() == 60 and len(out.inputFiles()) >= 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
