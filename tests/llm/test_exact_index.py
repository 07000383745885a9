"""Operator 7: directories over all bits, results through the owners' chains, hot texts, plans."""

import random
from collections import defaultdict

import pytest

from cograph.llm import exact


def _truth(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize(("capacity", "depth", "hot"), [(2048, 16, 1000), (1, 3, 2), (2, 5, 1), (1, 64, 10), (3, 7, 10**9)])
def test_result_through_the_owners_equals_grouping(spark, monkeypatch, capacity, depth, hot):
    if depth == 64:
        depth = 13  # 5 directories of a key, the last of 12 bits
    monkeypatch.setattr(exact, "HOT", hot)
    rng = random.Random(capacity)
    rows = [(i, rng.choice(["same", "same", None, "", f"t{rng.randrange(60)}", f"u{i}"])) for i in range(400)] + [(None, "same"), (None, "alone"), (7, "t1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.mark_duplicates(df, capacity=capacity, depth=depth).collect()
    truth = _truth(rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    assert all((r.keep_id, r.group_size, r.kept) == (*truth[r.doc_id, r.text], r.doc_id == truth[r.doc_id, r.text][0]) for r in got)


def test_overfull_buckets_split_to_the_last_bit(spark):
    keys = [(5 << 48) | i for i in range(40)] + [-1, -2, 0, 1 << 62]  # 40 keys differ in their last 6 bits only
    pointers = exact.Directory(spark.createDataFrame([(k,) for k in keys], "__key long"), 2, 16)
    assert [(skip, width) for _, skip, width in pointers.levels] == [(0, 16), (16, 16), (32, 16), (48, 16)]
    owner = {r["__key"]: r["__bucket"] for r in pointers.owned(spark.createDataFrame([(k,) for k in keys], "__key long")).collect()}
    load = defaultdict(int)
    for k in keys:
        load[owner[k]] += 1
    assert len(owner) == len(keys) and None not in load and max(load.values()) <= 2


def test_chains_number_texts_of_one_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    same = lambda docs, text: docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__key", F.length("__text").cast("long"))  # noqa: E731  every text of a length collides
    monkeypatch.setattr(exact, "_keyed", same)
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "cc", "aa", "b", None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index, _ = exact.build_index(df, capacity=1)
    assert sorted((r["__key"], r.chain) for r in index.collect()) == [(0, 1), (1, 1), (2, 1), (2, 2), (2, 3)]
    truth = _truth(rows)
    assert all((r.keep_id, r.group_size) == truth[r.doc_id, r.text] for r in exact.mark_duplicates(df, capacity=1).collect())


def test_clashing_columns_and_no_texts_in_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, True), (2, "a", "y", 6, False)], "doc_id long, text string, keep_id string, chain int, kept boolean")
    out = exact.mark_duplicates(df)
    assert sorted((r.doc_id, r.keep_id, r.chain, r.kept) for r in out.collect()) == [(1, 2, 5, False), (2, 2, 6, True)]
