"""Phi co-occurrence graph (G4 = J1 + J2 + A5) and plain graph aggregates.

Input is a *contexts* table ``(ctx, features array<T>)`` — one row per context, empty arrays
allowed (they count in N). Feature ids may be any orderable type (int ids, words, part keys).

Plan at scale
-------------
* frequency n_i: explode + partial/final hash aggregate (hot features are combined map-side);
* lossless prefilters before any pair is formed: n_i >= min_cooc (since n_ij <= min(n_i, n_j))
  and n_i < N (zero denominator, never an edge);
* contexts become sorted arrays of feature numbers inside the tasks, which get the hashes of the kept features (up to
  ``KNOWN_FEATURES``; beyond, a join numbers them), so no occurrence of a feature is shuffled;
* pairs are formed and counted inside the tasks, the upper triangle i < j only; a phi upper bound computed from
  (n_i, n_j) drops hopeless pairs; counted chunks are shuffled as packed ranges of pairs (``pairs``);
* n_ij: one task adds up a range of pairs and gives back those with n_ij >= min_cooc.
Contexts must be bounded (the text source windows long documents) so a context emits at most
k(k-1)/2 pair rows for its k kept features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import pairs as P

# Defaults of the reference configuration (fixed values).
MIN_COOCCURRENCE = 5
PHI_THRESHOLD = 0.05
# Margin that keeps the phi upper-bound prefilter strictly lossless under float rounding.
_BOUND_MARGIN = 1e-9
KNOWN_FEATURES = 4_000_000  # kept features (20 bytes each) that are sent to the tasks; beyond, contexts are numbered by a join
SAMPLED_CONTEXTS = 4_000  # contexts that set the ranges of pairs; any ranges give the same counts
_HASHED = ("string", "byte", "short", "integer", "long")  # types whose equal values have equal hashes


def long_form(contexts: DataFrame, ctx: str = "ctx", features: str = "features") -> DataFrame:
    """One row per (context, distinct feature); empty contexts vanish here (use N separately)."""
    return contexts.select(F.col(ctx).alias("ctx"), F.explode(F.array_distinct(F.col(features))).alias("feature"))


def context_count(contexts: DataFrame) -> DataFrame:
    """A2: N, counting contexts with an empty feature set."""
    return contexts.agg(F.count(F.lit(1)).alias("n_contexts"))


def feature_frequency(contexts: DataFrame, ctx: str = "ctx", features: str = "features") -> DataFrame:
    """A3: n_i = number of contexts containing feature i."""
    return long_form(contexts, ctx, features).groupBy("feature").agg(F.count(F.lit(1)).alias("frequency"))


def vocabulary_size(contexts: DataFrame, features: str = "features") -> DataFrame:
    """A4: max feature id + 1 over integer ids (0-based); 1 when there is no feature at all."""
    return contexts.select(F.explode(F.col(features)).alias("f")).agg(
        (F.coalesce(F.max("f").cast("bigint"), F.lit(0)) + 1).alias("vocabulary_size")
    )


def _phi(n_ij: Column, n_i: Column, n_j: Column, n: float) -> Column:
    # Same arithmetic as the reference: (N*n_ij - n_i*n_j) / (sqrt(n_i(N-n_i)) * sqrt(n_j(N-n_j))), in double.
    d_i = F.sqrt(n_i.cast("double") * (F.lit(float(n)) - n_i.cast("double")))
    d_j = F.sqrt(n_j.cast("double") * (F.lit(float(n)) - n_j.cast("double")))
    num = F.lit(float(n)) * n_ij.cast("double") - n_i.cast("double") * n_j.cast("double")
    return num / (d_i * d_j)


def cooccurrence_pairs(
    contexts: DataFrame,
    min_count: int = 1,
    ctx: str = "ctx",
    features: str = "features",
) -> DataFrame:
    """(i, j, n_ij) for every feature pair sharing a context, i < j, n_ij >= min_count.

    Features with n_i < min_count are dropped before pairing (lossless: n_ij <= n_i).
    """
    freq = feature_frequency(contexts, ctx, features)
    ids = _feature_ids(freq.filter(F.col("frequency") >= min_count))
    counted = _pairs(contexts, ids, ctx, features, n_contexts=None, phi_threshold=None, min_count=min_count)
    return _decode(counted, ids).select("i", "j", "n_ij")


def _feature_ids(kept: DataFrame) -> DataFrame:
    """Dense int ids in feature order (so id order == feature order), materialised once.

    Pairs are then formed, shuffled and counted as two ints instead of two feature values.
    """
    from .corpus import global_index

    return global_index(kept.select("feature", "frequency"), "feature", "fid").withColumn("fid", F.col("fid").cast("int"))


def _sets(contexts: DataFrame, ids: DataFrame, ctx: str, features: str) -> tuple[DataFrame, tuple | None]:
    """The kept features of every context, and what is needed to number them.

    Up to ``KNOWN_FEATURES`` kept features: (key, h), the hashes of all features of a context, with the sorted hashes of
    the kept ones, their ids and frequencies, which go to the tasks; beyond, or if a feature's hash does not
    tell it apart: (key, fids, ns) by a join. Rows that repeat a context key are one context that has their features.
    """
    key = F.xxhash64(F.col(ctx)).alias("key")
    kind = contexts.schema[features].dataType.elementType.typeName()
    if kind in _HASHED and (n := ids.count()) <= KNOWN_FEATURES:
        got = ids.where("feature IS NOT NULL").select(F.xxhash64("feature").alias("h"), "fid", "frequency").toArrow()
        h, fid, frequency = (got[c].to_numpy() for c in ("h", "fid", "frequency"))
        order = np.argsort(h)
        h, fid, frequency = h[order], fid[order], frequency[order]
        if (h[1:] != h[:-1]).all():
            hashes = F.transform(F.filter(F.array_distinct(F.col(features)), lambda x: x.isNotNull()), lambda x: F.xxhash64(x))
            rows = contexts.where(F.col(features).isNotNull()).select(key, F.col(ctx).alias("ctx"), hashes.alias("h"))
            # few keys, as a rule none, repeat; equal hashes of different keys only send rows to the grouping
            twice = cut_lineage(contexts.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
            if twice.isEmpty():
                return rows.select("key", "h"), (h, fid, frequency)
            grouped = rows.join(twice, "key", "left_semi").groupBy("key", "ctx").agg(F.flatten(F.collect_list("h")).alias("h"))
            return rows.join(twice, "key", "left_anti").select("key", "h").unionByName(grouped.select("key", "h")), (h, fid, frequency)
    lf = long_form(contexts, ctx, features).join(ids.select("feature", "fid", "frequency"), "feature")
    rows = lf.groupBy("ctx").agg(F.collect_list("fid").alias("fids"), F.collect_list("frequency").alias("ns"))
    return cut_lineage(rows.select(F.xxhash64("ctx").alias("key"), "fids", "ns")), None


def _pairs(contexts, ids, ctx, features, n_contexts, phi_threshold, min_count) -> DataFrame:
    """(fi, fj, n_ij) over int ids; ``ids`` is (feature, frequency, fid)."""
    spark = contexts.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # blocks are long rows
    sets, known = _sets(contexts, ids, ctx, features)
    columns, size = sets.columns[1:], max(ids.count(), 1)
    n, least = n_contexts, None
    if phi_threshold is not None and n is not None and phi_threshold >= 0:
        least = phi_threshold - _BOUND_MARGIN

    def hopeful(n_i, n_j):
        """Pairs whose largest possible phi, that at n_ij = min(n_i, n_j), is above the threshold."""
        if least is None:
            return np.ones(np.shape(n_j), bool)
        lo, hi = np.minimum(n_i, n_j).astype(float), np.maximum(n_i, n_j).astype(float)
        return np.sqrt(lo * (n - hi) / (hi * (n - lo))) > least

    rows = contexts.count() if n is None else n
    every = max(1, rows // SAMPLED_CONTEXTS)
    sample = sets.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select(*columns).toArrow().combine_chunks()
    total, some = (0.0, np.zeros(0, np.int64))
    if sample.num_rows:
        total, some = P.sampled(sample.to_batches()[0], known, size, hopeful)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(shuffled, int(total * every) >> 18), int(total * every) // P.MERGED)
    cuts = np.unique(some[np.arange(1, parts) * len(some) // parts]) if len(some) else some
    blocks = sets.select(*columns).mapInArrow(P.sender(known and spark.sparkContext.broadcast(known), size, cuts, hopeful), "part int, block binary")
    return blocks.repartitionById(len(cuts) + 1, F.col("part")).mapInArrow(P.merger(size, min_count), "fi int, fj int, n_ij bigint")


def _decode(counted: DataFrame, ids: DataFrame) -> DataFrame:
    """Map int pair ids back to features, carrying both frequencies: (i, j, n_ij, n_i, n_j)."""
    a = ids.select(F.col("fid").alias("fi"), F.col("feature").alias("i"), F.col("frequency").alias("n_i"))
    b = ids.select(F.col("fid").alias("fj"), F.col("feature").alias("j"), F.col("frequency").alias("n_j"))
    return counted.join(a, "fi").join(b, "fj").select("i", "j", "n_ij", "n_i", "n_j")


def phi_edges(
    pairs: DataFrame,
    frequency: DataFrame,
    n_contexts: int,
    min_cooccurrence: int = MIN_COOCCURRENCE,
    phi_threshold: float = PHI_THRESHOLD,
) -> DataFrame:
    """Weight pairs by phi; keep n_ij >= min_cooc, non-zero denominator, phi > threshold (strict)."""
    fi = frequency.select(F.col("feature").alias("i"), F.col("frequency").alias("n_i"))
    fj = frequency.select(F.col("feature").alias("j"), F.col("frequency").alias("n_j"))
    p = pairs.filter(F.col("n_ij") >= min_cooccurrence).join(fi, "i").join(fj, "j")
    return _weigh(p, n_contexts, phi_threshold)


def build_graph(
    contexts: DataFrame,
    min_cooccurrence: int = MIN_COOCCURRENCE,
    phi_threshold: float = PHI_THRESHOLD,
    ctx: str = "ctx",
    features: str = "features",
    n_contexts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(edges(src, dst, weight), nodes(id, frequency))`` of the phi graph.

    N (``n_contexts``) is counted on the contexts table unless given; it includes empty contexts.
    """
    n = contexts.count() if n_contexts is None else int(n_contexts)
    min_c = max(int(min_cooccurrence), 1)
    freq = feature_frequency(contexts, ctx, features)
    # Prefilters: n_ij <= min(n_i, n_j), and n_i == N gives a zero denominator. The kept table is
    # one row per feature; it gets dense int ids once and is reused for pairing and decoding.
    ids = _feature_ids(freq.filter((F.col("frequency") >= min_c) & (F.col("frequency") < F.lit(n))))
    counted = _pairs(contexts, ids, ctx, features, n_contexts=n, phi_threshold=phi_threshold, min_count=min_c)
    decoded = _decode(counted.filter(F.col("n_ij") >= int(min_cooccurrence)), ids)
    edges = cut_lineage(_weigh(decoded, n, phi_threshold))  # the nodes are read off the edges: pairs are counted once
    nodes = node_attributes(edges, ids.select("feature", "frequency"))
    return edges, nodes


def _weigh(p: DataFrame, n: float, phi_threshold: float) -> DataFrame:
    n = float(n)
    denom_ok = (F.col("n_i") < F.lit(n)) & (F.col("n_j") < F.lit(n)) & (F.col("n_i") > 0) & (F.col("n_j") > 0)
    phi = _phi(F.col("n_ij"), F.col("n_i"), F.col("n_j"), n)
    return (
        p.filter(denom_ok)
        .select(F.col("i").alias("src"), F.col("j").alias("dst"), phi.alias("weight"))
        .filter(F.col("weight") > F.lit(float(phi_threshold)))
    )


def node_attributes(edges: DataFrame, frequency: DataFrame) -> DataFrame:
    """A5: (id, frequency) for features with at least one edge."""
    ends = edges.select(F.col("src").alias("feature")).union(edges.select(F.col("dst").alias("feature")))
    return frequency.join(ends, "feature", "left_semi").select(
        F.col("feature").alias("id"), F.col("frequency").cast("bigint").alias("frequency")
    )


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge: (id, nbr, weight)."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight").union(
        edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "weight")
    )


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, density = 2E / (V(V-1)); 0 density when V < 2."""
    if nodes is None:
        v = edges.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("nodes"))
    else:
        v = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    vn, en = v.first()[0], e.first()[0]
    density = (2.0 * en / (vn * (vn - 1))) if vn and vn > 1 else 0.0
    spark = edges.sparkSession
    return spark.createDataFrame([(int(vn), int(en), float(density))], "nodes bigint, edges bigint, density double")


def weighted_degree(edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """(id, weighted_degree) = sum of incident weights; with communities, only intra-community edges."""
    if communities is not None:
        edges = induced_by_community(edges, communities)
    return symmetrize(edges).groupBy("id").agg(F.sum("weight").alias("weighted_degree"))


def induced_subgraph(edges: DataFrame, node_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both ends in the node set (two semi joins)."""
    ids = node_ids.select(F.col(id_col).alias("_n")).distinct()
    return edges.join(ids, edges["src"] == ids["_n"], "left_semi").join(ids, edges["dst"] == ids["_n"], "left_semi")


def induced_by_community(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges whose two ends share a community; carries the community column."""
    cs = communities.select(F.col("id").alias("src"), F.col("community").alias("c_src"))
    cd = communities.select(F.col("id").alias("dst"), F.col("community").alias("c_dst"))
    return (
        edges.join(cs, "src")
        .join(cd, "dst")
        .filter(F.col("c_src") == F.col("c_dst"))
        .select("src", "dst", "weight", F.col("c_src").alias("community"))
    )
