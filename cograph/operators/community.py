"""Communities and topology: A8, G2, G3, J10, P15, W3, W4 (A7 is in ``modularity``, G1 in ``louvain``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import graph_counts, induced_by_community, symmetrize, weighted_degree
from .louvain import LouvainResult, louvain
from .modularity import degrees, modularity, modularity_value
from .topk import top_k_per_group

# Fixed values of the reference: the verdict margin and its three conclusions.
DELTA_Q_MARGIN = 0.05
VERDICT_POLARIZED = "STRUCTURAL POLARIZATION"
VERDICT_INTEGRATED = "UNEXPECTEDLY INTEGRATED"
VERDICT_NONE = "NO SIGNIFICANT DIFFERENCE"
# Gains are rounded before the arg-max: float sums depend on partition order, and exact ties
# (features that always co-occur) must fall to the smaller community id on every partitioning.
GAIN_PLACES = 9


# ---------------------------------------------------------------- A8
def community_sizes(communities: DataFrame) -> DataFrame:
    """(community, size)."""
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def num_communities(communities: DataFrame) -> DataFrame:
    """Number of communities."""
    return communities.agg(F.countDistinct("community").alias("num_communities"))


# ---------------------------------------------------------------- G2
def _best_moves(sym: DataFrame, comm: DataFrame, k: DataFrame, tot: DataFrame, two_m: float) -> DataFrame:
    """For every node: current community, best community and the two gains.

    gain(v -> c) = k_{v->c} - k_v * (tot_c - [v in c] k_v) / 2m, rounded to GAIN_PLACES;
    ties -> smaller community id.
    ``sym`` has no self-loops (they move with the node and never change a gain).
    """
    nbr_c = comm.select(F.col("id").alias("nbr"), F.col("community").alias("c"))
    kvc = sym.join(nbr_c, "nbr").groupBy("id", "c").agg(F.sum("weight").alias("k_vc"))
    own = comm.select("id", F.col("community").alias("own"))
    cand = (
        kvc.join(own, "id")
        .join(k, "id")
        .join(tot.select(F.col("community").alias("c"), "tot"), "c")
        .withColumn(
            "gain",
            F.round(
                F.col("k_vc")
                - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))) / F.lit(two_m),
                GAIN_PLACES,
            ),
        )
    )
    best = cand.groupBy("id").agg(
        F.min(F.struct((-F.col("gain")).alias("ng"), F.col("c").alias("c"))).alias("b"),
        F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay_gain"),
    )
    return best.select("id", F.col("b.c").alias("best"), (-F.col("b.ng")).alias("best_gain"), "stay_gain")


def _stay_default(own_k: DataFrame, tot: DataFrame, two_m: float) -> DataFrame:
    """Gain of staying when no neighbour shares the node's community: -k_v (tot_c - k_v) / 2m."""
    return own_k.join(tot.withColumnRenamed("community", "own"), "own").select(
        "id", "own", "k", F.round(-F.col("k") * (F.col("tot") - F.col("k")) / F.lit(two_m), GAIN_PLACES).alias("stay0")
    )


def louvain_round(edges: DataFrame, communities: DataFrame | None = None, eligible=None, eps: float = 1e-12) -> DataFrame:
    """One synchronous best-gain move of every (eligible) node; returns (id, community).

    A node moves only when its best gain beats staying by more than ``eps``.
    """
    sym = symmetrize(edges.filter(F.col("src") != F.col("dst")))
    k = degrees(edges)
    if communities is None:
        communities = k.select("id", F.col("id").alias("community"))
    m = edges.agg(F.sum("weight")).first()[0] or 0.0
    two_m = 2.0 * float(m)
    if two_m == 0:
        return communities
    return _round(sym, communities, k, two_m, eligible, eps)


def _wants(sym, comm, k, two_m, eps):
    """(id, own, best, gain): the move that every node would make alone; ``best`` is null where it stays."""
    tot = comm.join(k, "id").groupBy("community").agg(F.sum("k").alias("tot"))
    moves = _best_moves(sym, comm, k, tot, two_m)
    own_k = comm.select("id", F.col("community").alias("own")).join(k, "id")
    j = _stay_default(own_k, tot, two_m).join(moves, "id", "left")
    j = j.withColumn("gain", F.col("best_gain") - F.coalesce("stay_gain", "stay0"))
    return j.select("id", "own", F.when(F.col("gain") > F.lit(eps), F.col("best")).alias("best"), "gain")


def _moved(wants, eligible=None) -> DataFrame:
    move = F.col("best").isNotNull() if eligible is None else F.col("best").isNotNull() & eligible
    return wants.select("id", F.when(move, F.col("best")).otherwise(F.col("own")).alias("community"))


def _round(sym, comm, k, two_m, eligible, eps):
    return _moved(_wants(sym, comm, k, two_m, eps), eligible)


# ---------------------------------------------------------------- G3 / J10 / P15
def analyze_graph(edges: DataFrame, label: str, nodes: DataFrame | None = None, found: LouvainResult | None = None, **louvain_kw) -> DataFrame:
    """One D12 row (graph, nodes, edges, density, modularity, num_communities).

    ``found``: communities of the same edges, if at hand. No edges -> every metric but the node count is 0
    (num_communities always present).
    """
    counts = graph_counts(edges, nodes).first()
    spark = edges.sparkSession
    schema = "graph string, nodes bigint, edges bigint, density double, modularity double, num_communities bigint"
    if counts["edges"] == 0:
        return spark.createDataFrame([(label, counts["nodes"], 0, 0.0, 0.0, 0)], schema)
    res = found or louvain(edges, **louvain_kw)
    return spark.createDataFrame([(label, counts["nodes"], counts["edges"], counts["density"], res.modularity, res.num_communities)], schema)


def compare_graphs(stats: DataFrame, graph_a: str, graph_b: str) -> DataFrame:
    """Metric | <graph_a> | <graph_b>; integers as text, floats with 5 decimals."""
    metrics = ["nodes", "edges", "density", "modularity", "num_communities"]
    floats = {"density", "modularity"}
    parts = []
    for i, mname in enumerate(metrics):
        val = F.format_string("%.5f", F.col(mname)) if mname in floats else F.col(mname).cast("string")
        parts.append(stats.select(F.lit(i).alias("ord"), F.lit(mname).alias("metric"), "graph", val.alias("value")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return (
        long.groupBy("ord", "metric")
        .pivot("graph", [graph_a, graph_b])
        .agg(F.first("value"))
        .orderBy("ord")
        .drop("ord")
    )


def polarization_verdict(stats: DataFrame, graph_a: str, graph_b: str) -> DataFrame:
    """delta_q = Q_b - Q_a and the verdict (strict comparisons at +-0.05)."""
    j = stats.agg(
        (
            F.max(F.when(F.col("graph") == graph_b, F.col("modularity")))
            - F.max(F.when(F.col("graph") == graph_a, F.col("modularity")))
        ).alias("delta_q")
    )
    return j.select(
        "delta_q",
        F.when(F.col("delta_q") > DELTA_Q_MARGIN, F.lit(VERDICT_POLARIZED))
        .when(F.col("delta_q") < -DELTA_Q_MARGIN, F.lit(VERDICT_INTEGRATED))
        .otherwise(F.lit(VERDICT_NONE))
        .alias("verdict"),
    )


# ---------------------------------------------------------------- W3 / W4
def top_communities(communities: DataFrame, k: int = 5) -> DataFrame:
    """The k largest communities by node count (ties: smaller community id)."""
    return community_sizes(communities).orderBy(F.col("size").desc(), F.col("community").asc()).limit(k)


def central_nodes(edges: DataFrame, communities: DataFrame, k_comm: int = 5, k_nodes: int = 5, places: int | None = None) -> DataFrame:
    """Per top community, the top nodes by weighted degree inside the community subgraph (ties: smaller id).
    ``places``: degrees are rounded first, so that ranks do not hang on the order of sums."""
    top = top_communities(communities, k_comm).select("community")
    members = communities.join(top, "community", "left_semi")
    deg = weighted_degree(edges, members).join(members, "id")
    if places is not None:
        deg = deg.withColumn("weighted_degree", F.round("weighted_degree", places))
    ranked = top_k_per_group(deg, "community", "weighted_degree", k_nodes, tie="id")
    return ranked.select("community", "id", "weighted_degree", "rank")


def intra_community_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """J3 per community: edges whose two ends share a community."""
    return induced_by_community(edges, communities)
