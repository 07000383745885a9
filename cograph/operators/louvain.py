"""G1: communities by weighted Louvain with refinement, as an iterative DataFrame job.

One level moves nodes until no single move is left that pays, refines the communities to connected parts, and contracts
the parts to the nodes of the next level, which start in the communities found so far. When no part can be joined
any more, the next sweep starts again from single nodes in those communities; the last sweep finds nothing to move.

* **Frontier.** A round scores only active nodes: neighbours of the last round's movers that are not in the mover's new
  community, and movers that had to wait. Only edges of active nodes and of movers are joined; the adjacency is written
  once a level, in directories by a hash of the node, and a round reads only the directories it needs. A level ends when a
  round over all nodes finds no mover.
* **Moves that hold together.** A community gives or takes nodes in a round, as the best move that touches it says, so no
  mover's old community is another's new one and neighbours that move never harm each other. What is left is that
  communities grow and shrink by others' moves. Moves into (and out of) a community are ranked by classes of their gain and
  within a class by buckets of a hash; a move is made when the weight of all moves ranked before it, or in its own bucket,
  takes at most half of its gain. The best move is always made, and every round raises Q.
* **Exact sums.** Weights become whole multiples of a power of two such that all sums stay below 2^52: sums of doubles
  are then exact, so the result does not depend on partitions or on the order of rows.
* **Refinement.** Inside each community every node starts alone; nodes still alone and well connected to their community
  join a part next to them. Parts only grow by a neighbour, so they are connected. When nothing can be joined, every
  community is one connected set of nodes.

State, (id, community, degree, weight of the community, active), goes to the session's checkpoint folder every round;
the driver sees counts, sums and directory numbers.

With threshold 0, where a component ends by itself, the rounds of small components are run inside tasks (``components``).
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from . import components as K
from .components import BUCKETS, CLASSES, SEED
from .corpus import global_index
from .graph import symmetrize
from .modularity import degrees, modularity_value

SUM_BITS = 50  # bits of the sum of all weights
EDGES_PER_PART = 2_000_000  # directed edges in one directory of the adjacency
EDGES_PER_TASK = 200_000  # edges of a component that one task works on
FILE_ROWS = 500_000  # rows of a file of state: small graphs do not pay for many tasks
log = logging.getLogger(__name__)


@dataclass
class LouvainResult:
    communities: DataFrame  # (id, community); a community is named by the place of its smallest node in node order
    modularity: float
    num_communities: int
    levels: int
    rounds: int
    converged: bool = True  # False only when ``max_levels`` or ``max_rounds`` stopped the run
    trace: tuple[float, ...] = ()  # Q (rounded weights) at the start and after every round of moves, kept by differences


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (of ``rows`` rows) in files of a fair size; later rounds keep its partitions."""
    return cut_lineage(df.coalesce(max(1, rows // FILE_ROWS)))


@dataclass
class _Adjacency:
    """(id, nbr, weight, k[, part]) of all edges but loops, k the degree of id, in directories by ``part``."""

    table: DataFrame
    parts: int
    edges: int

    @classmethod
    def write(cls, sym: DataFrame, edges: int, per_part: int) -> _Adjacency:
        """``edges``: number of rows of ``sym``, or a bound; the rows written say how many directories there are (a
        graph of loops has none, and directories without a row could not be read again)."""
        sym = _few(sym, edges)
        edges = sym.count()
        parts = -(-edges // per_part)
        if parts < 2:
            return cls(sym, 1, edges)
        part, spread = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.pmod(F.xxhash64("nbr"), F.lit(4))
        dealt = sym.withColumn("part", part).repartition(4 * parts, "part", spread).sortWithinPartitions("part", "id")
        return cls(cut_lineage(dealt, partition_by="part"), parts, edges)

    def near(self, ids: DataFrame | None) -> DataFrame:
        """The rows of the directories that hold the nodes ``ids`` (None: all)."""
        if ids is None or self.parts < 2:
            return self.table
        used = [r[0] for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("p")).distinct().collect()]
        return self.table.where(F.col("part").isin(used))


def _wants(adj: _Adjacency, comm: DataFrame, everyone: bool, two_m: float, min_gain: float, round_no: int, alone: bool) -> DataFrame:
    """(id, own, best, gain, k, tot_own, tot_best) of the nodes of ``comm`` that are asked and gain by a move.

    gain = (k_best - k_own) - k (tot_best - tot_own + k) / 2m in units of weight; ties fall to the smaller name. A node
    may also go to a community of its own under a new name; with ``alone`` only to a neighbour's, and only while it
    is alone itself.
    """
    asked = " AND ".join(["true"] + ["active"] * (not everyone) + ["free AND tot = k"] * alone)
    nodes = comm.where(asked)
    ids = nodes.select("id")
    links = adj.table if asked == "true" else adj.near(ids).join(ids, "id", "left_semi")
    rows = links.join(comm.selectExpr("id AS nbr", "community AS c", "tot"), "nbr").selectExpr("id", "c", "weight", "tot", "k", "false AS own")
    places = ["named_struct('c', community, 'tot', tot, 'own', true)"]
    if not alone:  # a name no community has
        places.append(f"named_struct('c', -id * {1 << 20}L - {round_no + 1}L, 'tot', 0.0D, 'own', false)")
    here = nodes.selectExpr("id", f"explode(array({', '.join(places)})) AS p", "k").selectExpr("id", "p.c", "0.0D AS weight", "p.tot", "k", "p.own")
    d = rows.unionByName(here).groupBy("id", "c").agg(F.expr("sum(weight) AS k_c"), F.expr("max(tot) AS tot"), F.expr("max(k) AS k"), F.expr("max(own) AS own"))
    d = d.selectExpr("id", "c", "tot", "k", "own", f"k_c - k * (tot - if(own, k, 0.0D)) / {two_m!r}D AS value")
    best = d.groupBy("id").agg(F.expr("min(named_struct('worth', -value, 'c', c, 'tot', tot)) AS b"), F.expr("max(CASE WHEN own THEN named_struct('value', value, 'c', c, 'tot', tot) END) AS s"), F.expr("max(k) AS k"))
    out = best.selectExpr("id", "s.c AS own", "b.c AS best", "-b.worth - s.value AS gain", "k", "s.tot AS tot_own", "b.tot AS tot_best")
    return out.where(f"best <> own AND gain > {min_gain!r}D * k")


def _together(wants: DataFrame, two_m: float, round_no: int) -> DataFrame:
    """The wanted moves that raise Q when made at once, among them the best one."""
    # what others' weight may add up to until the gain is gone, and its class: 0 is the most
    d = wants.selectExpr("*", f"gain * {two_m!r}D / k AS spare", f"CAST(pmod(xxhash64(id, {SEED}, {round_no}), {BUCKETS}) AS int) AS bucket")
    d = d.selectExpr("*", f"CAST(least(floor(log2({two_m!r}D / spare)), {CLASSES}) AS int) AS class")
    touch = d.selectExpr("explode(array(named_struct('c', own, 'takes', false), named_struct('c', best, 'takes', true))) AS s", "gain", "id", "k", "class", "bucket")
    part = touch.groupBy("s.c", "s.takes", "class", "bucket").agg(F.expr("sum(k) AS k"), F.expr("max(named_struct('gain', gain, 'first', -id, 'k', k)) AS top"))
    # one row a community: its best move, which says whether it gives or takes, and the weights of that side's ranks
    role = part.groupBy("c").agg(F.expr("max(named_struct('top', top, 'takes', takes)) AS r"), F.expr("collect_list(named_struct('takes', takes, 'class', class, 'bucket', bucket, 'k', k)) AS ranks"))
    role = role.selectExpr("c", "r.takes AS takes", "r.top.first AS first", "r.top.k AS k_first", "filter(ranks, x -> x.takes = r.takes) AS ranks")
    before = """if(first = -id, 0.0D, k_first - k + aggregate(ranks, 0.0D, (n, x) ->
        n + if(x.class < class OR (x.class = class AND x.bucket <= bucket), x.k, 0.0D))) AS before_{}"""
    for side, takes in (("own", "NOT takes"), ("best", "takes")):
        d = d.join(role.where(takes).withColumnRenamed("c", side), side).selectExpr(*d.columns, before.format(side))
    return d.where("before_own + before_best <= spare / 2").select(wants.columns)


def _after(adj: _Adjacency, comm: DataFrame, wants: DataFrame, moves: DataFrame) -> DataFrame:
    """``comm`` after the moves. ``active``: neighbours of movers that are not in the mover's new community, and nodes that
    have to wait. ``inside``: by how much a node's edges to movers raise the weight inside communities (an edge of two
    movers is counted half at each)."""
    e = adj.near(moves.select("id")).select("id", "nbr", "weight").join(moves.select("id", "own", "best"), "id")
    e = e.join(comm.selectExpr("id AS nbr", "community AS was"), "nbr").join(moves.selectExpr("id AS nbr", "best AS to"), "nbr", "left")
    change = "(CAST(coalesce(to, was) = best AS int) - CAST(was = own AS int)) * if(to IS NULL, 1.0D, 0.5D)"
    woken = e.groupBy(F.col("nbr").alias("id")).agg(F.expr(f"sum(weight * {change}) AS inside"), F.expr("max(coalesce(to, was) <> best) AS wake"))
    grown = moves.selectExpr("inline(array(named_struct('c', best, 'grows', k), named_struct('c', own, 'grows', -k)))").groupBy(F.col("c").alias("community")).agg(F.expr("sum(grows) AS grows"))
    moved = wants.selectExpr("id", "true AS wanted").join(moves.select("id", "best", "tot_best"), "id", "left")
    d = comm.select("id", "community", "k", "tot", "free").join(moved, "id", "left").join(woken, "id", "left")
    d = d.selectExpr("id", "coalesce(best, community) AS community", "k", "coalesce(tot_best, tot) AS tot", "free", "coalesce(wake, false) OR (coalesce(wanted, false) AND best IS NULL) AS active", "coalesce(inside, 0.0D) AS inside")
    return d.join(grown, "community", "left").selectExpr("id", "community", "k", "tot + coalesce(grows, 0.0D) AS tot", "free", "active", "inside")


def _settle(adj: _Adjacency, comm: DataFrame, two_m: float, min_gain: float, first_round: int, max_rounds: int | None, threshold: float = 0.0, alone: bool = False) -> tuple[DataFrame, list[float], bool]:
    """Rounds until a scoring of all nodes finds no mover or Q gains less than ``threshold``: (communities, what Q gained
    in each round, whether it ended so).
    ``comm``: (id, community, k, tot, free); ``alone``: only free nodes move, while they are still alone (refinement)."""
    # sum of the squares of the communities' weights, as a share: each node adds its part of its community's
    squares = F.expr(f"sum(k / {two_m!r}D * (tot / {two_m!r}D))")
    everyone, gains, last = True, [], comm.agg(squares).first()[0]
    while True:
        wants = cut_lineage(_wants(adj, comm, everyone, two_m, min_gain, first_round + len(gains), alone))
        movers = wants.count()
        if movers == 0 and everyone:
            return comm, gains, True
        if movers == 0:
            everyone = True
            continue
        if max_rounds is not None and len(gains) >= max_rounds:
            return comm, gains, False
        moves = cut_lineage(_together(wants, two_m, first_round + len(gains)))
        comm = cut_lineage(_after(adj, comm, wants, moves))
        inside, now, waiting = comm.agg(F.sum("inside"), squares, F.expr("count_if(active)")).first()
        gains.append(2 * inside / two_m - (now - last))
        last, everyone = now, waiting == 0
        if gains[-1] < threshold:
            return comm, gains, True
        log.info("louvain round %d: %d nodes want to move, Q %+.3g", first_round + len(gains), movers, gains[-1])


def _refine(adj: _Adjacency, comm: DataFrame, two_m: float, min_gain: float, first_round: int, per_part: int, threshold: float) -> tuple[DataFrame, int]:
    """Connected parts of every community, (id, community = a node of the part), and the rounds it took."""
    p = comm.select("id", F.col("community").alias("p"))
    inner = adj.table.join(p, "id").join(p.select(F.col("id").alias("nbr"), F.col("p").alias("q")), "nbr").where("p = q")
    inner = _Adjacency.write(inner.select("id", "nbr", "weight", "k"), adj.edges, per_part)
    degree = inner.table.groupBy("id").agg(F.sum("weight").alias("inside"))
    well = F.coalesce(F.col("inside") >= F.col("k") * (F.col("tot") - F.col("k")) / F.lit(two_m), F.lit(False))
    single = comm.drop("inside").join(degree, "id", "left").select("id", F.col("id").alias("community"), "k", F.col("k").alias("tot"), well.alias("free"))
    parts, gains, _ = _settle(inner, cut_lineage(single), two_m, min_gain, first_round, None, threshold, alone=True)
    return parts, len(gains)


def _contract(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between parts; those inside one become its loop."""
    s, d = (parts.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}")) for end in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    return e.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def louvain(edges: DataFrame, max_levels: int | None = None, max_rounds: int | None = None, min_gain: float = 1e-9, threshold: float = 1e-3, edges_per_part: int = EDGES_PER_PART, edges_per_task: int = EDGES_PER_TASK) -> LouvainResult:
    """G1: communities of an undirected edge table (src, dst, weight > 0; loops and repeated edges allowed).

    A move must gain more than ``min_gain`` as a share of the node's degree. A level ends with a round that raises Q by less
    than ``threshold``, the run when moves of single nodes raise it by less (they are not made, so that communities
    stay connected); with 0 no single node is left that gains by a move. ``max_levels``
    (of all sweeps) and ``max_rounds`` (moves of a level) are unbounded by default; ``converged`` says whether they cut the run. The result does not depend on partitions; it is a valid partition of high Q into connected
    communities, not the one of a sequential implementation. No edges: no communities, Q = 0. Edges with a null end
    or weight, or a weight of 0 or less, are left out.

    With threshold 0 and no such bounds, components of at most ``edges_per_task`` edges are run inside tasks, all their rounds
    at once (0: none); ``trace`` holds them as one step, ``levels`` and ``rounds`` the most of any.
    """
    spark = edges.sparkSession
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if threshold <= 0 and max_levels is None and max_rounds is None and edges_per_task > 0:
        return _by_components(edges, min_gain, threshold, edges_per_part, edges_per_task)
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    vid = cut_lineage(global_index(ends, "id", "vid"))
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return LouvainResult(spark.createDataFrame([], "id bigint, community bigint"), 0.0, 0, 0, 0)
    s, d = (vid.select(F.col("id").alias(end), F.col("vid").alias(f"v_{end}")) for end in ("src", "dst"))
    level = cut_lineage(_level(edges.join(s, "src").join(d, "dst"), _unit(total)))
    two_m = 2.0 * level.agg(F.sum("weight")).first()[0]
    state, trace, levels, rounds, converged = _sweeps(level, two_m, max_levels, max_rounds, min_gain, threshold, edges_per_part)
    result = cut_lineage(vid.join(state.withColumnRenamed("id", "vid"), "vid").select("id", "community"))
    n = result.select("community").distinct().count()
    return LouvainResult(result, modularity_value(edges, result), int(n), levels, rounds, converged, tuple(trace))


def _unit(total: float) -> float:
    return 2.0 ** (math.ceil(math.log2(total)) - SUM_BITS)


def _level(edges: DataFrame, unit: float) -> DataFrame:
    """The base graph: numbered ends, weights as multiples of ``unit``."""
    weight = F.greatest(F.rint(F.col("weight") / unit), F.lit(1.0))
    return edges.select(F.least("v_src", "v_dst").alias("src"), F.greatest("v_src", "v_dst").alias("dst"), weight.alias("weight"))


def _by_components(edges: DataFrame, min_gain: float, threshold: float, edges_per_part: int, edges_per_task: int) -> LouvainResult:
    """``louvain`` to the last move: small components inside tasks, the others in rounds of all of them."""
    spark = edges.sparkSession
    ship_package(spark)
    edges = cut_lineage(edges)  # read several times
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return LouvainResult(spark.createDataFrame([], "id bigint, community bigint"), 0.0, 0, 0, 0)
    unit = _unit(total)
    vid = cut_lineage(global_index(K.first_parts(edges), "id", "vid"))
    kind = vid.schema["id"].dataType
    s, d = (vid.select(F.col("id").alias(end), F.col("vid").alias(f"v_{end}"), F.col("part").alias(f"p_{end}")) for end in ("src", "dst"))
    ends = cut_lineage(edges.join(s, "src").join(d, "dst").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "weight", "v_src", "v_dst", "p_src", "p_dst"))
    two_m = 2.0 * _level(ends, unit).agg(F.sum("weight")).first()[0]
    small, others = K.parts_of(ends, edges_per_task)
    solved = small.repartition("part").sortWithinPartitions("part").mapInArrow(K.solver(total, unit, two_m, min_gain), f"id {kind.simpleString()}, community bigint, q double, start double, levels bigint, rounds bigint")
    solved = cut_lineage(solved)
    n, q, start, levels, rounds = solved.selectExpr("count(q)", "coalesce(sum(q), 0.0D)", "coalesce(sum(start), 0.0D)", "coalesce(max(levels), 0L)", "coalesce(max(rounds), 0L)").first()
    communities, trace, converged = solved.select("id", "community"), [start] + [q] * (rounds > 0), True
    if others is not None:
        others = cut_lineage(others)
        state, steps, more_levels, more_rounds, converged = _sweeps(cut_lineage(_level(others, unit)), two_m, None, None, min_gain, threshold, edges_per_part)
        communities = cut_lineage(communities.union(vid.join(state.withColumnRenamed("id", "vid"), "vid").select("id", "community")))
        trace = [x + steps[0] for x in trace] + [q + x for x in steps[1:]]
        n, q = n + state.select("community").distinct().count(), q + modularity_value(others.select(F.col("v_src").alias("src"), F.col("v_dst").alias("dst"), "weight"), state, total)
        levels, rounds = max(levels, more_levels), max(rounds, more_rounds)
    return LouvainResult(communities, q, int(n), levels, rounds, converged, tuple(trace))


def _sweeps(base: DataFrame, two_m: float, max_levels: int | None, max_rounds: int | None, min_gain: float, threshold: float, edges_per_part: int) -> tuple[DataFrame, list[float], int, int, bool]:
    """Rounds of a whole graph (numbered ends, whole weights): (communities, Q by round, levels, rounds, whether not cut)."""
    state = None  # communities of the nodes of the base graph
    trace, levels, rounds, steps, converged, adj_base = [], 0, 0, 0, True, None
    while True:  # sweeps from single nodes up, until a sweep finds nothing to move
        level, comm, assign, moved = base, state, None, 0
        while True:
            k = cut_lineage(degrees(level))
            nodes = k.count()
            if level is not base or adj_base is None:
                adj = _Adjacency.write(symmetrize(level.where("src <> dst")).join(k, "id"), 2 * level.count(), edges_per_part)
                adj_base = adj_base or adj
            else:
                adj = adj_base
            if comm is None:
                comm = k.select("id", F.col("id").alias("community"), "k", F.col("k").alias("tot"), F.lit(True).alias("free"))
            else:
                comm = comm.join(k, "id")
                comm = comm.join(comm.groupBy("community").agg(F.sum("k").alias("tot")), "community").select("id", "community", "k", "tot", F.lit(True).alias("free"))
            comm = _few(comm, nodes)
            if not trace:
                loops = level.where("src = dst").agg(F.sum("weight")).first()[0] or 0.0
                trace = [2 * loops / two_m - comm.agg(F.sum(F.col("k") / two_m * (F.col("k") / two_m))).first()[0]]
            if max_levels is not None and levels >= max_levels:
                converged = False
                break
            comm, gains, ended = _settle(adj, comm, two_m, min_gain, steps, max_rounds, threshold)
            if state is not None and level is base and (not gains or sum(gains) < threshold):
                break  # the last sweep's communities stand
            converged &= ended
            for gain in gains:
                trace.append(trace[-1] + gain)
            rounds, steps, moved, levels = rounds + len(gains), steps + len(gains), moved + len(gains), levels + 1
            parts, tries = _refine(adj, comm, two_m, min_gain, steps, edges_per_part, threshold)
            steps += tries
            if tries == 0:  # every part is one node: nothing to contract
                break
            to = parts.select(F.col("id").alias("node"), F.col("community").alias("part"))
            assign = cut_lineage(to.toDF("v", "node") if assign is None else assign.join(to, "node").select("v", F.col("part").alias("node")))
            named = parts.select("id", F.col("community").alias("part")).join(comm, "id").groupBy("community", "part").agg(F.lit(1).alias("one"))
            name = named.groupBy("community").agg(F.min("part").alias("name"))
            comm = cut_lineage(named.join(name, "community").select(F.col("part").alias("id"), F.col("name").alias("community")))
            level = cut_lineage(_contract(level, parts))
        if state is not None and not moved:
            break
        if assign is not None:
            comm = assign.join(comm.select(F.col("id").alias("node"), "community"), "node").select(F.col("v").alias("id"), "community")
        name = comm.groupBy("community").agg(F.min("id").alias("name"))
        state = cut_lineage(comm.join(name, "community").select("id", F.col("name").alias("community")))
        if not moved or not converged:
            break
    return state, trace, levels, rounds, converged
