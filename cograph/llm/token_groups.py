"""Operator 9, n-gram Jaccard join by a token-group matrix.

Texts become sets of distinct five-word shingles (64-bit hashes). Equal sets are one class, of which the
smallest id goes on. The classes are partitioned into groups of similar texts: rows that share a min-hash
are compared with the smallest and the largest of them, and linked rows form a group. The matrix holds, for every
token, the groups in whose union it lies. In a few rounds one row of each group of a token is compared with one row
of the group that holds it most often, and linked groups merge, so that a family of copies is not opened pair by pair.
Unions are taken over the members' prefixes, which is enough:
with all tokens in one order (rare before frequent, then by hash) two sets of Jaccard similarity t share a
token among the first n - ceil(t n) + 1 of each. So a token of one group alone opens nothing; a token in
several groups opens those whose bounds allow it: a query of n shingles whose first match is at position p
overlaps a member of m shingles in at most min(n - p, m - q), and in at most its matches plus what follows the
prefixes; that must reach t / (1 + t) (n + m). Of an opened pair only the sketches travel at first, a bit or two a shingle,
whose differing bits are a lower bound of the shingles that one set has alone; what they allow is compared exactly.
This is not the token-group method's last step: a query's matches are not counted against a group's union to choose the
groups that are opened; the matrix only drops tokens of one group and chooses pairs in the merging rounds, and then rows of
different groups under one token are joined, positions and sizes permitting, which is quadratic in the rows of a token
whose texts share much without linking. No link between groups can be lost; links within a group change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, ship, small
from .words import mix, shingle_sets

KEYS = 4  # min-hashes by which groups are formed; any number gives the same links
ROUNDS = 2  # rounds that merge groups over the matrix before pairs are opened; any number gives the same links
ORDERS = 8  # orders of a group's rows; a token takes the group's first row in one of them
_SALTS = [np.uint64(0x5851F42D4C957F2D * (2 * k + 1) & (2**64 - 1)) for k in range(KEYS)]


def _frequent(width: int, least: int, run: int = 2_000_000):
    """Shingles that ``least`` or more texts of a run of about ``run`` shingles of one task have, with that number."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        kept = n >= least
        return pa.record_batch([pa.array(keys[kept].view(np.int64)), pa.array(n[kept])], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), width):
                held.append(tokens)
                rows += len(tokens)
                if rows >= run:
                    yield often(held)
                    held, rows = [], 0
        if held:
            yield often(held)

    return count


def frequent_tokens(texts: DataFrame, width: int, least: int = 2, bound: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their counts over all texts, the ``bound`` most frequent at most.

    They only set the order in which tokens are tried; any order gives the same links.
    """
    counted = cut_lineage(texts.mapInArrow(_frequent(width, least), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    if counted.count() > bound:
        cut = counted.groupBy("n").count().orderBy(F.desc("n")).limit(bound).collect()
        kept, floor = 0, None
        for row in cut:
            kept += row["count"]
            if kept > bound:
                break
            floor = row["n"]
        counted = counted.where(F.lit(False) if floor is None else F.col("n") >= floor)
    got = counted.toArrow()  # two columns, not a Python object per row
    tokens = got["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got["n"].to_numpy().astype(np.int64)[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens over about a bit a token, a power of two of 64-bit words."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(x, y):
    """Bits in which two sketches differ, the longer one folded to the shorter: at most as many as there are tokens
    of one of the two sets alone."""
    size = F.least(F.size(x), F.size(y))

    def folded(v):
        fold = lambda acc, k: F.zip_with(acc, F.slice(v, k * size + 1, size), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(v) == size, v).otherwise(F.aggregate(F.sequence(F.lit(1), (F.size(v) / size).cast("int") - 1), F.slice(v, F.lit(1), size), fold))

    odd = F.zip_with(folded(F.col(x)), folded(F.col(y)), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(odd, F.lit(0), lambda acc, n: acc + n)


def _signatures(spark, width: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]):
    shared = spark.sparkContext.broadcast(frequent)
    lists = ("keys", "prefix", "sketch")
    kind = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), *((c, pa.list_(pa.int64())) for c in lists)])

    @F.arrow_udf("struct<n:bigint, s1:bigint, s2:bigint, keys:array<bigint>, prefix:array<bigint>, sketch:array<bigint>>")
    def signatures(texts: pa.Array) -> pa.Array:
        tokens, often = shared.value
        n, s1, s2, keys, prefix, sketches = [], [], [], [], [], []
        for _, s in shingle_sets(texts, width):
            n.append(len(s))
            if not len(s):
                s1.append(0), s2.append(0), keys.append(None), prefix.append(None), sketches.append(None)
                continue
            sketches.append(sketch(s))
            a = mix(s ^ np.uint64(0xA0761D6478BD642F))
            s1.append(int(a.sum().view(np.int64)))
            s2.append(int(np.bitwise_xor.reduce(mix(a)).view(np.int64)))
            keys.append(np.array([(s * salt ^ (s >> np.uint64(29))).min() for salt in _SALTS], np.uint64).view(np.int64))
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                hit = tokens[at] == s
                heavy, f = s[hit], often[at[hit]]
                s = np.concatenate([s[~hit], heavy[np.lexsort((heavy, f))]])
            prefix.append(s[: prefix_length(len(s), percent)].view(np.int64))
        return pa.StructArray.from_arrays(
            [*(pa.array(v, pa.int64()) for v in (n, s1, s2)), *(pa.array(v, pa.list_(pa.int64())) for v in (keys, prefix, sketches))], fields=list(kind))

    return signatures


def _token_sets(width: int):
    @F.arrow_udf("array<bigint>")
    def token_sets(texts: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for _, s in shingle_sets(texts, width)], pa.list_(pa.int64()))

    return token_sets


def possible(n_x, n_y, apart, percent: int):
    """Can two sets of ``n_x`` and ``n_y`` tokens, ``apart`` or more of which are in one set alone, reach the similarity?"""
    return (100 - percent) * (n_x + n_y) >= (100 + percent) * apart


def _linked(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity. Ids that repeat link by any of their texts."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    sets = cut_lineage(texts.join(small(ids), "id", "left_semi").select("id", _token_sets(width)("text").alias("tokens")))
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = small(pairs).join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return cut_lineage(both.where(100 * F.col("common") >= percent * (F.size("ta") + F.size("tb") - F.col("common"))).select("a", "b").distinct())


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Texts link when 100 * intersection >= ``percent`` * union of their shingle sets; ``component_id`` is the
    smallest id reachable. Null or wordless texts have no shingles and are their own component. A null id
    keeps its row with its set size and a null component; rows that repeat an id with different texts join
    their components; other columns are not used; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_tokens(texts.select("text"), width)
    marked = cut_lineage(texts.select("id", _signatures(spark, width, percent, frequent)("text").alias("s")).select("id", "s.*"))
    known = marked.where("n > 0 AND id IS NOT NULL")
    same = known.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"))
    member = cut_lineage(marked.select("id", "s1", "s2", "n").join(same, ["s1", "s2", "n"]).where("id IS NOT NULL").select("id", "rep", "n"))
    first = cut_lineage(member.where("id = rep").select("id", "n").distinct())
    reps = marked.join(small(first), ["id", "n"])

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow the similarity."""
        pairs = cut_lineage(pairs)
        met = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        heads = reps.join(small(met), "id", "left_semi")
        head = lambda side: heads.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        both = small(pairs).join(head("a"), "a").join(head("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return cut_lineage(both.where(possible(F.col("na"), F.col("nb"), differing("sa", "sb"), percent)).select("a", "b").distinct())

    # groups: stars around the smallest and the largest row that share a min-hash
    repeated = member.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    keyed = cut_lineage(reps.select("id", F.posexplode("keys").alias("k", "key")))
    roots = keyed.groupBy("k", "key").agg(F.min("id").alias("root"), F.max("id").alias("last")).where("root < last")
    spokes = keyed.join(roots, ["k", "key"]).select("id", F.explode(F.array("root", "last")).alias("root")).where("id <> root")
    star = spokes.select(F.least("root", "id").alias("a"), F.greatest("root", "id").alias("b")).distinct()
    group = cut_lineage(components(repeated.unionByName(_linked(texts, screened(star), width, percent))).toDF("id", "g"))
    grouped = cut_lineage(first.join(group, "id", "left").select("id", "n", F.coalesce("g", "id").alias("grp")))

    def merged(pairs: DataFrame) -> DataFrame:
        """(id, g), the groups after the links among ``pairs``: a group's links to its smallest row stand for its earlier ones."""
        links = _linked(texts, screened(pairs), width, percent)
        return cut_lineage(components(group.toDF("a", "b").unionByName(links)).toDF("id", "g"))

    # token-group matrix over prefixes, one shuffle of all rows by token; only tokens in several groups go on
    def shared(rows: DataFrame) -> DataFrame:
        holders = Window.partitionBy("token")
        wide = rows.withColumn("g1", F.min("grp").over(holders)).withColumn("g2", F.max("grp").over(holders)).where("g1 < g2")
        return cut_lineage(wide.select("token", "id", "n", "grp", "p"))

    opened = shared(marked.select("id", "n", "prefix").join(small(grouped), ["id", "n"]).select("id", "n", "grp", F.posexplode("prefix").alias("p", "token")))
    for turn in range(ROUNDS):
        some = F.min_by("id", F.xxhash64("id", F.lit(turn), F.pmod("token", F.lit(ORDERS))))
        heads = cut_lineage(opened.groupBy("token", "grp").agg(some.alias("id"), F.count("*").alias("held")))
        roots = heads.groupBy("token").agg(F.max_by("id", F.struct("held", "grp")).alias("root"))
        met = heads.join(roots, "token").where("id <> root")
        met = met.select(F.least("root", "id").alias("a"), F.greatest("root", "id").alias("b")).distinct()
        group = merged(met)
        opened = shared(opened.join(small(group), "id", "left").withColumn("grp", F.coalesce("g", "id")))

    # the pairs of rows of different groups that are left
    x, y = opened.select(*[F.col(c).alias(f"{c}_x") for c in opened.columns]), opened.select(*[F.col(c).alias(f"{c}_y") for c in opened.columns])
    most = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    pairs = x.join(y, (F.col("token_x") == F.col("token_y")) & (F.col("id_x") < F.col("id_y")) & (F.col("grp_x") != F.col("grp_y"))
                   & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & ((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y"))))
    group = merged(pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct())
    whole = group.toDF("rep", "component")
    classes = member.join(whole, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = marked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    return out.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
