"""Helpers shared by the operators: distributed running sums, connected components, folds."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows up to which a counted side may be broadcast (a row here is a few numbers: tens of MB).
BROADCAST_ROWS = 1_000_000
#: Edges up to which a round of ``components`` runs without shuffles, in one task (16 bytes an edge).
FEW_EDGES = 100_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers (as ``--py-files`` does), once for each version of it,
    and bound the batches they are sent, so that a worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    top = Path(__file__).resolve().parents[1]
    files = {p: p.read_bytes() for p in sorted(top.rglob("*.py"))}
    name = f"{top.name}-{hashlib.sha256(b''.join(files.values())).hexdigest()[:12]}.zip"
    if name in {Path(f).name for f in spark.sparkContext.listFiles}:
        return
    to = Path(tempfile.mkdtemp()) / name
    with zipfile.ZipFile(to, "w") as z:
        for p, data in files.items():
            z.writestr(str(p.relative_to(top.parent)), data)
    spark.sparkContext.addPyFile(str(to))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(0).cast("long"))


def before(df: DataFrame, keys: list[str], order: list[Column], out: str, size: Column | None = None, shards: int = 1024, total: str | None = None, ordered: bool = False) -> DataFrame:
    """Sum of ``size`` (default 1) over the rows of the same key that come before each row.

    Order within a key: a hash shard of ``order``, then ``order``; if ``ordered``, ``order`` itself, over ranges of it
    (``order`` should then tell rows apart). No key is summed in one task: each
    (key, shard) is summed alone and starts from the sum of the key's earlier shards, of which there
    are at most ``shards`` (ranges: shuffle partitions) rows a key. ``keys`` must not be null. ``total``: name of a column with the
    key's whole sum.
    """
    if ordered:  # written once: counts and rows must come from the same ranges
        d = cut_lineage(df.repartitionByRange(*order).withColumn("__shard", F.spark_partition_id()))
    else:
        d = df.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    d = d.withColumn("__size", F.lit(1).cast("long") if size is None else size.cast("long"))
    by_key = Window.partitionBy(*keys)
    starts = (
        d.groupBy(*keys, "__shard")
        .agg(F.sum("__size").alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(by_key.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(by_key))
        .drop("__n")
    )
    inside = Window.partitionBy(*keys, "__shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(starts, [*keys, "__shard"])
    d = d.withColumn(out, F.col("__start") + F.col("__inside"))
    if total:
        d = d.withColumn(total, F.col("__total"))
    return d.drop("__shard", "__size", "__start", "__inside", "__total")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): component = smallest node reachable.

    Alternating large-star / small-star contraction: every round is two grouped minima (combined on
    the map side, so a hub is no hot key) and joins that adaptive execution may split. Each round is
    written to the shared checkpoint folder; only a count and a checksum reach the driver. A round of ``FEW_EDGES``
    edges or fewer is one task without shuffles: what the driver keeps of tasks and stages would outweigh them.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, last = cut_lineage(e), None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        dealt = (lambda d: d.coalesce(1)) if state[0] <= FEW_EDGES else (lambda d: d)
        e = dealt(e)
        if state[0] == 0 or tuple(state) == last:
            break
        last = tuple(state)
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(dealt(rest.unionByName(low.select("a", F.col("m").alias("b")))).distinct())
    roots = dealt(e.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
