"""Operator 7, exact dedup: an extendible-hash index in shared files, DataFrame functions only.

The 64-bit hash of a text is its key. Map-side grouping on (key, text) compares whole texts byte by
byte, so a text held by a third of all rows leaves each map task as one record. The directory has
``2**depth`` pointers on the leading bits of the key; a bucket with more than ``capacity`` records is
split by one more bit (directory doubling) until it fits; one that is overfull at the last of these bits gets a directory of
its own on the next bits, and so on to the end of the key. The records are written
to the shared folder by owner task, one owner for each bucket; records of one key with different texts
are chained. Every document is then looked up through the directory: it goes to the owner of its bucket, where it meets the
chain's records. Texts of a thousandth of all rows or more, a thousand at most, are looked up in place instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]
HOT = 1000  # a text of one row in so many is looked up in place


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("__text", text).withColumn("__key", F.xxhash64("__text"))


def _bits(skip: int, depth: int) -> tuple[Column, Column]:
    """The first ``skip`` bits of the key and the ``depth`` bits after them, as numbers."""
    first = F.shiftrightunsigned("__key", 64 - skip) if skip else F.lit(0).cast("long")
    return first, F.shiftrightunsigned(F.shiftleft("__key", skip), 64 - depth)


def directory(records: DataFrame, capacity: int, depth: int, skip: int = 0) -> DataFrame:
    """(first, pointer, bucket, bits, overfull): every value of the ``depth`` bits after the ``first`` ``skip`` ones -> its
    bucket; at most 2**depth rows for each value of the first bits.

    A prefix of d bits is a bucket when it holds at most ``capacity`` records (or d is ``depth``) and
    the prefix one bit shorter was overfull.
    """
    first, prefix = _bits(skip, depth)
    loads = (
        records.groupBy(first.alias("first"), prefix.alias("p")).count()
        .select("first", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"), "p", "count")
        .groupBy("first", "bits", F.expr(f"shiftright(p, {depth} - bits)").alias("prefix"))
        .agg(F.sum("count").alias("load"))
    )
    above = loads.where(F.col("load") > capacity).select("first", (F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
    split = loads.withColumn("parent", F.shiftright("prefix", 1))
    fits = (F.col("load") <= capacity) | (F.col("bits") == depth)
    leaves = split.join(above, ["first", "bits", "parent"], "left_semi").where(fits).unionByName(split.where((F.col("bits") == 0) & fits))
    width = F.expr(f"shiftleft(1L, {depth} - bits)")
    return leaves.select(
        "first",
        F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("pointer"),
        (F.col("prefix") * width).alias("bucket"),
        "bits",
        (F.col("load") > capacity).alias("overfull"),
    )


class Directory:
    """The directory and those of buckets that were overfull at its last bit."""

    def __init__(self, records: DataFrame, capacity: int, depth: int):
        self.levels: list[tuple[DataFrame, int, int]] = []
        skip = 0
        while skip < 64:
            width = min(depth, 64 - skip)
            level = cut_lineage(directory(records, capacity, width, skip))
            self.levels.append((level, skip, width))
            overfull = level.where("overfull").select("first", "pointer")
            if overfull.isEmpty():
                break
            first, pointer = _bits(skip, width)
            records = cut_lineage(records.select("__key").withColumns({"first": first, "pointer": pointer}).join(small(overfull), ["first", "pointer"], "left_semi").select("__key"))
            skip += width

    def owned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__bucket``, the least key of the bucket that their ``__key`` leads to."""
        rows = rows.withColumn("__bucket", F.lit(None).cast("long"))
        for level, skip, width in self.levels:
            first, pointer = _bits(skip, width)
            start = F.shiftleft("first", 64 - skip) if skip else F.lit(0).cast("long")
            leads = level.select(F.col("first").alias("__first"), F.col("pointer").alias("__pointer"),
                                 start.bitwiseOR(F.shiftleft("bucket", 64 - skip - width)).alias("__start"))
            rows = rows.withColumns({"__first": first, "__pointer": pointer}).join(small(leads), ["__first", "__pointer"], "left")
            rows = rows.withColumn("__bucket", F.coalesce("__start", "__bucket")).drop("__first", "__pointer", "__start")
        return rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, depth: int = 16) -> tuple[DataFrame, Directory]:
    """The index, written to the shared folder, one row per distinct text
    (``__key, text_sha256, chain, __bucket, keep_id, group_size``), and its directory; ``chain`` numbers the texts of one key.
    A bucket holds ``capacity`` records, or 4 / 2**depth of all where that is more, so that the directory does not grow with them."""
    records = (
        _keyed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t")
        .groupBy("__key", "__text")
        .agg(F.count("*").alias("group_size"), F.max("__id").alias("keep_id"))
        .select("__key", F.sha2("__text", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    records = cut_lineage(records)
    pointers = Directory(records.select("__key"), max(capacity, -(-4 * records.count() // 2**depth)), depth)
    owned = pointers.owned(records).repartition("__bucket")
    chain = Window.partitionBy("__bucket", "__key").orderBy("text_sha256")
    return cut_lineage(owned.withColumn("chain", F.row_number().over(chain))), pointers


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, depth: int = 16) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. The row with the largest id of a group stays; a null id stays only if
    the group has no other. Rows that repeat both id and text are all marked like the one that stays
    (they are one document). Input columns named like a result column are replaced. Empty table: empty result.
    """
    index, pointers = build_index(docs, id_col, text_col, capacity, depth)
    entries = index.select("__key", "text_sha256", "__bucket", F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    d = _keyed(docs.drop(*(set(RESULT) - {id_col, text_col})), text_col).withColumn("text_sha256", F.sha2("__text", 256)).drop("__text")
    rows = index.agg(F.sum("group_size")).first()[0] or 0
    hot = entries.where(F.col("__size") * HOT >= rows).drop("__bucket")  # HOT rows at most, as their sizes add up to all rows
    d = d.join(F.broadcast(hot), ["__key", "text_sha256"], "left")
    found = d.where("__size IS NOT NULL")
    asked = pointers.owned(d.where("__size IS NULL")).withColumn("__entry", F.lit(False))
    chains = entries.where(F.col("__size") * HOT < rows).withColumn("__entry", F.lit(True))
    chain = Window.partitionBy("__bucket", "__key", "text_sha256")  # in the owner's task: no further shuffle
    met = asked.unionByName(chains, allowMissingColumns=True).repartition("__bucket")
    met = met.withColumns({"__keep": F.max("__keep").over(chain), "__size": F.max("__size").over(chain)}).where(~F.col("__entry"))
    d = found.unionByName(met.select(found.columns)).drop("__key").withColumnsRenamed({"__keep": "keep_id", "__size": "group_size"})
    return d.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
