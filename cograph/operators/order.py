"""Positions in a global order without ranking the table: running totals, keys at given ranks, cutoffs as filters.

Everything works on narrow columns (order key, size); the rows themselves are never shuffled or written. What comes out
is a cutoff key, and a prefix of the order is a filter on it, which Spark pushes to the scan where the key is a column.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HEX_DIGITS = 4  # digits of a hash counted in one pass: at most 65,536 counts reach the driver
BUCKET_ROWS = 50_000  # rows of a hash prefix that are ordered to find one key


def before_key(col: Column, key: Any) -> Column:
    """Rows whose key comes before ``key`` in ascending order, nulls first; a struct compares field by field."""
    if isinstance(key, Row):
        out, equal = F.lit(False), F.lit(True)
        for name, value in key.asDict().items():
            field = col.getField(name)
            out, equal = out | (equal & before_key(field, value)), equal & field.eqNullSafe(F.lit(value))
        return out
    return F.lit(False) if key is None else col.isNull() | (col < F.lit(key))


class Ranges:
    """(key, size) of a table, dealt out by ranges of the key and written once; only one row a range reaches the driver.

    ``order_col`` should tell rows apart; equal keys fall in one range, in any order.
    """

    def __init__(self, df: DataFrame, order_col: str, size: Column | None = None):
        narrow = df.select(F.col(order_col).alias("key"), (F.lit(1) if size is None else size).cast("bigint").alias("size"))
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        self.table = cut_lineage(narrow.repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()))
        rows = self.table.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy("range").collect()
        self.ids = [r["range"] for r in rows]
        self.rows = [0, *accumulate(r["n"] for r in rows)]  # rows before each range, and all
        self.sizes = [0, *accumulate(r["size"] or 0 for r in rows)]

    @property
    def count(self) -> int:
        return self.rows[-1]

    def _range(self, i: int) -> DataFrame:
        return self.table.where(F.col("range") == self.ids[i])

    def key_at(self, rank: int) -> Any:
        """Key of the row of 0-based ``rank``; one range is sorted, in parallel."""
        i = bisect_right(self.rows, rank) - 1
        inside = rank - self.rows[i]
        return self._range(i).select("key").orderBy("key").offset(inside).limit(1).first()["key"]

    def rank_reaching(self, total: int) -> int | None:
        """Least number of first rows whose sizes add up to ``total`` or more; None if all rows do not."""
        if total <= 0:
            return 0
        if self.sizes[-1] < total:
            return None
        i = next(k for k in range(len(self.ids)) if self.sizes[k + 1] >= total)
        order = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = self._range(i).select(F.sum("size").over(order).alias("upto"), F.count(F.lit(1)).over(order).alias("n"))
        return self.rows[i] + d.where(F.col("upto") >= total - self.sizes[i]).agg(F.min("n")).first()[0]


def hash_cutoffs(df: DataFrame, digest: Column, key: str, ranks: list[int]) -> list[Row | None]:
    """(h, k) of the rows of the given 0-based ranks in the order of (hex digest, key); None for ranks past the end.

    The digests' first digits are counted, and the counts of the prefix that holds a rank are refined by its next digits
    until the prefix is short: narrow passes over the key without a shuffle of rows.
    """
    d = df.select(digest.alias("h"), F.col(key).alias("k"))
    found: list[Row | None] = []
    counts: dict[str, list[Row]] = {}
    for rank in ranks:
        prefix, left, row = "", rank, None
        while True:
            if prefix not in counts:
                longer = F.substring("h", 1, len(prefix) + HEX_DIGITS)
                counts[prefix] = d.where(F.col("h").startswith(prefix)).groupBy(longer.alias("p")).count().orderBy("p").collect()
            bucket = None
            for bucket in counts[prefix]:
                if left < bucket["count"]:
                    break
                left -= bucket["count"]
            else:
                break  # past the end
            prefix = bucket["p"]
            if bucket["count"] <= BUCKET_ROWS or len(prefix) >= 32:
                row = d.where(F.col("h").startswith(prefix)).orderBy("h", "k").offset(left).limit(1).first()
                break
        found.append(row)
    return found
