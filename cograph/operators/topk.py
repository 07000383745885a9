"""Top-k per group. ``row_number`` over (group; score desc, tie asc) <= k — Spark plans it as a
partial + final ``WindowGroupLimit``, so each task keeps at most k rows per group before the
shuffle (a hot group never ships more than k rows per task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group: str | list[str], score: str, k: int, tie: str = "id", name: str = "rank") -> DataFrame:
    groups = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
