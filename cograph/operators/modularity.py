"""Weighted degrees and modularity of a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import symmetrize


def degrees(edges: DataFrame) -> DataFrame:
    """Weighted degree per node; a self-loop counts twice."""
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("id"), (F.col("weight") * 2).alias("w"))
    plain = edges.filter(F.col("src") != F.col("dst"))
    both = symmetrize(plain).select("id", F.col("weight").alias("w")).unionByName(loops)
    return both.groupBy("id").agg(F.sum("w").alias("k"))


def modularity_value(edges: DataFrame, communities: DataFrame, m: float | None = None) -> float:
    """A7 as a scalar: Q = sum_c [L_c/m - (D_c/2m)^2], weighted, resolution 1 (one Spark job)."""
    if m is None:
        m = edges.agg(F.sum("weight")).first()[0]
    if not m:
        return 0.0
    return float(_modularity(edges, communities, float(m)).first()[0])


def _modularity(edges: DataFrame, communities: DataFrame, m: float) -> DataFrame:
    cs = communities.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    cd = communities.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    intra = (
        edges.join(cs, "src")
        .join(cd, "dst")
        .filter(F.col("cs") == F.col("cd"))
        .select(F.col("cs").alias("community"), F.col("weight").alias("l"), F.lit(0.0).alias("d"))
    )
    deg = degrees(edges).join(communities, "id").select("community", F.lit(0.0).alias("l"), F.col("k").alias("d"))
    per_c = intra.unionByName(deg).groupBy("community").agg(F.sum("l").alias("l"), F.sum("d").alias("d"))
    two_m = 2.0 * m
    return per_c.agg(
        (F.coalesce(F.sum("l"), F.lit(0.0)) / F.lit(m) - F.coalesce(F.sum((F.col("d") / two_m) * (F.col("d") / two_m)), F.lit(0.0))).alias(
            "modularity"
        )
    )


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """A7 as a one-row DataFrame ``modularity``."""
    q = modularity_value(edges, communities)
    return edges.sparkSession.createDataFrame([(q,)], "modularity double")
