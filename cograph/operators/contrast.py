"""Contrastive analysis of paired vectors: P9, P11, P13, J6, J8, J9, U3, U4, M1, M2, M3.

Vectors are ``array<double>`` columns; element-wise work stays in higher-order SQL functions
(``zip_with``, ``aggregate``) inside whole-stage codegen. PCA uses ``pyspark.ml.feature.PCA`` on
mean-centred input (only the d x d covariance reaches the driver).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import top_k_per_group

# Fixed values of the reference: side keys in precedence order with display and short labels.
SIDE_PRESETS = (
    (("mechanical", "political"), ("Mech", "Pol"), ("M", "P")),
    (("view_a", "view_b"), ("View A", "View B"), ("A", "B")),
    (("left", "right"), ("Left", "Right"), ("L", "R")),
)
SHIFT_TOP_K = 5
SHIFT_MIN = 1.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def resolve_sides(side_keys: Sequence[str]) -> dict:
    """Choose (base, contrast) side keys from the keys of the first topic."""
    keys = set(side_keys)
    for (a, b), (la, lb), (sa, sb) in SIDE_PRESETS:
        if a in keys and b in keys:
            return {"base": a, "contrast": b, "label_base": la, "label_contrast": lb, "short_base": sa, "short_contrast": sb}
    ks = sorted(keys)
    if len(ks) < 2:
        raise ValueError("a contrast needs two sides of a topic")
    return {"base": ks[0], "contrast": ks[1], "label_base": ks[0], "label_contrast": ks[1], "short_base": "1", "short_contrast": "2"}


def first_topic_sides(long: DataFrame, topic: str = "topic", side: str = "side", order: str | None = None) -> list[str]:
    """Side keys of the first topic (by ``order`` column, else by topic name) — one small driver read."""
    o = order or topic
    first = long.select(F.min(F.struct(o, topic)).alias("m")).first()["m"]
    if first is None:
        raise ValueError("no topics")
    return [r[0] for r in long.filter(F.col(topic) == first[topic]).select(side).distinct().collect()]


def pair_sides(long: DataFrame, base: str, contrast: str, topic: str = "topic", side: str = "side", value: str = "vector") -> DataFrame:
    """One row per topic with both sides (topics missing a side are dropped)."""
    p = long.filter(F.col(side).isin(base, contrast)).groupBy(topic).pivot(side, [base, contrast]).agg(F.first(value))
    return p.select(topic, F.col(f"`{base}`").alias("base"), F.col(f"`{contrast}`").alias("contrast")).filter(
        F.col("base").isNotNull() & F.col("contrast").isNotNull()
    )


def delta_vectors(pairs: DataFrame) -> DataFrame:
    """delta = contrast - base."""
    return pairs.withColumn("delta", F.zip_with("contrast", "base", lambda c, b: c - b))


def feature_shift(base_acts: DataFrame, contrast_acts: DataFrame, k: int = SHIFT_TOP_K, min_increase: float = SHIFT_MIN, topic: str = "topic") -> DataFrame:
    """act_diff = contrast - base (absent = 0); top k per topic, then strictly > min_increase.

    Activations are relu outputs (>= 0), so a positive increase needs the feature active on the
    contrast side: a left join from the contrast activations suffices (no full outer join), and the
    ``> min_increase`` filter may run before the top-k (the kept rows are the largest anyway).
    """
    b = base_acts.select(topic, "feature", F.col("act").alias("a_base"))
    c = contrast_acts.select(topic, "feature", F.col("act").alias("a_contrast"))
    diff = c.join(b, [topic, "feature"], "left").select(
        topic, "feature", (F.col("a_contrast") - F.coalesce("a_base", F.lit(0.0))).alias("activation_increase")
    )
    diff = diff.filter(F.col("activation_increase") > F.lit(float(min_increase)))
    return top_k_per_group(diff, topic, "activation_increase", k, tie="feature")


def format_shift(shifts: DataFrame, labels: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """``label(x.x)`` items, one decimal, comma-joined in rank order."""
    x = shifts
    if labels is not None:
        x = x.join(labels.select("feature", F.col("token").alias("label")), "feature", "left")
    else:
        x = x.withColumn("label", F.col("feature").cast("string"))
    item = F.format_string("%s(%.1f)", F.col("label"), F.col("activation_increase"))
    return x.groupBy(topic).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("s")))), lambda s: s["s"]), ", ").alias("shifts")
    )


def pairwise_cosine(deltas: DataFrame, topic: str = "topic", order: str = "ord", vec: str = "delta", blocks: int = 16, min_cosine: float | None = None) -> DataFrame:
    """Cosine of every unordered topic pair (topic1 before topic2 in ``order``); zero vector -> NULL.

    The topics are cut into ``blocks`` hash blocks and joined tile by tile, an equi-join over
    blocks * (blocks + 1) / 2 tiles: take more blocks for more topics. The output is quadratic by definition
    unless ``min_cosine`` keeps only the pairs that reach it.
    """
    t = deltas.select(topic, order, vec, norm(F.col(vec)).alias("nrm"), F.pmod(F.xxhash64(order), F.lit(blocks)).alias("blk"))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("blk", o).alias("lo"), F.greatest("blk", o).alias("hi")))
    t = t.withColumn("tile", F.explode(tiles))
    side = lambda i: t.select(
        F.col(topic).alias(f"topic{i}"), F.col(order).alias(f"o{i}"), F.col(vec).alias(f"v{i}"), F.col("nrm").alias(f"n{i}"), F.col("blk").alias(f"b{i}"), F.col("tile.lo").alias("lo"), F.col("tile.hi").alias("hi")
    )
    # two topics of one block meet in its diagonal tile alone
    j = side(1).join(side(2), ["lo", "hi"]).filter((F.col("o1") < F.col("o2")) & ((F.col("lo") == F.col("hi")) | (F.col("b1") != F.col("b2"))))
    cos = F.when((F.col("n1") == 0) | (F.col("n2") == 0), F.lit(None).cast("double")).otherwise(dot(F.col("v1"), F.col("v2")) / (F.col("n1") * F.col("n2")))
    out = j.select("topic1", "topic2", cos.alias("cosine_similarity"))
    return out if min_cosine is None else out.filter(F.col("cosine_similarity") >= F.lit(float(min_cosine)))


def square_similarity(cos_pairs: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Symmetric topic x topic matrix with a 1.0 diagonal; rows and columns in topic order."""
    spark = cos_pairs.sparkSession
    long = (
        cos_pairs.select(F.col("topic1").alias("r"), F.col("topic2").alias("c"), F.col("cosine_similarity").alias("v"))
        .unionByName(cos_pairs.select(F.col("topic2").alias("r"), F.col("topic1").alias("c"), F.col("cosine_similarity").alias("v")))
        .unionByName(spark.createDataFrame([(t, t, 1.0) for t in topics], "r string, c string, v double"))
    )
    order = spark.createDataFrame([(t, i) for i, t in enumerate(topics)], "r string, ord int")
    wide = long.groupBy("r").pivot("c", list(topics)).agg(F.first("v"))
    return wide.join(order, "r").orderBy("ord").drop("ord").withColumnRenamed("r", "topic")


def interleave_sides(pairs: DataFrame, label_base: str, label_contrast: str, topic: str = "topic") -> DataFrame:
    """U4: two rows per topic (base then contrast) with label ``topic (Side)``."""
    rows = F.array(
        F.struct(F.lit(0).alias("side_ord"), F.lit(label_base).alias("type"), F.col("base").alias("vector")),
        F.struct(F.lit(1).alias("side_ord"), F.lit(label_contrast).alias("type"), F.col("contrast").alias("vector")),
    )
    x = pairs.select(topic, F.explode(rows).alias("r"))
    return x.select(
        topic,
        "r.side_ord",
        "r.type",
        F.concat(F.col(topic), F.lit(" ("), F.col("r.type"), F.lit(")")).alias("label"),
        "r.vector",
    )


def pca(vectors: DataFrame, k: int = 2, vec: str = "vector") -> tuple[DataFrame, list[float]]:
    """M1: mean-centred PCA; returns (rows + pc1..pck scores, explained variance ratios).

    Component signs are fixed so the largest-|loading| entry is positive.
    """
    import numpy as np

    v = vectors.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(v)
    c = centre.transform(v)
    d = len(vectors.select(vec).first()[0])
    kk = min(k, d)
    model = PCA(k=kk, inputCol="_c", outputCol="_p").fit(c)
    pcs = model.pc.toArray()  # (d, k)
    signs = np.sign(pcs[np.abs(pcs).argmax(axis=0), range(kk)])
    signs[signs == 0] = 1.0
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    out = vector_to_array(model.transform(c)["_p"])
    scored = model.transform(c).withColumn("_pa", vector_to_array("_p"))
    cols = [(F.col("_pa")[i] * float(signs[i])).alias(f"pc{i + 1}") for i in range(kk)]
    del out
    return scored.select(*[x for x in vectors.columns], *cols), ratios


def pca_stats(ratios: Sequence[float], spark) -> DataFrame:
    """PCA stats table: component, explained_variance_ratio, explained_variance_percent."""
    return spark.createDataFrame(
        [(f"PC{i + 1}", float(r), float(r) * 100.0) for i, r in enumerate(ratios)],
        "component string, explained_variance_ratio double, explained_variance_percent double",
    )


def trajectory_table(pairs: DataFrame, label_base: str, label_contrast: str, topic: str = "topic") -> tuple[DataFrame, list[float]]:
    """M3: topic, type, label, pc1, pc2 — two rows per topic from M1 over all base/contrast vectors."""
    rows = interleave_sides(pairs, label_base, label_contrast, topic)
    scored, ratios = pca(rows, 2, "vector")
    return scored.select(topic, "type", "label", "pc1", "pc2"), ratios


def pca_deltas(pairs_with_delta: DataFrame, topic: str = "topic") -> tuple[DataFrame, list[float]]:
    """M2: PCA of the delta vectors, one row per topic: topic, pc1, pc2."""
    scored, ratios = pca(pairs_with_delta.select(topic, "delta"), 2, "delta")
    return scored.select(topic, "pc1", "pc2"), ratios
