"""Group-held-out classification of difference vectors: P12, P16, P17, M4-M9, J11, A11-A15, W9.

Models are ``pyspark.ml`` estimators over ``VectorUDT`` columns. The reference's exact dual
kernel SVMs are re-aimed: linear -> LinearSVC; rbf -> LinearSVC on a seeded random Fourier feature
map (Arrow-batched pandas UDF); poly -> LinearSVC on random features of the cubic kernel. Evaluation tables are plain aggregates over a predictions table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .order import before_key, hash_cutoffs

SEED = 42  # fixed value: the reference's seed
KERNELS = ("linear", "rbf", "poly")  # fixed value: order used for ties in model selection
LABEL_NAMES = ("Left", "Right")  # fixed value: 0 -> Left, 1 -> Right


def signed_diffs(pairs: DataFrame, topic: str = "topic") -> DataFrame:
    """Two rows per topic: (contrast - base, label 1) and (base - contrast, label 0)."""
    rows = F.array(
        F.struct(F.zip_with("contrast", "base", lambda c, b: c - b).alias("x"), F.lit(1).alias("label")),
        F.struct(F.zip_with("base", "contrast", lambda b, c: b - c).alias("x"), F.lit(0).alias("label")),
    )
    return pairs.select(topic, F.explode(rows).alias("r")).select(topic, "r.x", "r.label")


def topic_group_split(rows: DataFrame, seed: int = SEED, topic: str = "topic") -> DataFrame:
    """M9: (topic, split): floor(n/2) topics to train in md5(topic||seed) order, the rest to test."""
    topics = cut_lineage(rows.select(topic).distinct())
    digest = F.md5(F.concat_ws("|", F.col(topic).cast("string"), F.lit(str(seed))))
    end = hash_cutoffs(topics, digest, topic, [topics.count() // 2])[0]
    train = F.lit(False) if end is None else before_key(F.struct(digest.alias("h"), F.col(topic).alias("k")), end)
    return topics.select(topic, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def split_mask(rows: DataFrame, splits: DataFrame, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Rows whose topic is in train (semi join) and the complement (anti join)."""
    train_topics = splits.filter(F.col("split") == "train").select(topic)
    return rows.join(train_topics, topic, "left_semi"), rows.join(train_topics, topic, "left_anti")


def label_balance(rows: DataFrame, splits: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """Rows per label, overall ('all') and per split."""
    overall = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit("all"))
    if splits is None:
        return overall.select("split", "label", "n")
    per = rows.join(splits, topic).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return overall.select("split", "label", "n").unionByName(per.select("split", "label", "n"))


def fit_standardizer(train: DataFrame, x: str = "x") -> tuple[list[float], list[float]]:
    """M4 fit: per-dimension mean and *population* std on the training rows (d scalars each)."""
    stats = (
        train.select(F.posexplode(x).alias("dim", "v"))
        .groupBy("dim")
        .agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
        .orderBy("dim")
        .collect()
    )
    mu = [float(r["mu"]) for r in stats]
    sd = [float(r["sd"]) if r["sd"] and r["sd"] > 0 else 1.0 for r in stats]  # constant column -> scale 1
    return mu, sd


def apply_standardizer(df: DataFrame, mu, sd, x: str = "x", out: str = "z") -> DataFrame:
    """M4 transform: (x - mean) / std with the training statistics."""
    m = F.array(*[F.lit(v) for v in mu])
    s = F.array(*[F.lit(v) for v in sd])
    return df.withColumn(out, F.transform(F.col(x), lambda v, i: (v - F.element_at(m, i + 1)) / F.element_at(s, i + 1)))


def standardize(train: DataFrame, test: DataFrame, x: str = "x") -> tuple[DataFrame, DataFrame]:
    mu, sd = fit_standardizer(train, x)
    return apply_standardizer(train, mu, sd, x), apply_standardizer(test, mu, sd, x)


def _svc(reg: float = 0.01, max_iter: int = 100) -> LinearSVC:
    # With +-paired rows the training mean is 0: no intercept is needed; inputs are already scaled.
    return LinearSVC(
        featuresCol="f", labelCol="label", predictionCol="pred", regParam=reg, maxIter=max_iter, fitIntercept=False, standardization=False
    )


def svm_linear(train: DataFrame, test: DataFrame, z: str = "z"):
    """M5: linear SVM; returns (train predictions, test predictions)."""
    tr = train.withColumn("f", array_to_vector(z))
    te = test.withColumn("f", array_to_vector(z))
    model = _svc().fit(tr)
    return model.transform(tr), model.transform(te)


def _by_slabs(rows: pa.ListArray, d: int, n_features: int, features, slab: int = 256) -> pa.ListArray:
    """``features`` of the rows (of ``d`` numbers each), a slab at a time, in one array that holds the result and no row objects."""
    if rows.null_count or (np.diff(rows.offsets.to_numpy()) != d).any():
        raise ValueError(f"every row needs {d} numbers")
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
    out = np.empty((len(x), n_features))
    for i in range(0, len(x), slab):
        out[i : i + slab] = features(x[i : i + slab])
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * n_features, pa.array(out.ravel()))


def _rff_udf(d: int, n_features: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    @F.arrow_udf("array<double>")
    def rff(col: pa.Array) -> pa.Array:
        return _by_slabs(col, d, n_features, lambda x: scale * np.cos(x @ w + b))

    return rff


def svm_rbf(train: DataFrame, test: DataFrame, z: str = "z", n_features: int = 512, seed: int = SEED):
    """M6: RBF kernel approximated by random Fourier features; gamma='scale' = 1/(d Var(X))."""
    d = len(train.select(z).first()[0])
    var = train.select(F.explode(z).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    gamma = 1.0 / (d * var) if var > 0 else 1.0
    ship_package(train.sparkSession)
    rff = _rff_udf(d, n_features, gamma, seed)
    tr = train.withColumn("f", array_to_vector(rff(F.col(z))))
    te = test.withColumn("f", array_to_vector(rff(F.col(z))))
    model = _svc().fit(tr)
    return model.transform(tr), model.transform(te)


def _cubic_udf(d: int, n_features: int, gamma: float, seed: int):
    """Random features whose inner products estimate (gamma x.y)^3: products of three random sign sums."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, d, n_features))
    scale = gamma**1.5 / math.sqrt(n_features)

    @F.arrow_udf("array<double>")
    def cubic(col: pa.Array) -> pa.Array:
        return _by_slabs(col, d, n_features, lambda x: scale * (x @ signs[0]) * (x @ signs[1]) * (x @ signs[2]))

    return cubic


def svm_poly(train: DataFrame, test: DataFrame, z: str = "z", n_features: int = 1024, seed: int = SEED):
    """M7: cubic polynomial kernel (gamma='scale', no constant) over all dimensions, by unbiased random features;
    the error of a kernel value falls with the square root of ``n_features``."""
    d = len(train.select(z).first()[0])
    var = train.select(F.explode(z).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    ship_package(train.sparkSession)
    cubic = _cubic_udf(d, n_features, 1.0 / (d * var) if var > 0 else 1.0, seed)
    tr = train.withColumn("f", array_to_vector(cubic(F.col(z))))
    te = test.withColumn("f", array_to_vector(cubic(F.col(z))))
    model = _svc().fit(tr)
    return model.transform(tr), model.transform(te)


def predictions_table(pred: DataFrame, topic: str = "topic") -> DataFrame:
    """Topic, true_label, predicted_label (Left/Right) and the correct flag."""
    name = lambda c: F.when(c == 1, F.lit(LABEL_NAMES[1])).otherwise(F.lit(LABEL_NAMES[0]))
    return pred.select(
        topic,
        name(F.col("label")).alias("true_label"),
        name(F.col("pred").cast("int")).alias("predicted_label"),
        (F.col("label") == F.col("pred").cast("int")).alias("correct"),
    )


def accuracy(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Correct / total (optionally grouped)."""
    c = (F.col("label") == F.col("pred").cast("int")).cast("double")
    return (pred.groupBy(*by) if by else pred.groupBy()).agg(F.avg(c).alias("accuracy"))


def compare_models(train: DataFrame, test: DataFrame, z: str = "z"):
    """M8: fit all kernels; (metrics(kernel, train_accuracy, test_accuracy), {kernel: test predictions})."""
    spark = train.sparkSession
    rows, preds = [], {}
    for kernel, fn in (("linear", svm_linear), ("rbf", svm_rbf), ("poly", svm_poly)):
        ptr, pte = fn(train, test, z)
        a_tr = accuracy(ptr).first()[0]
        a_te = accuracy(pte).first()[0]
        rows.append((kernel, float(a_tr or 0.0), float(a_te or 0.0)))
        preds[kernel] = pte
    metrics = spark.createDataFrame(rows, "kernel string, train_accuracy double, test_accuracy double")
    return metrics, preds


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest test accuracy; ties -> first of linear, rbf, poly."""
    ordinal = F.array_position(F.array(*[F.lit(k) for k in KERNELS]), F.col("kernel"))
    return metrics.orderBy(F.col("test_accuracy").desc(), ordinal.asc()).limit(1)


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """rows = true label, columns pred_0 / pred_1, missing cells 0."""
    y, p = F.col("label").cast("int"), F.col("pred").cast("int")
    cell = lambda t, c: F.count(F.when((y == t) & (p == c), 1))
    cells = pred.agg(*[cell(t, c).alias(f"c{t}{c}") for t in (0, 1) for c in (0, 1)])
    return cells.select(F.expr("stack(2, 0, c00, c01, 1, c10, c11) AS (true_label, pred_0, pred_1)"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision / recall / f1 / support per class, then accuracy, macro avg, weighted avg (0 when undefined)."""
    y, p = F.col("label").cast("int"), F.col("pred").cast("int")
    hits = lambda flag: F.coalesce(F.sum(flag.cast("double")), F.lit(0.0))
    counts = pred.agg(*[c for k in (0, 1) for c in (
        hits((y == k) & (p == k)).alias(f"tp{k}"), hits(p == k).alias(f"pp{k}"), hits(y == k).alias(f"support{k}"))])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    for k in (0, 1):
        tp = F.col(f"tp{k}")
        counts = counts.withColumn(f"precision{k}", share(tp, F.col(f"pp{k}"))).withColumn(f"recall{k}", share(tp, F.col(f"support{k}")))
        pr, rc = F.col(f"precision{k}"), F.col(f"recall{k}")
        counts = counts.withColumn(f"f1{k}", share(2 * pr * rc, pr + rc))
    n = F.col("support0") + F.col("support1")
    both = lambda name, w0, w1: F.col(f"{name}0") * w0 + F.col(f"{name}1") * w1
    right = share(F.col("tp0") + F.col("tp1"), n)
    line = lambda name, k, vals, support: F.struct(
        F.lit(name).alias("class"), F.lit(k).alias("ord"), *[v.alias(m) for m, v in zip(("precision", "recall", "f1"), vals)], support.alias("support"))
    names = ("precision", "recall", "f1")
    rows = [line(LABEL_NAMES[k], k, [F.col(f"{m}{k}") for m in names], F.col(f"support{k}")) for k in (0, 1)]
    rows.append(line("accuracy", 2, [right] * 3, n))
    rows.append(line("macro avg", 3, [both(m, 0.5, 0.5) for m in names], n))
    rows.append(line("weighted avg", 4, [share(both(m, F.col("support0"), F.col("support1")), n) for m in names], n))
    return counts.select(F.inline(F.array(*rows)))


def per_topic_accuracy(pred: DataFrame, topic: str = "topic") -> DataFrame:
    """Accuracy per test topic, descending (ties by topic)."""
    return accuracy(pred, [topic]).orderBy(F.col("accuracy").desc(), F.col(topic).asc())


def accuracy_bucket(acc_col: str = "accuracy"):
    """1.0 -> green, >= 0.5 -> orange, else red."""
    a = F.col(acc_col)
    return F.when(a == 1.0, F.lit("green")).when(a >= 0.5, F.lit("orange")).otherwise(F.lit("red"))
