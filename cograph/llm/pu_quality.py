"""Operator 10, quality classifier by positive-unlabelled learning.

A logistic model over text statistics minimises the non-negative unbiased risk
``prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))`` from trusted positives and unlabelled
rows; labels other than the positives are not used in that risk. The class prior is the one for which the
positives' score distribution explains the unlabelled one: the smallest ratio, over score thresholds, of
the unlabelled to the positive share under the threshold's complement, bounded for noise. The model is fitted on
bounded samples; every text is scored whole, inside tasks, from Arrow buffers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, ship
from .words import chunks, words

# Byte classes counted for each text; fixed values.
_CLASSES = [
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, 9)), ("line", (10, 13)),
    ("stop", (46, 33, 63)), ("comma", (44, 59, 58)), ("quote", (34, 39, 96)), ("bracket", (40, 41, 91, 93, 123, 125, 60, 62)),
    ("wide", range(128, 256)), ("control", (*range(0, 9), 11, 12, *range(14, 32), 127)),
] + [(f"sign{b}", (b,)) for b in b"!#$%&*+-/=@\\^_|~"]
_CLASS_OF = np.zeros(256, np.int64)
for _k, (_, _bytes) in enumerate(_CLASSES):
    for _b in _bytes:
        _CLASS_OF[_b] = _k
N_FEATURES = 2 * len(_CLASSES) + 9
_SPAN = 1 << 18  # bytes whose classes are counted at once


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text: shares of byte classes (plain and as square roots), word lengths,
    repetition of words and neighbours, shares of words that end in a sign or are all upper case, size."""
    out = np.zeros((len(texts), N_FEATURES))
    c = len(_CLASSES)
    for first, data, bounds in chunks(texts):
        hashes, start, end, at = words(data, bounds)
        n_texts, sizes = len(bounds) - 1, np.diff(bounds)
        share = np.zeros((n_texts, c))
        for a in range(0, len(data), _SPAN):  # the wide index arrays of a long text are made a span at a time
            part = data[a : a + _SPAN]
            i, j = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, a + len(part), "left")
            text_of = np.repeat(np.arange(j - i), np.diff(np.clip(bounds[i : j + 1], a, a + len(part))))
            share[i:j] += np.bincount(text_of * c + _CLASS_OF[part], minlength=(j - i) * c).reshape(j - i, c)
        share /= np.maximum(sizes, 1)[:, None]
        n_words = np.diff(at)
        word_of = np.repeat(np.arange(n_texts), n_words)
        per = lambda flags: np.bincount(word_of, flags, minlength=n_texts) / np.maximum(n_words, 1)
        length = (end - start).astype(float)
        last, head = data[end - 1], data[start]
        alike = np.zeros(len(hashes))
        alike[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
        kinds = np.array([len(np.unique(hashes[at[i] : at[i + 1]])) for i in range(n_texts)])
        letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
        plain_end = letter(last) | np.isin(last, np.frombuffer(b".,;:?", np.uint8))
        rows = out[first : first + n_texts]
        rows[:, :c], rows[:, c : 2 * c] = share, np.sqrt(share)
        mean = per(length)
        rows[:, 2 * c :] = np.stack([
            np.log1p(n_words) / 10, np.log1p(mean), np.log1p(per(length**2) - mean**2 + 1e-9), per(alike), kinds / np.maximum(n_words, 1),
            per((~plain_end).astype(float)), per((~letter(head)).astype(float)), per(((head >= 65) & (head <= 90)).astype(float)),
            np.minimum(kinds, 200) / 200 * (1 - per(alike)),
        ], axis=1)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from scores: the least share of unlabelled to positive rows over the upper score sets.

    In a set of scores that only positives reach, unlabelled rows are there ``prior`` times as often; sets with
    under a tenth of the positives are too noisy to be used.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 46))
    p = np.array([(positive >= q).mean() for q in cuts])
    u = np.array([(unlabelled >= q).mean() for q in cuts])
    return float(np.clip((u / p).min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Model by full-batch Adam on the non-negative risk; without ``prior`` it is estimated once from a first
    fit of positives against unlabelled. Without positives or unlabelled rows the model is constant."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))

    def descend(pi: float | None) -> tuple[np.ndarray, float]:
        w, m, v = np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES + 1)
        for t in range(1, rounds + 1):
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
            if pi is None:  # positives against unlabelled, half and half
                gp, gu = 0.5 * (sp - 1) / len(p), 0.5 * su / len(u)
            else:
                negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
                gp, gu = pi * (sp - 1) / len(p), np.zeros(len(u))
                if negative >= 0:
                    gp, gu = gp - pi * sp / len(p), su / len(u)
                else:  # the negative part must not fall below zero: step back from it alone
                    gp, gu = pi * sp / len(p), -su / len(u)
            g = np.append(gp @ p + gu @ u, gp.sum() + gu.sum()) + decay * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w[:-1], float(w[-1])

    if prior is None:
        w, b = descend(None)
        prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = descend(prior)
    return Model(mean, scale, w, b, prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 10_000, unlabelled: int = 20_000) -> Model:
    """Fit on rows outside fold 0: up to ``positives`` rows labelled 1 and up to ``unlabelled`` rows whatever
    their label (both of the smallest id hashes); labels of other values and of fold 0 are not read. Rows that repeat
    an id count once, with the least of their texts, so the bounds hold for rows."""
    ship(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).where(fold("id") != 0).distinct()
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    pick = lambda d, n, kind: d.orderBy(F.xxhash64(F.lit(kind), F.col("id")), "id").limit(n).select("id", F.lit(kind).alias("kind"))
    chosen = pick(ids.join(good, "id", "left_semi"), positives, "p").unionByName(pick(ids, unlabelled, "u"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("kind", "id").agg(F.min("text").alias("text"))  # one row an id, however many the table has

    def measure(batches):
        for batch in batches:
            x = features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], names=["kind", "x"])

    got = texts.select("kind", "text").mapInArrow(measure, "kind string, x array<double>").toArrow()
    kind = np.array(got["kind"].to_pylist())
    x = np.array(got["x"].to_pylist(), float).reshape(-1, N_FEATURES)
    order = np.lexsort(x.T[::-1])  # the same sums in any order of the rows
    x, kind = x[order], kind[order]
    return fit(x[kind == "p"], x[kind == "u"])


def score(model: Model, text: Column, spark) -> Column:
    """Score column (0 to 1) of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(features(texts)))

    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``held_out, score, predicted``.

    Only the whole text is read for a score. Null and empty texts are scored like a text without words; rows
    that repeat score alike; an empty table gives an empty result; a null id counts as held out; input
    columns named like a result column are replaced.
    """
    d = docs.drop(*({"held_out", "score", "predicted"} - {id_col, text_col}))
    d = d.withColumn("held_out", fold(id_col) == 0).withColumn("score", score(model, F.col(text_col), docs.sparkSession))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
