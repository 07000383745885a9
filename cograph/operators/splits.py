"""Seeded, exact, disjoint three-way split.

Rows are ordered by md5(key || seed); the part sizes follow the reference's two-step rule (test off the
whole, then valid off the rest at valid/(train+valid)), each step taking ceil(fraction * n) rows. The keys at
the two cuts are found by counting prefixes of the hash, and the split is a comparison with them: no row
is ranked, shuffled or written. ``randomSplit`` is not used: it is not stable when the input partitioning
changes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import before_key, hash_cutoffs

SPLIT_SEED = 42  # fixed value: the reference's default seed
RATIO_TOLERANCE = 1e-6


def split_sizes(n: int, train: float, valid: float, test: float) -> tuple[int, int, int]:
    if abs(train + valid + test - 1.0) > RATIO_TOLERANCE:
        raise ValueError(f"ratios must sum to 1 (got {train + valid + test})")
    n_test = math.ceil(test * n)
    rest = n - n_test
    n_valid = math.ceil((valid / (train + valid)) * rest) if rest else 0
    return rest - n_valid, n_valid, n_test


def split_3way(df: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, test: float = 0.15, seed: int = SPLIT_SEED) -> DataFrame:
    """Adds ``split`` in {train, valid, test}; every row gets exactly one. Rows of equal keys stay together; the sizes are
    exact where ``key`` tells rows apart."""
    n = df.count()
    _, n_valid, n_test = split_sizes(n, train, valid, test)
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    ends = hash_cutoffs(df, digest, key, [n_test, n_test + n_valid])
    place = F.struct(digest.alias("h"), F.col(key).alias("k"))
    before = [F.lit(True) if end is None else before_key(place, end) for end in ends]
    return df.withColumn("split", F.when(before[0], F.lit("test")).when(before[1], F.lit("valid")).otherwise(F.lit("train")))
