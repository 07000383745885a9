"""Dictionary (sparse-autoencoder style) features: P5, P6, J7, W7, W8, W10, J4, J5.

The dictionary is a table ``(feature int, w_enc array<double>, b_enc double, w_dec array<double>)``
plus one ``b_dec`` vector. It is model parameters: they are broadcast and the big side (vectors, vocabulary) stays
where it is and is read once. A dictionary of many cells is written as blocks of features, which the driver broadcasts
one after another, holding one at a time; a task gathers a slab of rows and takes the blocks in turn from the files that
Spark keeps on its executor, so that it too holds one. Products run as numpy matmuls on tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .graph import symmetrize
from .topk import top_k_per_group

ACTIVATION_THRESHOLD = 1.0  # fixed value: the reference's activation threshold (strict >)
BROADCAST_CELLS = 8_000_000  # features x dimension up to which the dictionary is broadcast (64 MB of doubles a matrix)
BLOCK_CELLS = 4_000_000  # features x dimension of one block of a larger dictionary, and rows x dimension of a slab
TILE_CELLS = 2_000_000  # rows x features of one product
ISOLATED = "ISOLATED"  # fixed value: label of a probe feature without graph neighbours


def _keys(seq) -> list[str]:
    return [seq] if isinstance(seq, str) else list(seq)


class Dictionary:
    """Driver-side handle of broadcast dictionary weights."""

    def __init__(self, features, w_enc, b_enc, w_dec, b_dec):
        self.features = np.asarray(features, dtype=np.int64)
        self.w_enc = np.asarray(w_enc, dtype=np.float64)  # (F, d)
        self.b_enc = np.asarray(b_enc, dtype=np.float64)  # (F,)
        self.w_dec = np.asarray(w_dec, dtype=np.float64)  # (F, d)
        self.b_dec = np.asarray(b_dec, dtype=np.float64)  # (d,)

    @property
    def dim(self) -> int:
        return int(self.w_enc.shape[1]) if self.w_enc.size else int(self.b_dec.shape[0])

    @classmethod
    def from_table(cls, table: DataFrame, b_dec=None) -> "Dictionary":
        """A dictionary of few cells as driver-side parameters (see ``load_dictionary``)."""
        pdf = table.select("feature", "w_enc", "b_enc", "w_dec").orderBy("feature").toPandas()
        d = len(pdf["w_enc"].iloc[0]) if len(pdf) else 0
        w_enc = np.stack(pdf["w_enc"].map(np.asarray).to_list()) if len(pdf) else np.zeros((0, d))
        w_dec = np.stack(pdf["w_dec"].map(np.asarray).to_list()) if len(pdf) else np.zeros((0, d))
        return cls(pdf["feature"].to_numpy(), w_enc, pdf["b_enc"].to_numpy(dtype=np.float64), w_dec, np.zeros(d) if b_dec is None else b_dec)


@dataclass(frozen=True)
class DictionaryTable:
    """A dictionary that stays a table because it is too large for the driver to hold at once."""

    table: DataFrame
    n_features: int
    dim: int
    b_dec: np.ndarray
    block_cells: int | None = None  # None: BLOCK_CELLS

    def blocks(self, weights: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """(features, *weights) of blocks of about ``block_cells`` cells, features ascending in each; one is read at a time."""
        n = max(1, -(-self.n_features * max(self.dim, 1) // (self.block_cells or BLOCK_CELLS)))
        dealt = self.table.select("feature", *weights).withColumn("block", F.pmod(F.xxhash64("feature"), F.lit(n)).cast("int"))
        written = cut_lineage(dealt.repartition(n, "block"), partition_by="block")
        for i in range(n):
            rows = written.where(F.col("block") == i).select("feature", *weights).orderBy("feature").toArrow()
            if rows.num_rows:
                flat = [rows[w].combine_chunks() for w in weights]
                yield rows["feature"].to_numpy().astype(np.int64), *[
                    c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) if w.startswith("w_") else c.to_numpy(zero_copy_only=False).astype(np.float64)
                    for w, c in zip(weights, flat, strict=True)]


def load_dictionary(table: DataFrame, b_dec=None, broadcast_cells: int = BROADCAST_CELLS, block_cells: int | None = None) -> Dictionary | DictionaryTable:
    """S8 read side: driver-side parameters up to ``broadcast_cells``, the table itself beyond, to be used in blocks of
    ``block_cells``; any size works and gives the same."""
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w_enc")).alias("d"), F.min(F.size("w_enc")).alias("d0")).first()
    n, d = int(stats["n"] or 0), int(stats["d"] or 0)
    if n and stats["d0"] != d:
        raise ValueError("dictionary rows have different dimensions")
    bd = np.zeros(d) if b_dec is None else np.asarray(b_dec, dtype=np.float64)
    if bd.shape[0] != d:
        raise ValueError(f"b_dec has {bd.shape[0]} dims, dictionary has {d}")
    return Dictionary.from_table(table, bd) if n * max(d, 1) <= broadcast_cells else DictionaryTable(table, n, d, bd, block_cells)


def _matrix(col: pd.Series, d: int) -> np.ndarray:
    x = np.stack(col.map(lambda v: np.asarray(v, dtype=np.float64)).to_list())
    if x.shape[1] != d:
        raise ValueError(f"vector dimension {x.shape[1]} != dictionary dimension {d}")
    return x


def _taken(block):
    """Value of a broadcast in a task; not kept, the next use reads Spark's local file again."""
    value = block.value
    if getattr(block, "_path", None):
        vars(block).pop("_value", None)
    return value


def _slabs(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of ``rows`` rows."""
    held, n = [], 0
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            part = pdf.iloc[a : a + rows]
            if n and n + len(part) > rows:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield pd.concat(held, ignore_index=True)


def _against_dictionary(rows: DataFrame, dictionary: Dictionary | DictionaryTable, weights: list[str], product: Callable, schema: str) -> DataFrame:
    """``product(rows, features, *weights)`` (a generator of frames) for all rows with all features, in one pass over the
    rows where they are. Of a larger dictionary a slab of rows meets block after block."""
    ship_package(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    whole = isinstance(dictionary, Dictionary)
    blocks = [(dictionary.features, *[getattr(dictionary, w) for w in weights])] if whole else dictionary.blocks(weights)
    shared = [sc.broadcast(block) for block in blocks if len(block[0])]  # a generator: one block is held at a time
    slab = max(1, BLOCK_CELLS // max(dictionary.dim, 1))  # rows that meet a block at once

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches if whole else _slabs(batches, slab):
            for block in shared if len(pdf) else []:
                yield from product(pdf, *(block.value if whole else _taken(block)))

    return rows.mapInPandas(meet, schema)


def encode_features(
    vectors: DataFrame,
    dictionary: Dictionary | DictionaryTable,
    key: str | list[str] = "ctx",
    vector: str = "vector",
    threshold: float | None = 0.0,
) -> DataFrame:
    """P5: a_f = relu((x - b_dec) . W_enc[:, f] + b_enc[f]); returns long ``(key.., feature, act)``.

    Only activations strictly above ``threshold`` are emitted (0.0: the non-zero relu outputs;
    None: every feature, zeros included). Dimension mismatch raises.
    """
    keys = _keys(key)
    d, b_dec = dictionary.dim, dictionary.b_dec
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keys).schema.fields)

    def product(pdf: pd.DataFrame, feats, w_enc, b_enc) -> Iterator[pd.DataFrame]:
        step = max(1, TILE_CELLS // len(feats))
        for a in range(0, len(pdf), step):
            part = pdf.iloc[a : a + step]
            acts = np.maximum((_matrix(part[vector], d) - b_dec) @ w_enc.T + b_enc, 0.0)
            rows, cols = np.nonzero(np.ones_like(acts, bool) if threshold is None else acts > threshold)
            out = {k: part[k].to_numpy()[rows] for k in keys}
            yield pd.DataFrame(out | {"feature": feats[cols].astype(np.int32), "act": acts[rows, cols]})

    return _against_dictionary(vectors.select(*keys, vector), dictionary, ["w_enc", "b_enc"], product, f"{key_ddl}, feature int, act double")


def active_features(
    acts: DataFrame,
    contexts: DataFrame,
    threshold: float = ACTIVATION_THRESHOLD,
    key: str = "ctx",
) -> DataFrame:
    """``(ctx, features array<int>)`` with act > threshold (strict); contexts with none keep []."""
    sets = acts.filter(F.col("act") > F.lit(float(threshold))).groupBy(key).agg(F.sort_array(F.collect_set("feature")).alias("features"))
    return contexts.select(key).join(sets, key, "left").select(
        key, F.coalesce("features", F.array().cast("array<int>")).alias("features")
    )


def label_features(
    dictionary: Dictionary | DictionaryTable,
    unembed: DataFrame,
    k: int = 5,
    token: str = "token",
    vector: str = "w_u",
) -> DataFrame:
    """Per feature, the k tokens with the largest logit W_dec[f] . W_U[token].

    The vocabulary stays partitioned. Each batch keeps only its own top-k per feature, then a
    ``WindowGroupLimit`` top-k merges them.
    """
    d = dictionary.dim

    def product(pdf: pd.DataFrame, feats, w_dec) -> Iterator[pd.DataFrame]:
        u, toks = _matrix(pdf[vector], d), pdf[token].to_numpy()
        kk, step = min(k, len(u)), max(1, TILE_CELLS // len(u))
        for a in range(0, len(feats), step):
            logits = w_dec[a : a + step] @ u.T
            # candidates: per feature every token at or above the batch's kk-th best logit
            # (ties kept, so the final token-ascending tie-break stays exact)
            kth = -np.partition(-logits, kk - 1, axis=1)[:, kk - 1 : kk]
            rows, cols = np.nonzero(logits >= kth)
            yield pd.DataFrame({"feature": feats[a + rows].astype(np.int32), "token": toks[cols], "logit": logits[rows, cols]})

    cands = _against_dictionary(unembed.select(token, vector), dictionary, ["w_dec"], product, "feature int, token string, logit double")
    return top_k_per_group(cands, "feature", "logit", k, tie="token")


def locate_target(tokens: DataFrame, target: str | None = None, seq: str = "seq", pos: str = "pos", token: str = "token", target_col: str | None = None) -> DataFrame:
    """Per sequence, the first position whose token contains the trimmed target, else the last.

    The target is either one string for all sequences or a column of ``tokens`` (``target_col``).
    """
    t = F.trim(F.col(target_col)) if target_col else F.lit(target.strip())
    hit = F.when(F.col(token).contains(t), F.col(pos))
    return tokens.groupBy(*_keys(seq)).agg(F.coalesce(F.min(hit), F.max(pos)).alias("target_pos"))


def last_token_vector(tokens: DataFrame, seq: str = "seq", pos: str = "pos", vector: str = "vector", vectors: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """The vector of the final position of each sequence.

    With ``vectors`` (key, vector) the tokens carry the key of their vector: the final position is chosen by numbers, only
    chosen rows meet the vectors. A key that repeats stands for one of its vectors; a token's key must be among them.
    """
    if vectors is None:
        return tokens.groupBy(*_keys(seq)).agg(F.max_by(F.col(vector), F.col(pos)).alias(vector))
    last = tokens.groupBy(*_keys(seq)).agg(F.max(F.struct(pos, key)).alias("last")).select(*_keys(seq), F.col(f"last.{key}").alias(key))
    one = vectors.groupBy(key).agg(F.any_value(vector).alias(vector))
    return last.join(one, key).select(*_keys(seq), vector)


def vector_at(tokens: DataFrame, located: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Token rows at the located position (one per sequence)."""
    return tokens.join(located, _keys(seq)).filter(F.col(pos) == F.col("target_pos")).drop("target_pos")


def probe_top_features(
    tokens: DataFrame,
    dictionary: Dictionary,
    target: str,
    k: int = 3,
    seq: str = "seq",
    vector: str = "vector",
    vectors: DataFrame | None = None,
    key: str = "vec_id",
) -> DataFrame:
    """The k strongest (unthresholded) activations at the located token; rank 1..k. ``vectors``: as in W8."""
    at = vector_at(tokens, locate_target(tokens, target, seq), seq)
    if vectors is not None:
        at = at.join(vectors, key)
    acts = encode_features(at, dictionary, [*_keys(seq), "token"], vector, threshold=None)
    return top_k_per_group(acts, _keys(seq), "act", k, tie="feature")


def neighbours(edges: DataFrame, ids: DataFrame, k: int = 4, id_col: str = "feature") -> DataFrame:
    """Strongest k neighbours per probed id (left join: ids without edges get no row here)."""
    sym = symmetrize(edges).withColumnRenamed("id", id_col)
    j = ids.select(id_col).distinct().join(sym, id_col, "left")
    w = Window.partitionBy(id_col).orderBy(F.col("weight").desc_nulls_last(), F.col("nbr").asc())
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def format_neighbours(nbrs: DataFrame, labels: DataFrame | None = None, id_col: str = "feature") -> DataFrame:
    """``tok(0.12) | tok(0.10)`` per id, strongest first, 2 decimals; no neighbour -> ISOLATED."""
    x = nbrs
    if labels is not None:
        x = x.join(labels.select(F.col("feature").alias("nbr"), F.col("token").alias("nbr_label")), "nbr", "left")
    else:
        x = x.withColumn("nbr_label", F.col("nbr").cast("string"))
    item = F.format_string("%s(%.2f)", F.col("nbr_label"), F.col("weight"))
    agg = x.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.when(F.col("nbr").isNotNull(), F.struct("rank", item.alias("s"))))).alias("items")
    )
    return agg.select(
        id_col,
        F.when(F.size("items") == 0, F.lit(ISOLATED)).otherwise(F.array_join(F.transform("items", lambda s: s["s"]), " | ")).alias("neighbors"),
    )


def ego_graph(edges: DataFrame, target, radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, is_target, weight_to_target), edges among them); empty when the target is absent."""
    sym = symmetrize(edges)
    nodes = sym.filter(F.col("id") == F.lit(target)).select(F.col("nbr").alias("id"), F.col("weight").alias("weight_to_target"))
    for _ in range(radius - 1):  # the target itself is no neighbour
        nodes = nodes.unionByName(
            sym.join(nodes.select(F.col("id").alias("_s")), F.col("id") == F.col("_s"), "left_semi").select(
                F.col("nbr").alias("id"), F.lit(None).cast("double").alias("weight_to_target")
            )
        ).filter(F.col("id") != F.lit(target)).groupBy("id").agg(F.max("weight_to_target").alias("weight_to_target"))
    present = sym.filter(F.col("id") == F.lit(target)).select("id").limit(1)
    all_nodes = nodes.withColumn("is_target", F.lit(False)).unionByName(
        present.select("id", F.lit(None).cast("double").alias("weight_to_target"), F.lit(True).alias("is_target"))
    )
    ids = all_nodes.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return all_nodes, e.select("src", "dst", "weight")


def ego_node_style(nodes: DataFrame, target_label: str, labels: DataFrame | None = None) -> DataFrame:
    """Target -> size 3000, orange, ``<target>\\n(<label>)`` (a literal backslash-n);
    neighbour -> size 1000 + int(weight * 5000) (truncated), blue, its own label."""
    # Fixed values of the reference's ego drawing.
    target_color, other_color = "#ff7f0e", "#1f77b4"
    x = nodes
    if labels is not None:
        x = x.join(labels.select(F.col("feature").alias("id"), F.col("token").alias("label")), "id", "left")
    else:
        x = x.withColumn("label", F.col("id").cast("string"))
    size = F.when(F.col("is_target"), F.lit(3000)).otherwise(
        F.lit(1000) + F.coalesce((F.col("weight_to_target") * 5000).cast("int"), F.lit(0))
    )
    return x.select(
        "id",
        "is_target",
        size.alias("size"),
        F.when(F.col("is_target"), F.lit(target_color)).otherwise(F.lit(other_color)).alias("color"),
        F.when(F.col("is_target"), F.concat(F.lit(target_label + "\\n("), F.col("label"), F.lit(")"))).otherwise(F.col("label")).alias("display"),
    )
