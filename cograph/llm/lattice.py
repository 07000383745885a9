"""Operator 6, embedding near-dedup by E8 lattice hashing.

Equal vectors of one label become one class. Each class vector, scaled to length one, is projected by
random orthonormal rows onto ``blocks`` times eight dimensions in each of ``tables`` tables; every block is decoded to its
nearest E8 point, and the points form the home cell. The nearest neighbouring point of each block (largest
inner product of the residual with one of the 240 shortest lattice vectors) gives the cells that are probed
besides. A cell's home vectors are dealt into blocks of bounded size; each is met by the cell's homes and
visitors in a stream, and cosines in double precision verify the pairs. A pair is counted in the first table in which it meets,
so its links are counted once and never written out; what leaves a task is a count and one edge for each vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import components, ship, small

#: Home vectors compared against a stream at once, and stream rows per step.
BLOCK = 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


ROOTS = _roots()


def _checkerboard(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of even sum): round, and move the worst coordinate if the sum is odd."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by a half."""
    a, b = _checkerboard(x), _checkerboard(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float, seed: int) -> np.ndarray:
    """Cell hashes, rows x tables x 2**blocks; the first of each table is the home cell."""
    n, d = unit.shape
    out = np.zeros((n, tables, 2**blocks), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng([seed, t, d])
        basis = np.linalg.qr(rng.standard_normal((max(d, 8 * blocks), 8 * blocks)))[0][:d]
        y = unit @ basis * np.sqrt(d) * scale
        h = []
        for k in range(blocks):
            part = y[:, 8 * k : 8 * k + 8]
            home = decode(part)
            near = home + ROOTS[((part - home) @ ROOTS.T).argmax(axis=1)]
            salts = rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            h.append([((2 * p).astype(np.int64).view(np.uint64) * salts).sum(axis=1, dtype=np.uint64) for p in (home, near)])
        for i, choice in enumerate(product((0, 1), repeat=blocks)):
            key = np.full(n, np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
            for k, c in enumerate(choice):
                key = (key ^ h[k][c]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
            out[:, t, i] = key
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _with_cells(tables: int, blocks: int, scale: float, seed: int):
    @F.arrow_udf("array<bigint>")
    def keys(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            x = _matrix(vectors.take(pa.array(rows))).astype(float)
            k = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, blocks, scale, seed).reshape(len(rows), -1).view(np.int64)
            for i, r in enumerate(rows):
                out[r] = k[i]
        return pa.array(out, pa.list_(pa.int64()))

    return keys


def _roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of 0..n-1 over the edges (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _meet(tables: int, probes: int, least: float):
    """Stream of rows sorted by (cell, part, visitor): for each part, counts of links and edges."""

    def pairs(left: dict, right: dict, table: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.nonzero((left["x"] @ right["x"].T >= least) & (left["id"][:, None] < right["id"][None, :]))
        first = np.ones(len(i), bool)
        for t in range(table):  # met in an earlier table: counted there
            first &= ~(left["cells"][i, t, :] == right["cells"][j, t, :1]).any(axis=1)
        return i[first], j[first]

    def emit(right: dict, lefts: list[dict], table: int) -> Iterator[pa.RecordBatch]:
        for left in lefts:
            i, j = pairs(left, right, table)
            if not len(i):
                continue
            ids, at = np.unique(np.concatenate([left["id"][i], right["id"][j]]), return_inverse=True)
            a, b = at[: len(i)], at[len(i) :]
            n = np.bincount(a, right["copies"][j], len(ids)) + np.bincount(b, left["copies"][i], len(ids))
            yield pa.record_batch([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(ids[_roots_of(a, b, len(ids))])], names=["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, right = None, [], None
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "part", "visitor", "tbl", "id", "copies", "d")}
            group = np.stack([c["cell"], c["part"], c["d"]])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                key = tuple(group[:, a])
                if key != now:
                    now, homes, right = key, [], None
                x = _matrix(batch.column("vector").slice(a, b - a)).astype(float)
                k = _matrix(batch.column("cells").slice(a, b - a)).reshape(b - a, tables, probes)
                rows = {"id": c["id"][a:b], "copies": c["copies"][a:b].astype(float), "x": x / np.linalg.norm(x, axis=1, keepdims=True), "cells": k}
                own = c["visitor"][a:b] == 0
                if own.any():  # the part's own home vectors come first
                    homes.append({n: v[own] for n, v in rows.items()})
                if not own.all():
                    if right is None:
                        right = {n: np.concatenate([h[n] for h in homes]) for n in homes[0]} if homes else {}
                    if right:
                        others = {n: v[~own] for n, v in rows.items()}
                        steps = [{n: v[s : s + BLOCK] for n, v in others.items()} for s in range(0, len(others["id"]), BLOCK)]
                        yield from emit(right, steps, int(c["tbl"][a]))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    tables: int = 5, blocks: int = 2, scale: float = 0.36, seed: int = 8) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors link when labels are equal and not null and the cosine is at least ``least``. ``tables`` raises
    recall, ``blocks`` the number of cells (about 500 to the power ``blocks`` a table: raise it with the rows
    per label), ``scale`` divides the space (lattice units per standard deviation of a unit vector's coordinate). Null,
    zero, null-holding and non-finite vectors and null labels link with nothing; vectors of different length do
    not link; rows that repeat id and vector count as copies of each other; a null id has no links and a null component;
    other columns are not used; an empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda e: e != 0), F.lit(False))
    # a power of two moves no rounding and keeps squares finite
    peak = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda e: e / F.pow(F.lit(2.0), F.floor(F.log2(peak))))))
    classes = cut_lineage(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    probes = 2**blocks
    keyed = cut_lineage(classes.select("id", "copies", F.col("v").alias("vector"), F.size("v").alias("d"), F.col("label").cast("string").alias("label"), _with_cells(tables, blocks, scale, seed)("v").alias("cells")))
    met = keyed.select("*", F.posexplode("cells").alias("at", "c")).select(
        "id", "copies", "vector", "d", "cells", F.xxhash64("c", "label", "d").alias("cell"), F.floor(F.col("at") / probes).cast("int").alias("tbl"), (F.col("at") % probes == 0).alias("home"))
    # homes of a full cell are dealt into parts; only cells with a home and another row matter
    load = met.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    load = small(cut_lineage(load.select("cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("parts"))))
    dealt = met.join(load, "cell")
    own = dealt.where("home").select("*", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("visitor"))
    meets = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("visitor"))
    stream = own.unionByName(meets).select("cell", "part", "visitor", "tbl", "id", "copies", "d", "vector", "cells")
    stream = stream.repartition("cell", "part").sortWithinPartitions("cell", "part", "d", "visitor")
    found = cut_lineage(stream.mapInArrow(_meet(tables, probes, least), "id bigint, n bigint, other bigint"))
    edges = found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    whole = components(edges).select(F.col("node").alias("rep"), "component")
    count = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    reps = classes.select(F.col("id").alias("rep"), F.col("label").alias("rep_label"), F.col("v").alias("rep_v"), "copies").join(whole, "rep", "left").join(count, "rep", "left")
    good = rows.where("ok").join(reps, (F.col("label") == F.col("rep_label")) & (F.col("v") == F.col("rep_v"))).select(
        F.col("id").alias("vec_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where("NOT ok").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
