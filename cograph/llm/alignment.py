"""Operator 11, alignment of the tokens of two tokenisers by as-of merges.

Space + text is encoded by a byte-level vocabulary (side A), the text by a piece model that adds the space itself
(side B); both sides' tokens tile the same bytes. For the texts of about ``CHUNK_BYTES`` pandas merges the token tables
of the two sides as of their starts, keyed by document: each start finds the other side's token that covers it. The
union of both directions is all overlaps; overlaps with equal ends are the links, and their ends cut both sides into
groups.

Of two tokens that end together one is a suffix of the other, so the two vocabularies alone bound the id pairs that
can ever be linked (``linkable``, about half a million). Pairs are numbered in that list; a task adds up its
counts in one array of that size and hands them over in one row, Spark adds up the tasks, and the whole table
goes back to the tasks, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ship
from .packing import _byte_of, _encoder

#: Bytes of text whose tokens are merged at once (a longer text is merged alone).
CHUNK_BYTES = 1 << 20
GROUPS = "array<struct<a: array<int>, b: array<int>>>"
OVERLAPS = "array<struct<a: int, b: int>>"


@lru_cache(maxsize=2)
def _byte_level(path: str) -> list[bytes]:
    """Bytes of every id of side A."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of = _byte_of()
    words = {i: bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode() for w, i in model["model"]["vocab"].items()}
    words |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [words.get(i, b"") for i in range(max(words) + 1)]


@lru_cache(maxsize=2)
def _piece_model(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    """Bytes of every id of side B."""
    model = _piece_model(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]


@lru_cache(maxsize=2)
def linkable(path_a: str, path_b: str) -> np.ndarray:
    """All id pairs of which one's bytes end with the other's, as ``a * ids of B + b``, ascending."""
    a, b = _byte_level(path_a), _pieces(path_b)
    ids_a: dict[bytes, list[int]] = {}
    ids_b: dict[bytes, list[int]] = {}
    for ids, words in ((ids_a, a), (ids_b, b)):
        for i, w in enumerate(words):
            if w:
                ids.setdefault(w, []).append(i)
    pairs = {i * len(b) + j for w, same in ids_a.items() for k in range(len(w)) for j in ids_b.get(w[k:], ()) for i in same}
    pairs |= {i * len(b) + j for w, same in ids_b.items() for k in range(1, len(w)) for i in ids_a.get(w[k:], ()) for j in same}
    return np.array(sorted(pairs), np.int64)


def _tokens(texts: list[str | None], path_a: str, path_b: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both sides for each text; none where the bytes of a side are not those of space + text."""
    encode, model, bytes_a, bytes_b = _encoder(path_a, specials_are_text=True), _piece_model(path_b), _byte_level(path_a).__getitem__, _pieces(path_b).__getitem__
    none, out_a, out_b = np.zeros(0, np.int64), [], []
    for text in texts:
        a = b = none
        if text:
            data = (" " + text).encode()
            ids_a, ids_b = np.frombuffer(encode(" " + text), np.uint32), model.encode(text)
            if b"".join(map(bytes_a, ids_a.tolist())) == data == b"".join(map(bytes_b, ids_b)):
                a, b = ids_a.astype(np.int64), np.array(ids_b, np.int64)
        out_a.append(a)
        out_b.append(b)
    return out_a, out_b


def _side(ids: list[np.ndarray], sizes: np.ndarray, name: str) -> pd.DataFrame:
    """Tokens of all texts: number in the chunk, document, id, and bytes [start, end) counted through the chunk."""
    flat = np.concatenate(ids)
    end = np.cumsum(sizes[flat])
    doc = np.repeat(np.arange(len(ids)), list(map(len, ids)))
    return pd.DataFrame({name: np.arange(len(flat)), "doc": doc, f"{name}_id": flat, "start": end - sizes[flat], f"{name}_end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of tokens (columns of both sides) of the same document that share a byte, in order of the first byte."""
    b_in = pd.merge_asof(a, b.assign(b_start=b["start"]), on="start", by="doc")  # the token of B that covers a start of A
    a_in = pd.merge_asof(b, a.assign(a_start=a["start"]), on="start", by="doc")
    a_in = a_in[a_in["a_start"] < a_in["start"]]  # equal starts are in the first direction
    both = pd.concat([b_in.drop(columns="b_start"), a_in.drop(columns="a_start")], ignore_index=True)
    return both.sort_values("start", kind="stable", ignore_index=True).astype("int64")


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_bounds(counts).astype(np.int32)), values)


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


class _Aligner:
    """Aligns chunks of texts and adds up the links of each id pair."""

    def __init__(self, path_a: str, path_b: str, with_groups: bool):
        self.paths, self.with_groups = (path_a, path_b), with_groups
        self.pairs = linkable(path_a, path_b)
        self.sizes = [np.array(list(map(len, words)), np.int64) for words in (_byte_level(path_a), _pieces(path_b))]
        self.counts = np.zeros(len(self.pairs), np.int64)
        na, nb = map(len, self.sizes)
        self.codes = 2 * na + 2 * nb
        # what the text of the groups says for a token of A inside and at the end of its group, and of B
        self.words = [b"%d%s" % (i, mark) for n, mark in ((na, b","), (na, b"|"), (nb, b","), (nb, b";")) for i in range(n)]

    def chunk(self, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        ids = _tokens(texts, *self.paths)
        n = len(texts)
        a, b = (_side(x, size, name) for x, size, name in zip(ids, self.sizes, "ab", strict=True))
        n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in ids)
        both = overlaps(a, b)
        links = both[both["a_end"] == both["b_end"]]
        at_a, at_b = links["a"].to_numpy(), links["b"].to_numpy()
        link_doc = links["doc"].to_numpy()
        n_links = np.bincount(link_doc, minlength=n)
        # id pairs of each document with how often they are linked there
        pair = np.searchsorted(self.pairs, links["a_id"].to_numpy() * len(self.sizes[1]) + links["b_id"].to_numpy())
        seen, times = np.unique(link_doc * len(self.pairs) + pair, return_counts=True)
        owner, pair = np.divmod(seen, len(self.pairs))
        np.add.at(self.counts, pair, times)
        per_doc = np.bincount(owner, minlength=n)
        columns = [doc_ids, pa.array(n_a), pa.array(n_b), pa.array(n_links), pa.array(np.bincount(both["doc"], minlength=n)),
                   pa.array(self._digests(a, b, at_a, at_b, n_a, n_b), pa.string()), _lists(per_doc, _int32(pair)), _lists(per_doc, _int32(times))]
        if self.with_groups:
            sides = [_lists(np.diff(np.concatenate([[0], at + 1])), _int32(side[f"{name}_id"].to_numpy())) for name, side, at in (("a", a, at_a), ("b", b, at_b))]
            columns.append(_lists(n_links, pa.StructArray.from_arrays(sides, names=["a", "b"])))
            first = both["doc"].to_numpy()
            inside = [_int32(both["a"].to_numpy() - _bounds(n_a)[first]), _int32(both["b"].to_numpy() - _bounds(n_b)[first])]
            columns.append(_lists(np.bincount(first, minlength=n), pa.StructArray.from_arrays(inside, names=["a", "b"])))
        return self._batch(columns)

    def _digests(self, a, b, at_a, at_b, n_a, n_b) -> list[str]:
        """sha256 of each document's groups as text; '' without tokens."""
        group_a, group_b = np.searchsorted(at_a, a["a"]), np.searchsorted(at_b, b["b"])
        na, nb = map(len, self.sizes)
        code_a, code_b = a["a_id"].to_numpy().copy(), b["b_id"].to_numpy() + 2 * na
        code_a[at_a] += na
        code_b[at_b] += nb
        code = np.empty(len(a) + len(b), np.int64)
        code[a["a"].to_numpy() + np.concatenate([[0], at_b + 1])[group_a]] = code_a  # behind B's tokens of earlier groups
        code[b["b"].to_numpy() + (at_a + 1)[group_b]] = code_b  # behind A's tokens up to this group
        word, bounds = self.words.__getitem__, _bounds(n_a + n_b)
        out = []
        for i in range(len(n_a)):
            text = b"".join(map(word, code[bounds[i] : bounds[i + 1]].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return out

    def tally(self, kind: pa.DataType) -> pa.RecordBatch:
        """One row without a document: the pairs linked so far and how often."""
        used = np.flatnonzero(self.counts)
        one = np.array([len(used)])
        columns = [pa.nulls(1, kind), *[pa.array([None], t) for t in (pa.int64(),) * 4], pa.array([None], pa.string()), _lists(one, _int32(used)), _lists(one, pa.array(self.counts[used]))]
        return self._batch(columns + ([pa.nulls(1, t) for t in self._extra()] if self.with_groups else []), True)

    @staticmethod
    def _extra() -> list[pa.DataType]:
        ints = pa.list_(pa.int32())
        return [pa.list_(pa.struct([("a", ints), ("b", ints)])), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]

    def _batch(self, columns: list, tally: bool = False) -> pa.RecordBatch:
        columns[7] = columns[7].cast(pa.list_(pa.int64()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups_sha256", "pairs", "times", "groups", "overlaps"][: len(columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([tally] * len(columns[0]))], names=[*names, "tally"])


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if held and held + size > CHUNK_BYTES:
            yield start, i
            start = i
            held = 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256
    [, groups, overlaps]``.

    ``path_a``: a byte-level vocabulary file; ``path_b``: a piece model; every executor reads them by these paths.
    ``groups``: the ids of both sides, group by group; ``overlaps``: pairs of token numbers (from 0) that share a byte. An id
    pair's count is its links in the whole table; ``n_best``: links whose count is the highest of their B id (ties
    included); ``count_sum``: the counts of all links. ``groups_sha256``: digest of the groups as ``a1,a2|b1;a3|b2,b3``.
    Texts that are null or empty or that a side does not give back byte by byte have no tokens: zeros, '' for the digest, no
    groups. Strings of special tokens in a text are text. Rows that repeat an id are aligned and counted one by
    one, a null id stays null; other columns are not used; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = {"groups": GROUPS, "overlaps": OVERLAPS} if with_groups else {}
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups_sha256 string, pairs array<int>, times array<bigint>, " + "".join(f"{k} {v}, " for k, v in extra.items()) + "tally boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, doc_ids = None, None
        for batch in batches:
            aligner = aligner or _Aligner(path_a, path_b, with_groups)
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                yield aligner.chunk(doc_ids.slice(a, b - a), texts[a:b])
        if aligner:
            yield aligner.tally(doc_ids.type)

    # encoded once: the table is read for the counts and again for what they say of each document
    done = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema))
    counted = done.where("tally").select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("times")).toArrow()
    pairs, ids_b = linkable(path_a, path_b), len(_pieces(path_b))
    counts = np.zeros(len(pairs), np.int64)
    counts[counted["pairs"].to_numpy()] = counted["times"].to_numpy()
    highest = np.zeros(ids_b, np.int64)
    np.maximum.at(highest, pairs % ids_b, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[pairs % ids_b]))

    @F.arrow_udf("struct<n_best: bigint, count_sum: bigint>")
    def judge(pairs: pa.Array, times: pa.Array) -> pa.Array:
        counts, best = shared.value
        size, pair, n = pc.list_value_length(pairs).to_numpy(), pairs.flatten().to_numpy(), times.flatten().to_numpy()
        ends = _bounds(size)
        sums = [np.diff(_bounds(n * x[pair])[ends]) for x in (best, counts)]
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], names=["n_best", "count_sum"])

    rows = done.where("NOT tally").withColumn("judged", judge("pairs", "times"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", F.col("n_groups").alias("n_links"), "judged.n_best", "judged.count_sum", "groups_sha256", *extra)
