"""Operator 8, packing by power-of-two decomposition.

A document of n ids becomes floor(n / max_len) full pieces and one piece for every binary digit of the
rest, longest first. Every piece fills a sequence of its own length, so no sequence crosses documents
and none needs padding; sequences of equal length form the buckets. Texts are tokenised inside tasks, a
batch at a time; only the small piece rows are shuffled, to number the sequences of each length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import before, ship

# Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same without a look ahead, which is matched twice as fast. It differs only in a run of white space before a word: the
#: run's last character goes with the word or stands alone. So texts are cut there, before that character.
PLAIN = PATTERN.replace(r"\s+(?!\S)|", "")
_RUN = re.compile(r"\s(?=\s\S)")
#: Characters on whose class all libraries agree; texts with others go to the tokenizer itself.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]")


def _byte_of() -> dict[str, int]:
    """A byte-level vocabulary writes printable bytes as themselves and the others, in order, from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str, specials_are_text: bool = False):
    """Text -> its ids as little-endian bytes, as the tokenizer's own call gives them: a special token's string in a text
    is that token, or ordinary text with ``specials_are_text``. Both libraries give the same ids from the same
    vocabulary; the one that reads it as ranks is several times as fast and takes all texts of well-known characters."""
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_are_text
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte_of, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("ranks", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})

    tokens = [] if specials_are_text else sorted(special)

    def encode(text: str) -> bytes:
        if any(token in text for token in tokens) or _OTHER.search(text):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        ids, at = array("I"), 0
        for end in [m.end() for m in _RUN.finditer(text)]:
            ids.extend(fast.encode_ordinary(text[at:end]))
            at = end
        ids.extend(fast.encode_ordinary(text[at:]))
        return ids.tobytes()

    return encode


def lengths(n: int, max_len: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids, in order."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def token_pieces(path: str, max_len: int, end_id: int, with_ids: bool):
    """Column function: text -> its pieces (start, length, ids_crc32, and ids if asked)."""
    fields = "start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    @F.arrow_udf(f"array<struct<{fields}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        encode, end, crc32 = _encoder(path), array("I", [end_id]).tobytes(), zlib.crc32
        starts, sizes, crcs, ids, bounds = array("q"), array("q"), array("q"), [], array("i", [0])
        for text in texts.to_pylist():
            data, at = (encode(text) if text else b"") + end, 0
            for n in lengths(len(data) // 4, max_len):
                part = data[4 * at : 4 * (at + n)]
                starts.append(at), sizes.append(n), crcs.append(crc32(part))
                if with_ids:
                    ids.append(part)
                at += n
            bounds.append(len(starts))
        columns = [pa.array(np.frombuffer(x, np.int64), pa.int64()) for x in (starts, sizes, crcs)]
        if with_ids:
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
        rows = pa.StructArray.from_arrays(columns, names=["start", "length", "ids_crc32", "ids"][: len(columns)])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(bounds, np.int32)), rows)

    return pieces


def pack(docs: DataFrame, tokenizer: str, max_len: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32[, ids], doc_tokens, sequence_id, offset``.

    ``tokenizer``: path of a byte-level vocabulary file that every executor can read (the string of one of its special
    tokens in a text becomes that token); ``max_len``: a power
    of two; ``end_id`` ends every document. A piece is a whole sequence (offset 0) of a power of two ids;
    ``sequence_id`` = rank within its length times the number of lengths, plus the exponent.
    ``order``: columns of ``docs`` in whose order the sequences of each length are numbered (a document's pieces stay in
    their order); without them the order is a hash of the pieces. Null and
    empty texts are the single end id; rows that repeat an id are packed one by one; a null id stays null;
    other input columns are not used; an empty table gives an empty result.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    split = token_pieces(tokenizer, max_len, end_id, with_ids)
    places = [f"__order{i}" for i in range(len(order or []))]
    d = docs.select(F.col(id_col).alias("doc_id"), split(F.col(text_col)).alias("p"), *[c.alias(p) for c, p in zip(order or [], places, strict=True)])
    d = d.select("doc_id", *places, F.explode("p").alias("p"), F.expr("element_at(p, -1).start + element_at(p, -1).length").alias("doc_tokens"))
    d = cut_lineage(d.select("doc_id", *places, "p.*", "doc_tokens"))  # tokenise once; also fixes the numbering if a task is run again
    d = before(d, ["length"], [F.col(c) for c in (*places, "doc_id", "start", "ids_crc32")], "__rank", ordered=bool(places))
    kinds = max_len.bit_length()
    exponent = F.round(F.log2(F.col("length").cast("double"))).cast("long")
    return d.withColumn("sequence_id", F.col("__rank") * kinds + exponent).withColumn("offset", F.lit(0).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "doc_tokens", "sequence_id", "offset")
