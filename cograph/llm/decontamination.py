"""Operator 12, removal of benchmark passages from training texts.

Texts become words (A-Z lower-cased). Every stretch of ``width`` consecutive words of a benchmark item is a window, a
shorter item is one window. The windows' hashes are a set that is broadcast while its measured bytes are within
``BROADCAST_BYTES`` (beyond, the same join shuffles); the words of the documents are scanned position by position
against it inside the task that reads them, and only hits, verified word by word, are shuffled. What a
document's hits cover is then joined back to the documents, or cut out of their texts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of windows (their text and 64 bytes each) up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that is not lower-cased, and what lies between them.
WORD_ANY_CASE, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _within(df: DataFrame, size: Column) -> DataFrame:
    """``df`` (a written table), to be broadcast if the sum of ``size`` over its rows is small enough."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n_words, item_id as string): distinct windows of each item; the words of a window are joined by spaces."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
    b = b.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(width)))
    b = b.select("item_id", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    return b.select(F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window"), F.col("n").alias("n_words"), "item_id").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, text): rows of equal id and text have equal hits, so that the two name the row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("digest"), F.col(text_col).cast("string").alias("text"))


def _hits(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, start, n_words, window): every place of a document where a window occurs, words counted from 0."""
    sizes = sorted(r[0] for r in known.select("n_words").distinct().collect())  # at most ``width`` numbers
    hashed = known.select(F.xxhash64(F.split("window", " ")).alias("hash"), F.col("window").alias("known"), "n_words")
    hashed = _within(hashed, F.octet_length("known") + 64)
    found = None
    for size in sizes:
        d = keyed.select("doc_id", "digest", words(F.col("text")).alias("w"))
        d = d.select("doc_id", "digest", "w", F.explode(F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size))).alias("start"))
        d = d.withColumn("hash", F.xxhash64(F.slice("w", F.col("start") + 1, size))).join(hashed.where(F.col("n_words") == size), "hash")
        d = d.select("doc_id", "digest", "start", "n_words", "known", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("window"))
        found = d if found is None else found.unionByName(d)
    if found is None:
        found = keyed.select("doc_id", "digest", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit("").alias("known"), F.lit("").alias("window")).where("false")
    # only rows that share a hash leave the scan; their words are compared afterwards, not for every position
    return cut_lineage(found).where("window = known").select("doc_id", "digest", "start", "n_words", "window").distinct()


def _spans(hits: DataFrame) -> DataFrame:
    """(doc_id, digest, spans array<struct<start, end>>): what the windows cover in each document, merged. A document has
    at most as many places as words, so a group is no larger than its text."""
    places = hits.select("doc_id", "digest", "start", (F.col("start") + F.col("n_words")).alias("end")).distinct()
    behind = Window.partitionBy("doc_id", "digest").orderBy("start", "end")
    reach = F.max("end").over(behind.rowsBetween(Window.unboundedPreceding, -1))
    d = places.withColumn("opens", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("span", F.sum("opens").over(behind))
    d = d.groupBy("doc_id", "digest", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return d.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_words, n_hit, items array<string>, spans array<struct<start, end>>``.

    A word is hit if it lies in an occurrence of a window; ``spans``: the stretches of hit words, counted from 0, end
    exclusive; ``items``: ids (as strings, sorted) of the items of which a window occurs. Null and empty texts
    have no words and no hits; items without words have no windows; equal items count once for each id; an item
    without an id marks words but is not listed. Rows that repeat an id are scanned one by one, a null id stays null; other
    columns are not used; empty tables give no rows, or rows without hits.
    """
    item = cut_lineage(windows(benchmark, width, item_col, item_text_col))
    known = cut_lineage(item.select("window", "n_words").distinct())
    keyed = _keyed(docs, id_col, text_col)
    hits = _hits(keyed, known)
    named = _within(item.select("window", "item_id").where("item_id IS NOT NULL"), F.octet_length("window") + F.octet_length("item_id") + 64)
    items = hits.select("doc_id", "digest", "window").distinct().join(named, "window").groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    row = [F.col("d.digest") == F.col("f.digest"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))]
    spans = _spans(hits).alias("d").join(items.alias("f"), row, "left").select("d.doc_id", "d.digest", "spans", "items")
    d = keyed.withColumn("n_words", F.size(words(F.col("text"))).cast("long")).alias("d").join(spans.alias("f"), row, "left").select("d.doc_id", "text", "n_words", "spans", "items")
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s.end - s.start)
    return d.select("doc_id", "text", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def remove(docs: DataFrame, benchmark: DataFrame, documents: bool = False, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` without benchmark passages: documents with a hit go (``documents``), or the hit words and what
    lies between the words of a span are cut out and one space stands for them. Other texts come back as they are."""
    d = scan(docs, benchmark, width, id_col, text_col)
    if documents:
        return d.where("n_hit = 0").select("doc_id", "text")
    # words and what lies between them in turn; word i is part 2 i, or 2 i + 1 if the text does not begin with a word
    d = d.withColumn("parts", F.when(F.col("n_hit") > 0, F.regexp_extract_all("text", F.lit(f"{WORD_ANY_CASE}|{BETWEEN}"), F.lit(0))))
    d = d.withColumn("shift", F.when(F.get("parts", F.lit(0)).rlike(f"^{WORD_ANY_CASE}$"), 0).otherwise(1))
    kept = F.filter("spans", lambda s: s.end > s.start)
    gaps = F.transform(kept, lambda s: F.struct((s.start * 2 + F.col("shift")).alias("start"), (s.end * 2 - 1 + F.col("shift")).alias("end")))
    d = d.withColumn("gaps", gaps).withColumn("after", F.concat(F.array(F.lit(0)), F.transform("gaps", lambda g: g.end)))
    # the parts from the end of one gap to the start of the next
    pieces = F.transform("after", lambda at, i: F.array_join(F.slice("parts", at + 1, F.coalesce(F.get(F.col("gaps"), i).start, F.size("parts")) - at), ""))
    return d.select("doc_id", F.when(F.col("n_hit") > 0, F.array_join(pieces, " ")).otherwise(F.col("text")).alias("text"))
