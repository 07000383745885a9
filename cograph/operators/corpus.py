"""Corpus operators: filter, order, accumulate-by-batches, balance, windows.

Row order is explicit: every ordered operator takes an order key column (``doc_id``).
A *global index* over that key is built without funnelling rows through one task:
range-partition on the key, count rows per partition, broadcast the per-partition offsets
(one row per partition) and add the local row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_KEYWORDS, keyword_match, words
from ..session import cut_lineage
from .order import Ranges, before_key

CONTEXT_WINDOW = 2048  # fixed value: the reference's context window (tokens)
ACCUMULATE_BATCH = 1000  # fixed value: rows per accumulation batch
RANDOM_SEED = 42  # fixed value: the reference's shuffle seed


def keyword_filter(df: DataFrame, keywords: Sequence[str] = DEFAULT_KEYWORDS, text: str = "text") -> DataFrame:
    """Keep rows whose lower-cased text contains any keyword; NULL text dropped."""
    return df.filter(keyword_match(text, list(keywords)))


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<string>)`` of the whole text; other columns dropped."""
    return df.select(F.col(key), words(text).alias("ids"))


def token_count(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Per-row token count column ``n_tokens``."""
    return df.withColumn("n_tokens", F.size(F.col(ids)))


def corpus_tokens(tokenized: DataFrame, ids: str = "ids") -> DataFrame:
    """A1: total tokens and rows of a corpus."""
    return tokenized.agg(
        F.coalesce(F.sum(F.size(F.col(ids))), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def mask_padding(tokens: DataFrame, pad_id, token: str = "token") -> DataFrame:
    """Drop pad positions from a long (seq, pos, token) table; genuine EOS equal to pad goes too."""
    return tokens.filter(F.col(token) != F.lit(pad_id))


def _descending(df: DataFrame, key: str):
    """A column whose ascending order is the descending order of ``key``: numbers negated, others by the complement
    of their bytes in hex, closed by a sign above all digits so that longer strings precede their prefixes."""
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return -F.col(key)
    return F.concat(F.translate(F.hex(F.col(key).cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def sample_order(df: DataFrame, strategy: str = "first", key: str = "doc_id", seed: int = RANDOM_SEED) -> DataFrame:
    """Add ``order_key`` — first: key ascending; last: descending; random: md5(key||seed)."""
    if strategy == "first":
        ok = F.struct(F.col(key).alias("k"))
    elif strategy == "last":
        ok = F.struct(_descending(df, key).alias("k"))
    elif strategy == "random":
        ok = F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))).alias("h"), F.col(key).alias("k"))
    else:
        raise ValueError(f"no sampling strategy {strategy!r}; known: first, last, random")
    return df.withColumn("order_key", ok)


def global_index(df: DataFrame, order_col: str = "order_key", name: str = "idx") -> DataFrame:
    """0-based dense position of each row in ``order_col`` order, computed in parallel.

    ``order_col`` must be unique. Rows are range-partitioned and sorted within partitions, numbered
    locally and written once; the per-partition counts (one small row each) become offsets via a
    running sum, which is broadcast back. No single task ever holds more than its own range.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, F.col(order_col)).sortWithinPartitions(order_col)
    # monotonically_increasing_id = (partition id << 33) + position within the partition:
    # the local position comes from the same stage, with no further shuffle.
    pid = F.spark_partition_id()
    # Materialised once (shared checkpoint folder): the per-partition counts and the numbered rows
    # must come from the very same range partitioning, and a lost executor must not renumber rows.
    local = cut_lineage(
        ranged.select(
            "*",
            pid.alias("_pid"),
            (F.monotonically_increasing_id() - pid.cast("bigint") * F.lit(1 << 33)).alias("_local"),
        )
    )
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    return (
        local.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded by the partition count
        .withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
        .drop("_pid", "_local", "_off")
    )


def accumulate_tokens(
    tokenized: DataFrame,
    target_tokens: int,
    batch_size: int = ACCUMULATE_BATCH,
    order_col: str = "order_key",
    ids: str = "ids",
) -> DataFrame:
    """Whole batches of ``batch_size`` rows, in order, while the running total < target.

    The batch that crosses the target is kept whole, so the result is a prefix of the order: only (order key, number of
    tokens) is dealt out by ranges, the row that reaches the target is found in its range, and the key behind
    its batch becomes a filter on the input. ``order_col`` must tell rows apart; a null array counts as no tokens.
    """
    if target_tokens <= 0:
        return tokenized.limit(0)
    ranges = Ranges(tokenized, order_col, F.greatest(F.size(F.col(ids)), F.lit(0)))
    rows = ranges.rank_reaching(int(target_tokens))
    last = None if rows is None else -(-rows // batch_size) * batch_size
    if last is None or last >= ranges.count:
        return tokenized
    return tokenized.filter(before_key(F.col(order_col), ranges.key_at(last)))


def prepare_balanced(
    anchor: DataFrame,
    other: DataFrame,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    strategy: str = "first",
    key: str = "doc_id",
    batch_size: int = ACCUMULATE_BATCH,
) -> tuple[DataFrame, DataFrame, int]:
    """Tokenise the anchor, then filter/order/accumulate the other corpus to its token count.

    Returns ``(anchor_tokens, other_tokens, target)``; the target is one scalar on the driver.
    """
    a = tokenize(anchor, key)
    target = int(corpus_tokens(a).first()["total_tokens"])
    o = sample_order(tokenize(keyword_filter(other, keywords), key), strategy, key)
    return a, accumulate_tokens(o, target, batch_size), target


def text_contexts(
    tokenized: DataFrame,
    window: int,
    key: str = "doc_id",
    ids: str = "ids",
) -> DataFrame:
    """Whole texts into bounded contexts: ``(doc_id, win, features)``, window ``win`` covering
    tokens [win*window, (win+1)*window). No token is dropped; documents of any length become
    many independent contexts (they spread across tasks instead of forming one hot group).
    """
    n_win = F.ceil(F.size(F.col(ids)) / F.lit(window)).cast("int")
    wins = F.when(n_win > 0, F.sequence(F.lit(0), n_win - 1)).otherwise(F.array().cast("array<int>"))
    return (
        tokenized.select(F.col(key), F.col(ids), F.explode(wins).alias("win"))
        .select(
            F.col(key),
            F.col("win"),
            F.array_distinct(F.slice(F.col(ids), F.col("win") * window + 1, window)).alias("features"),
        )
    )


def balance_length(n_a: DataFrame, n_b: DataFrame) -> DataFrame:
    """A10: min(N_a, N_b) of two one-row count tables (column ``n``)."""
    a = n_a.agg(F.sum("n").alias("n_a"))
    b = n_b.agg(F.sum("n").alias("n_b"))
    va, vb = a.first()[0] or 0, b.first()[0] or 0
    return n_a.sparkSession.createDataFrame([(int(va), int(vb), int(min(va, vb)))], "n_a bigint, n_b bigint, n bigint")


def truncate_contexts(contexts: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """The first ``n`` contexts in (order_cols) order, which must tell them apart: a filter by the key at place n."""
    if n <= 0:
        return contexts.limit(0)
    key = F.struct(*[F.col(c) for c in order_cols])
    ranges = Ranges(contexts.select(key.alias("key")), "key")
    return contexts if n >= ranges.count else contexts.filter(before_key(key, ranges.key_at(int(n))))
