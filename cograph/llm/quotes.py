"""Operator 2, chat formatting by quotation linking, DataFrame functions only.

A message's lines are split into quote levels (leading ``>`` signs, blanks between them allowed). Runs of lines
of one level, broken by blank lines, are passages; a passage is normalised (lower case, runs of white space
one space, trimmed) and hashed. Level-0 passages, and their single lines, are what a message says itself; each hash
points to the first message of its conversation that says it. Quoted passages (or, where the whole is not found, their
lines) are joined to those, and a message answers the earlier message of which it quotes most at its
lowest quoted level that is found. Replies are followed to the root by pointer doubling. Messages are then ordered by root,
depth and turn: a reply comes after what it answers, and a conversation without quotes keeps its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RESULT = ["own_text", "parent_turn", "thread_turn", "depth", "formatted"]
_MARK = r"^[ \t]*(?:>[ \t]*)+"
# Fixed value: the line that introduces a quotation in common mail clients.
_INTRODUCES = r"(?i)^[ \t]*(?:on|le|am|el)\b.*(?:wrote|écrit|schrieb|escribió)[^\n]{0,60}:[ \t]*$"


def _lines(text: Column) -> Column:
    """Array of (level, line without its marks, blank) in order."""
    def parse(line: Column) -> Column:
        mark = F.regexp_extract(line, _MARK, 0)
        body = F.trim(F.regexp_replace(F.regexp_replace(line, _MARK, ""), r"\s+", " "))
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), body.alias("body"), line.alias("line"))

    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), parse)


def _passages(lines: Column) -> Column:
    """Array of (level, array of non-empty lines): runs of one level, broken by blank lines."""
    empty = F.lit(None).cast("array<struct<level:int, lines:array<string>>>")
    start = F.struct(F.coalesce(empty, F.array().cast("array<struct<level:int, lines:array<string>>>")).alias("done"), F.lit(-1).alias("level"), F.array().cast("array<string>").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        flush = F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["level"].alias("level"), acc["now"].alias("lines"))))).otherwise(acc["done"])
        blank = x["body"] == ""
        goes_on = ~blank & (x["level"] == acc["level"])
        return F.struct(
            F.when(goes_on, acc["done"]).otherwise(flush).alias("done"),
            F.when(blank, F.lit(-1)).otherwise(x["level"]).alias("level"),
            F.when(goes_on, F.concat(acc["now"], F.array(x["body"]))).when(blank, F.array().cast("array<string>")).otherwise(F.array(x["body"])).alias("now"),
        )

    ended = F.struct(F.lit(0).alias("level"), F.lit("").alias("body"), F.lit("").alias("line"))
    return F.aggregate(F.concat(lines, F.array(ended)), start, step, lambda acc: acc["done"])


def _norm(text: Column) -> Column:
    return F.xxhash64(F.lower(text))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, whole, size) of every passage, and of the lines of passages of several lines.

    Most messages quote nothing; their passages are cut by a split at blank lines, others line by line.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\r\n?", "\n")
    plain = F.filter(F.transform(F.split(text, r"\n[ \t]*(?:\n[ \t]*)+", -1), lambda p: F.struct(
        F.lit(0).alias("level"), F.filter(F.transform(F.split(p, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "").alias("lines"))), lambda p: F.size(p["lines"]) > 0)
    quotes = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    d = messages.select("conv", "turn", F.explode(F.when(quotes, _passages(_lines(F.col("text")))).otherwise(plain)).alias("p"))
    d = d.select("conv", "turn", F.monotonically_increasing_id().alias("passage"), F.col("p.level").alias("level"), F.col("p.lines").alias("lines"))
    units = F.concat(
        F.array(F.struct(F.array_join("lines", " ").alias("text"), F.lit(True).alias("whole"))),
        F.when(F.size("lines") > 1, F.transform("lines", lambda x: F.struct(x.alias("text"), F.lit(False).alias("whole")))).otherwise(F.array().cast("array<struct<text:string, whole:boolean>>")),
    )
    d = d.select("conv", "turn", "passage", "level", F.explode(units).alias("u"))
    return d.select("conv", "turn", "passage", "level", _norm(F.col("u.text")).alias("hash"), F.col("u.whole").alias("whole"), F.length("u.text").alias("size"))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent): the earlier message that each message quotes most, at its lowest level that is found."""
    found = cut_lineage(passages(messages.where("conv IS NOT NULL AND turn IS NOT NULL")))
    said = found.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("said"))
    hits = found.where("level > 0").join(said, ["conv", "hash"]).where("said < turn")
    # lines count only where the whole passage was not found
    hits = hits.withColumn("best", F.max("whole").over(Window.partitionBy("conv", "turn", "passage"))).where("whole = best")
    sums = hits.groupBy("conv", "turn", "level", "said").agg(F.sum("size").alias("size"))
    pick = sums.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "size", "said")).alias("m"))
    return pick.select("conv", "turn", F.col("m.said").alias("parent"))


def roots(found: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of every linked message, by pointer doubling (log2 of the depth rounds)."""
    d = cut_lineage(found.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = d.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        moved = cut_lineage(d.join(up, ["conv", "root"], "left"))
        if moved.where("above IS NOT NULL").limit(1).count() == 0:
            return d
        d = moved.select("conv", "turn", "parent", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``messages`` plus ``own_text`` (without quoted lines and the lines that introduce
    them), ``parent_turn``, ``thread_turn``, ``depth`` and ``formatted`` (role mark, own text, end mark).

    Reply order of a conversation: (thread_turn, depth, turn). A message whose quotes are not found, and one without
    quotes, is the root of its own thread at its place. Equal amounts of quoted text go to the latest message. Rows
    that repeat (conversation, turn) are one message of several texts and keep their rows. Null text is empty; a null
    conversation or turn links with nothing; a null role is ``user``; an empty table gives an empty result; input columns
    named like a result column are replaced.
    """
    d = messages.drop(*(set(RESULT) - {conv_col, turn_col, role_col, text_col}))
    found = links(d.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text")))
    tree = roots(found).select(F.col("conv").alias("__conv"), F.col("turn").alias("__turn"), F.col("parent").alias("parent_turn"), F.col("root").alias("thread_turn"), "depth")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.filter(_lines(F.col(text_col)), lambda x: (x["level"] == 0) & ~x["line"].rlike(_INTRODUCES))
    unquoted = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"\n(?:[ \t]*\n)+", "\n\n"))
    unquoted = F.regexp_replace(unquoted, r"^\s+|\s+$", "")
    d = d.withColumn("own_text", F.when(text.rlike(r"(?m)^[ \t]*>"), unquoted).otherwise(text))
    d = d.join(tree, (d[conv_col] == tree["__conv"]) & (d[turn_col] == tree["__turn"]), "left").drop("__conv", "__turn")
    d = d.withColumn("thread_turn", F.coalesce("thread_turn", F.col(turn_col))).withColumn("depth", F.coalesce("depth", F.lit(0)))
    return d.withColumn("formatted", F.concat(F.lit("<|"), F.coalesce(F.col(role_col), F.lit("user")), F.lit("|>\n"), "own_text", F.lit("\n<|end|>\n")))


def in_reply_order(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linked messages in ranges of (conversation, thread, depth, turn), sorted: written out, ``formatted`` reads as the conversations."""
    order = [conv_col, "thread_turn", "depth", turn_col]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
