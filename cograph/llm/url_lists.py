"""Operator 5, URL filters by a temporal list join.

Dated list entries (add or remove a rule) become validity intervals: a rule holds from its add to the next
remove. A capture asks for its url, every parent path and every parent domain; the as-of join is an equality on
(kind, key) and a range on the fetch time, so it is evaluated against exactly the entries in force when it was
fetched. Rules of one key never overlap, so a capture meets a rule at most once. A capture is identified by its whole row of
(url, fetch time), so equal captures are judged once however often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ["blocked", "rule_kind", "rule_key", "rule_since"]
#: Order in which several rules in force are named: the most specific first.
KINDS = ["url", "path", "domain"]


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), r"\.$", "")


def bare(url: Column) -> Column:
    """Host and path without scheme, query, fragment and closing slashes."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.concat(host(url), path), "/+$", "")


def keys(url: Column) -> Column:
    """(kind, key) of everything a rule can name: the bare url, its parent paths, its host and parent domains."""
    parts = lambda s, sep: F.split(s, sep, -1)
    labels, steps = parts(host(url), r"\."), parts(bare(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".").alias("key")))
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("path").alias("kind"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("key")))
    whole = F.array(F.struct(F.lit("url").alias("kind"), bare(url).alias("key")))
    return F.filter(F.concat(whole, paths, domains), lambda x: x["key"] != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, since, until) from entries (kind, key, action, dated); ``until`` is null while the rule holds.

    Repeated adds change nothing; a remove and an add of one date: the remove is the later. Entries with a null
    field, another action or an empty key are no entries. Keys are compared in lower case for domains.
    """
    e = entries.select("kind", F.when(F.col("kind") == "domain", F.lower("key")).otherwise(F.col("key")).alias("key"), F.lower("action").alias("action"), "dated")
    e = e.where("kind IS NOT NULL AND key <> '' AND dated IS NOT NULL AND action IN ('add', 'remove')").distinct()
    e = e.groupBy("kind", "key", "dated").agg(F.max("action").alias("action"))  # 'remove' > 'add'
    w = Window.partitionBy("kind", "key").orderBy("dated")
    turns = e.withColumn("before", F.lag("action").over(w)).where("before IS NULL OR before <> action")
    turns = turns.withColumn("until", F.lead("dated").over(w))
    return turns.where("action = 'add'").select("kind", "key", F.col("dated").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """All rows and columns of ``captures`` plus ``blocked, rule_kind, rule_key, rule_since`` (the most specific
    rule in force, then the longest key).

    A rule is in force from its date on, up to but not at its removal. Null or host-less urls and null times are never
    blocked; repeated rows are judged alike; empty tables give empty results or nothing blocked; input columns named like
    a result column are replaced.
    """
    d = captures.drop(*(set(RESULT) - {url_col, time_col}))
    rules = intervals(entries)
    asked = d.where(F.col(url_col).isNotNull() & F.col(time_col).isNotNull()).select(F.col(url_col).alias("__url"), F.col(time_col).alias("__time")).distinct()
    asked = asked.select("__url", "__time", F.explode(keys(F.col("__url"))).alias("k")).select("__url", "__time", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    hits = asked.join(rules, (asked["kind"] == rules["kind"]) & (asked["key"] == rules["key"]) & (asked["__time"] >= rules["since"])
                      & (rules["until"].isNull() | (asked["__time"] < rules["until"]))).select("__url", "__time", rules["kind"], rules["key"], "since")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = hits.groupBy("__url", "__time").agg(F.min(F.struct(rank.alias("rank"), (-F.length("key")).alias("size"), "key", "kind", "since")).alias("m"))
    best = best.select("__url", "__time", F.col("m.kind").alias("rule_kind"), F.col("m.key").alias("rule_key"), F.col("m.since").alias("rule_since"))
    out = d.join(best, (d[url_col] == best["__url"]) & (d[time_col] == best["__time"]), "left").drop("__url", "__time")
    return out.withColumn("blocked", F.col("rule_key").isNotNull())
