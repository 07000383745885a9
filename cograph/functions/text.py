"""Scalar text expressions (JVM-side, whole-stage codegen friendly): P1, P2, P3, P7.

Tokenisation is re-aimed from a BPE tokenizer to a regex word splitter over the *whole* text;
the reference's context window becomes window splitting (``cograph.operators.corpus``), never
truncation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's default topic keywords.
DEFAULT_KEYWORDS = ("gun control", "abortion", "climate change", "immigration")
# Word pattern: a run of Unicode letters (Java regex / RE2 agree on it).
WORD_PATTERN = r"\p{L}+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_match(text: str | Column, keywords: Sequence[str]) -> Column:
    """P1 predicate: lower(text) contains any keyword (substring; keywords are NOT lowered).

    NULL text gives NULL, which ``filter`` drops like the reference does.
    """
    low = F.lower(_col(text))
    if not keywords:
        return F.lit(False)
    cond = None
    for k in keywords:
        c = low.contains(F.lit(k))
        cond = c if cond is None else (cond | c)
    return cond


def words(text: str | Column, pattern: str = WORD_PATTERN) -> Column:
    """Array of lower-cased words of the whole text (empty array for NULL)."""
    return F.coalesce(
        F.expr(f"regexp_extract_all(lower({_sql(text)}), '{_escape(pattern)}', 0)"),
        F.array().cast("array<string>"),
    )


def token_count(ids: str | Column) -> Column:
    """Number of tokens of a row."""
    return F.size(_col(ids))


def clean_label_newline(s: str | Column) -> Column:
    """P7 (probe CSV): newline becomes a literal backslash-n."""
    return F.replace(_col(s), F.lit("\n"), F.lit("\\n"))


# Whitespace removed by a strip (space, tab, newline, carriage return).
STRIP_CHARS = " \t\n\r"


def clean_label_strip(s: str | Column) -> Column:
    """P7 (shift table): surrounding whitespace removed."""
    return F.btrim(_col(s), F.lit(STRIP_CHARS))


def clean_label_ego(s: str | Column) -> Column:
    """P7 (ego plot): the BPE space marker removed, then stripped."""
    # Fixed value: the byte-level BPE space marker.
    return F.btrim(F.replace(_col(s), F.lit("Ġ"), F.lit("")), F.lit(STRIP_CHARS))


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name for SQL-expression helpers")


def _escape(p: str) -> str:
    return p.replace("\\", "\\\\").replace("'", "\\'")
