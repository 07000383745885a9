"""Operator 3, language id by interpolated Kneser-Ney character models.

Training counts, for every language, all 4-grams of all labelled training texts (letters lower-cased,
everything else one boundary sign); Spark sums the counts. Lower orders are Kneser-Ney continuation
counts of those. The model is a sorted array of hashes for each order with one row of log probabilities
(all languages side by side) and one of back-off weights, so a character costs one binary search
as a rule. A model too large for that stays in tables of the same numbers, and the grams of the texts are joined
to it. A text gets the language of the lowest cross-entropy per character. A temperature for the scores and a
threshold for rejection are fitted on one training fold with a model of the others; then that fold is counted too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold, ship, small

ORDER = 4
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd: multiplying by it is one-to-one, so hashes do not collide
_STEP = 1 << 20  # characters worked on at once


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for anything that is no letter (16-bit plane)."""
    t = np.zeros(1 << 16, np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            t[cp] = ord(low[0])
    return t


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Folded letters of a text with single boundary signs (0) between words and at both ends; astral letters share a code."""
    if not _TABLE:
        _TABLE.append(_fold_table())
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _TABLE[0][np.minimum(cp, 0xFFFF)]
    for i in np.flatnonzero(cp > 0xFFFF) if cp.size and int(cp.max()) > 0xFFFF else ():
        low[i] = 0xFFFF if chr(cp[i]).isalpha() else 0
    low = np.concatenate([np.zeros(1, np.uint16), low, np.zeros(1, np.uint16)])
    keep = low != 0
    keep[0] = True
    keep[1:] |= low[:-1] != 0
    return low[keep].astype(np.uint64)


def grams(codes: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Packed n-grams that end at each position from the second on; before the text stand boundary signs."""
    c = np.concatenate([np.zeros(n - 2, np.uint64), codes])
    out = np.zeros(len(codes) - 1, np.uint64)
    for i in range(n):
        out = out << np.uint64(16) | c[i : i + len(out)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, bool], list[np.ndarray]] = {}
        for text, lang, late in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            codes = letters(text.as_py())
            if len(codes) > 1:
                found.setdefault((lang, late), []).append(grams(codes))
        for (lang, late), parts in found.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(n * (not late))], names=["lang", "gram", "n", "early"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different 4-grams of each text with their counts."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = letters(text.as_py())
            if len(codes) > 1:
                grams_, n = np.unique(grams(codes), return_counts=True)
                yield pa.record_batch([pa.array([key] * len(grams_)), pa.array(grams_.view(np.int64)), pa.array(n)], names=["key", "gram", "c"])


@dataclass
class Model:
    """Sorted hashes, by order 1..ORDER, with log probabilities and back-off weights of every language."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    temperature: float = 1.0
    threshold: float = 0.0
    tables: dict = field(default_factory=dict)

    def log_probs(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each packed gram's last character given the others, a column per language."""
        if order == 0:
            return np.full((len(packed), len(self.langs)), self.floor, np.float32)
        mask = np.uint64((1 << 16 * order) - 1)
        gram = packed & mask
        at, hit = _find(self.keys[order - 1], gram)
        out = self.logp[order - 1][at] if len(self.keys[order - 1]) else np.zeros((len(packed), len(self.langs)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            low = self.log_probs(packed[miss], order - 1)
            at, hit = _find(self.contexts[order - 1], gram[miss] >> np.uint64(16))
            if len(self.contexts[order - 1]):
                low[hit] += self.backoff[order - 1][at[hit]]
            out[miss] = low
        return out

    def entropies(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cross-entropy per character by language, and the number of characters; None without a letter."""
        codes = letters(text or "")
        if len(codes) < 2:
            return None, 0
        total = np.zeros(len(self.langs))
        for i in range(0, len(codes) - 1, _STEP):
            part = codes[max(0, i - ORDER + 2) : i + _STEP + 1]
            packed = grams(part)[i - max(0, i - ORDER + 2) :]
            total += self.log_probs(packed).sum(axis=0, dtype=np.float64)
        return -total / (len(codes) - 1), len(codes) - 1


def _find(keys: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(gram), np.int64), np.zeros(len(gram), bool)
    h = gram * _MIX
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _lookup(keys: np.ndarray, values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Values of sorted plain ``keys`` at ``query``, 0 where absent."""
    if not len(keys):
        return np.zeros(len(query))
    at = np.minimum(np.searchsorted(keys, query), len(keys) - 1)
    return np.where(keys[at] == query, values[at], 0.0)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from the 4-gram counts (gram, n) of each language."""
    langs, sixteen = sorted(counts), np.uint64(16)
    per = []  # language -> order -> (grams, counts, contexts, context sums, back-off)
    for lang in langs:
        g, n = counts[lang]
        o = np.argsort(g)
        g, n = g[o], n[o].astype(float)
        orders = [None] * (ORDER + 1)
        for k in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, inv = np.unique(g >> sixteen, return_inverse=True)
            sums, kinds = np.bincount(inv, n), np.bincount(inv)
            orders[k] = (g, n, ctx, sums, discount * kinds / sums, discount)
            # the next lower order counts in how many different grams each shorter gram ends
            g, n = np.unique(g & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
            n = n.astype(float)
        per.append(orders)
    letters_seen = max(1, len(np.unique(np.concatenate([o[1][0] for o in per])))) if per else 1
    floor = float(np.log(1.0 / (letters_seen + 1)))
    keys, logp, contexts, backoff = [], [], [], []
    prev_g, prev_p = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
    for k in range(1, ORDER + 1):
        all_g = np.unique(np.concatenate([o[k][0] for o in per])) if per else np.zeros(0, np.uint64)
        all_c = np.unique(np.concatenate([o[k][2] for o in per])) if per else np.zeros(0, np.uint64)
        p, b = np.zeros((len(all_g), len(langs))), np.zeros((len(all_c), len(langs)))
        for i, orders in enumerate(per):
            g, n, ctx, sums, lam, discount = orders[k]
            ctx_of = all_g >> sixteen
            total, weight = _lookup(ctx, sums, ctx_of), _lookup(ctx, lam, ctx_of)
            weight = np.where(total > 0, weight, 1.0)
            if k == 1:
                low = np.full(len(all_g), np.exp(floor))
            else:
                short = all_g & np.uint64((1 << 16 * (k - 1)) - 1)
                low = np.exp(_lookup(prev_g, prev_p[:, i], short))  # every shorter gram is known
            p[:, i] = np.log(np.maximum(_lookup(g, n, all_g) - discount, 0) / np.maximum(total, 1e-300) * (total > 0) + weight * low)
            b[:, i] = np.log(np.where(_lookup(ctx, sums, all_c) > 0, _lookup(ctx, lam, all_c), 1.0))
        prev_g, prev_p = all_g, p
        for store, rows, values, table in ((keys, all_g, p, logp), (contexts, all_c, b, backoff)):
            h = rows * _MIX
            o = np.argsort(h)
            store.append(h[o])
            table.append(values[o].astype(np.float32))
    return Model(langs, keys, logp, contexts, backoff, floor)


@dataclass
class Tables:
    """The numbers of ``Model`` in written tables: by order 1..ORDER (gram, at: language number -> log probability) and
    (context, at: language number -> log of the back-off weight)."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    temperature: float = 1.0
    threshold: float = 0.0

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(key, n, h): number of characters and cross-entropies by language, of each different text in ``texts`` (key, text) that has a letter."""
        asked = texts.select("key", "text").where("text IS NOT NULL").mapInArrow(_asked, "key string, gram bigint, c bigint")
        asked = cut_lineage(asked.groupBy("key", "gram").agg(F.max("c").alias("c")))  # equal texts count once
        d, value = asked.select("gram").distinct(), f"cast({self.floor!r} as double)"
        for k in range(1, ORDER + 1):
            gram = F.col("gram").bitwiseAND(F.lit(_mask(k)))
            d = d.withColumn("g", gram).withColumn("x", F.shiftrightunsigned(gram, 16))
            d = d.join(small(self.grams[k - 1]).select(F.col("gram").alias("g"), F.col("at").alias(f"p{k}")), "g", "left")
            d = d.join(small(self.contexts[k - 1]).select(F.col("context").alias("x"), F.col("at").alias(f"b{k}")), "x", "left").drop("g", "x")
            value = f"coalesce(try_element_at(p{k}, i), coalesce(try_element_at(b{k}, i), 0D) + {value})"
        n = len(self.langs)
        d = cut_lineage(d.select("gram", F.expr(f"transform(sequence(0, {n - 1}), i -> {value})").alias("v")))
        got = asked.join(d, "gram").groupBy("key").agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * F.col("v")[i]).alias(f"h{i}") for i in range(n)])
        return got.select("key", "n", F.array(*[-F.col(f"h{i}") / F.col("n") for i in range(n)]).alias("h"))


def _mask(k: int) -> int:
    """The last ``k`` letters of a packed gram, as a signed number."""
    return (1 << 16 * k) - 1 if k < 4 else -1


def tables(counts: DataFrame) -> Tables:
    """The model of ``build`` from a table of 4-gram counts (lang, gram, n), by joins and sums; no count is left out."""
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    number = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    found, by_context = {ORDER: cut_lineage(counts.select(number[F.col("lang")].alias("l"), "gram", F.col("n").cast("long")))}, {}
    for k in range(ORDER, 0, -1):
        g = found[k]
        kinds = g.groupBy("l").agg(F.sum(F.expr("if(n = 1, 1D, 0D)")).alias("ones"), F.sum(F.expr("if(n = 2, 1D, 0D)")).alias("twos"))
        discount = kinds.select("l", F.expr("if(ones > 0 AND twos > 0, ones / (ones + 2 * twos), 0.5D)").alias("discount"))
        c = g.groupBy("l", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").cast("double").alias("sums"), F.count("*").alias("kinds"))
        by_context[k] = cut_lineage(c.join(F.broadcast(discount), "l").withColumn("weight", F.expr("discount * kinds / sums")))
        if k > 1:  # the next lower order counts in how many different grams each shorter gram ends
            found[k - 1] = cut_lineage(g.groupBy("l", F.col("gram").bitwiseAND(F.lit(_mask(k - 1))).alias("gram")).agg(F.count("*").alias("n")))
    floor = float(np.log(1.0 / (max(1, found[1].select("gram").distinct().count()) + 1)))
    model, low = Tables(langs, [], [], floor), None
    for k in range(1, ORDER + 1):
        p = found[k].withColumn("context", F.shiftrightunsigned("gram", 16)).join(small(by_context[k]), ["l", "context"])
        if low is None:
            p = p.withColumn("low", F.lit(floor))
        else:
            p = p.withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(k - 1)))).join(low.select("l", F.col("gram").alias("short"), F.col("logp").alias("low")), ["l", "short"])
        low = cut_lineage(p.select("l", "gram", F.expr("ln(greatest(n - discount, 0D) / sums + weight * exp(low))").alias("logp")))
        side = lambda d, key, v: cut_lineage(d.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("l", v))).alias("at")))
        model.grams.append(side(low, "gram", F.col("logp")))
        model.contexts.append(side(by_context[k], "context", F.ln("weight")))
    return model


def _calibrate(model: Model | Tables, scored: list[tuple[np.ndarray, int, str]], target: float) -> None:
    """Temperature by likelihood and the lowest threshold whose accepted rows reach ``target`` accuracy, from
    cross-entropies, characters and language of texts."""
    at = {lang: i for i, lang in enumerate(model.langs)}
    scored = [(h, n, at[lang]) for h, n, lang in scored if h is not None and lang in at]
    if not scored:
        return
    h, n, y = np.array([s[0] for s in scored]), np.array([s[1] for s in scored], float), np.array([s[2] for s in scored])

    def softmax(t: float) -> np.ndarray:
        z = -h * n[:, None] * t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    grid = [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0]
    model.temperature = min(grid, key=lambda t: -np.log(np.maximum(softmax(t)[np.arange(len(y)), y], 1e-12)).sum())
    p = softmax(model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    o = np.argsort(-best)
    ok = np.cumsum(right[o]) / np.arange(1, len(o) + 1) >= target
    model.threshold = float(best[o][np.flatnonzero(ok).max()]) if ok.any() else 1.0
    if ok.all():
        model.threshold = 0.0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_grams: int = 4_000_000, calibration_rows: int = 2_000, target: float = 0.995) -> Model | Tables:
    """Model from the labelled rows outside fold 0: a model of all texts of folds 2-4 is calibrated on fold 1, the
    result counts all texts of folds 1-4.

    Up to ``broadcast_grams`` 4-gram counts of all languages (and four times as many cells of grams by languages) the
    model is sent to the tasks, beyond it stays in tables; both have all counts and give equal scores but for rounding.
    ``calibration_rows`` bounds the calibration sample (rows of the smallest id hashes).
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = known.where(fold(id_col) >= 1).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), (fold(id_col) == 1).alias("late"))
    counts = rows.mapInArrow(_count, "lang string, gram bigint, n bigint, early bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("early").alias("early"))
    counts = cut_lineage(counts)
    sample = known.where(fold(id_col) == 1).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(calibration_rows)
    held = known.where(fold(id_col) == 1).join(F.broadcast(sample.distinct()), id_col, "left_semi").select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n, langs = counts.count(), counts.select("lang").distinct().count()
    if n <= broadcast_grams and counts.select("gram").distinct().count() * langs <= 4 * broadcast_grams:
        got = counts.toPandas()  # at most broadcast_grams rows

        def model_of(column: str) -> Model:
            part = got[got[column] > 0]
            return build({lang: (p["gram"].to_numpy().view(np.uint64), p[column].to_numpy()) for lang, p in part.groupby("lang")})

        early = model_of("early")
        _calibrate(early, [(*early.entropies(r["text"]), r["lang"]) for r in held.collect()], target)
        model = model_of("n")
    else:
        first = counts.where("early > 0").select("lang", "gram", F.col("early").alias("n"))
        early = Tables([], [], [], 0.0) if first.isEmpty() else tables(first)
        if early.langs:
            held = cut_lineage(held.withColumn("key", F.sha2("text", 256)))
            _calibrate(early, [(np.array(r["h"]), r["n"], r["lang"]) for r in early.entropies(held).join(held.select("key", "lang"), "key").collect()], target)
        model = tables(counts.select("lang", "gram", "n"))
    model.temperature, model.threshold = early.temperature, early.threshold
    return model


def predict(model: Model, text: Column, spark) -> Column:
    """Struct column ``lang, score, rejected, cross_entropy`` of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])

    @F.arrow_udf("struct<lang:string, score:double, rejected:boolean, cross_entropy:double>")
    def scored(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        for text in texts:
            h, n = m.entropies(text.as_py())
            if h is None or not m.langs:
                out.append({"lang": UNDETERMINED, "score": 0.0, "rejected": True, "cross_entropy": None})
                continue
            best = int(h.argmin())
            score = 1.0 / float(np.exp(np.minimum((h[best] - h) * n * m.temperature, 0)).sum())
            out.append({"lang": m.langs[best], "score": score, "rejected": score < m.threshold, "cross_entropy": float(h[best])})
        return pa.array(out, kind)

    return scored(text)


def _joined(d: DataFrame, model: Tables, text: Column) -> DataFrame:
    """``d`` with the column ``__p`` that ``predict`` gives, by joins on the text."""
    d = d.withColumn("__key", F.sha2(text, 256))
    h = model.entropies(d.select(F.col("__key").alias("key"), text.alias("text"))).withColumn("best", F.array_min("h"))
    score = f"1 / aggregate(h, 0D, (acc, x) -> acc + exp(least((best - x) * n * {model.temperature!r}D, 0D)))"
    h = h.select(F.col("key").alias("__key"), "best", F.array(*map(F.lit, model.langs))[F.array_position("h", F.col("best")).cast("int") - 1].alias("lang"), F.expr(score).alias("score"))
    p = F.struct(F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang"), F.coalesce("score", F.lit(0.0)).alias("score"),
                 F.coalesce(F.col("score") < model.threshold, F.lit(True)).alias("rejected"), F.col("best").alias("cross_entropy"))
    names = d.columns
    return d.alias("d").join(h.select("__key", p.alias("__p")), "__key", "left").select(*[f"`{c}`" for c in names if c != "__key"], F.coalesce("__p", F.struct(
        F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))).alias("__p"))


def identify(docs: DataFrame, model: Model | Tables | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``held_out, lang_pred, score, rejected, cross_entropy``.

    The prediction reads the whole text and nothing else. A text that is null or has no letter gets
    ``und`` with score 0; equal cross-entropies go to the first language by name; without any labelled
    training row all texts are ``und``. ``rejected`` marks scores under the calibrated threshold. Rows that repeat are
    predicted alike, an empty table gives an empty result, input columns named like a result are replaced.
    """
    model = model or train(docs, id_col, text_col)
    names = ["held_out", "lang_pred", "score", "rejected", "cross_entropy"]
    d = docs.drop(*(set(names) - {id_col, text_col})).withColumn("held_out", fold(id_col) == 0)
    d = _joined(d, model, F.col(text_col)) if isinstance(model, Tables) else d.withColumn("__p", predict(model, F.col(text_col), docs.sparkSession))
    for name, part in (("lang_pred", "lang"), ("score", "score"), ("rejected", "rejected"), ("cross_entropy", "cross_entropy")):
        d = d.withColumn(name, F.col(f"__p.{part}"))
    return d.drop("__p")
