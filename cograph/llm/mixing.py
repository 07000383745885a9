"""Operator 1, mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Every source is cut into blocks of equal size. Its weight, an integer of 30 bits, gives the source's
fluid rate; block j of a source with weight w runs in the fluid schedule from virtual time (j-1)/w to
j/w. Mapped to slots (one block each), the start rounded down is the block's release and the end
rounded up its deadline. The blocks are taken earliest deadline first among the released ones; each
block then lies in its window, so no source is ever a whole block ahead of or behind its weight. A
source that has no blocks left gives its rate to the others in proportion.

Stretches of slots are scheduled apart. At the start of a stretch every source has run the whole blocks
of its fluid amount; of the blocks begun there, earliest deadline first leaves out as many late ones as
it can: those of the latest deadlines of which, for every earlier slot, no more were released before it
than blocks released before it exceed slots (the greedy basis of the matroid of schedulable sets). All
amounts are integers, exact up to 2^32 blocks. All rows are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import before, small

RESULT = ["mix_block", "mix_slot", "mix_offset"]
#: Resolution of the weights: rounding moves a source by less than n / 2^30 blocks over n blocks (of at most 2^32).
SHARES = 1 << 30
#: Slots of a stretch.
STRETCH = 128


def _shares(totals: DataFrame, weights: Mapping[str, float] | None, alpha: float, shares: int, block: int) -> DataFrame:
    """(__src, n, share): blocks and integer weight of each source."""
    if weights is None:
        weight = F.pow(F.greatest(F.col("__sum"), F.lit(1)).cast("double"), F.lit(float(alpha)))
    else:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        listed = F.lit(None).cast("double")
        for name, w in weights.items():
            listed = F.when(F.col("__src") == "=" + name, F.lit(float(w))).otherwise(listed)
        weight = F.coalesce(listed, F.lit(float(min(weights.values(), default=1.0))))
    t = totals.withColumn("w", weight)
    # one row with all sources: their number is a parameter of the mixture, not of the rows
    all_w = t.agg(F.collect_list(F.struct("__src", "__sum", "w")).alias("s"), F.sum("w").alias("all_w"))
    return all_w.select("all_w", F.explode("s").alias("s")).select(
        F.col("s.__src").alias("__src"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("s.__sum") / block)).alias("n"),
        F.greatest(F.lit(1).cast("long"), F.round(F.lit(shares) * F.col("s.w") / F.col("all_w")).cast("long")).alias("share"),
    )


def _bound(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with SQL columns that are computed once a row, also if functions over arrays use them many times."""
    return df.select("*", F.inline(F.array(F.struct(*[F.expr(e).alias(c) for c, e in columns.items()]))))


def slots(sources: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(__src, mix_block, mix_slot): the slot of every block."""
    one = sources.agg(F.sort_array(F.collect_list(F.struct("__src", "n", "share"))).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    # fluid slots used when a source of this weight has run j blocks, times the weight
    fluid = "aggregate(s, 0L, (acc, y) -> acc + least(y.n * {share}, y.share * ({j})))"
    ends = "transform(s, x -> named_struct('src', x.__src, 'n', x.n, 'share', x.share, 'end', (" + fluid.format(share="x.share", j="x.n") + " + x.share - 1) div x.share))"
    one = cut_lineage(_bound(one, ends=ends).select(F.col("ends").alias("s"), "all_n"))
    total = one.first()["all_n"]
    w = sources.sparkSession.range(-(-total // stretch)).select((F.col("id") * stretch).alias("first")).crossJoin(F.broadcast(one))
    # whole blocks of sources that ended by slot t, and the rate of the others
    amount = "named_struct('t', {t}, 'gone', aggregate(filter(s, x -> x.end <= {t}), 0L, (acc, x) -> acc + x.n), 'rate', aggregate(filter(s, x -> x.end > {t}), 0L, (acc, x) -> acc + x.share))"
    low = "if(x.end <= {a}.t, x.n, (x.share * ({a}.t - {a}.gone)) div greatest({a}.rate, 1L))"
    high = "if(x.end <= {a}.t, x.n, (x.share * ({a}.t - {a}.gone) + {a}.rate - 1) div greatest({a}.rate, 1L))"
    job = "named_struct('deadline', (" + fluid.format(share="x.share", j="{j}") + " + x.share - 1) div x.share, 'src', {i}, 'j', {j}, 'release', " + fluid.format(share="x.share", j="{j} - 1") + " div x.share)"
    w = _bound(w, last=f"least(first + {stretch}, all_n)")
    w = _bound(w, a=amount.format(t="first"), z=amount.format(t="last"))
    w = _bound(w, c=f"transform(s, (x, i) -> named_struct('src', cast(i as bigint), 'low', {low.format(a='a')}, 'high', {high.format(a='a')}, 'then', {high.format(a='z')}))")
    begun = "filter(transform(s, (x, i) -> if(c[i].high > c[i].low, " + job.format(i="cast(i as bigint)", j="(c[i].low + 1)") + ", null)), x -> x IS NOT NULL)"
    w = _bound(w, begun=f"array_sort({begun})")
    w = _bound(w, since="array_min(transform(begun, x -> x.release))")
    # blocks released before slot t beyond the t slots, from the first release of a begun block on
    over = f"aggregate(s, 0L, (acc, x) -> acc + {high.format(a='b')}) - b.t"
    w = _bound(w, over=f"if(since IS NULL, array(), transform(transform(sequence(since + 1, first), t -> {amount.format(t='t')}), b -> {over}))")
    w = _bound(w, room="transform(begun, x -> named_struct('release', x.release, 'm', array_min(slice(over, cast(x.release - since + 1 as int), size(over)))))")
    late = """
        aggregate(reverse(begun), named_struct('room', room, 'late', cast(array() as array<bigint>)),
            (acc, p) -> if(forall(acc.room, q -> q.release < p.release OR q.m > 0),
                named_struct('room', transform(acc.room, q -> named_struct('release', q.release, 'm', q.m - if(q.release < p.release, 0L, 1L))), 'late', concat(acc.late, array(p.src))),
                acc),
            acc -> acc.late)
    """
    w = _bound(w, late=late)
    w = _bound(w, c2="transform(c, x -> named_struct('done', if(array_contains(late, x.src), x.low, x.high), 'then', x.then))")
    jobs = "flatten(transform(s, (x, i) -> if(c2[i].then > c2[i].done, transform(sequence(c2[i].done + 1, c2[i].then), j -> " + job.format(i="cast(i as bigint)", j="j") + "), array())))"
    w = _bound(w, jobs=f"array_sort({jobs})")
    # earliest deadline first: at each slot the first of the sorted jobs that is released
    order = """
        aggregate(
            sequence(first, last - 1),
            named_struct('rest', jobs, 'done', cast(array() as array<struct<slot: bigint, src: bigint, j: bigint>>)),
            (acc, t) -> element_at(transform(
                array(element_at(filter(acc.rest, x -> x.release <= t), 1)),
                p -> named_struct(
                    'rest', filter(acc.rest, x -> NOT (x.src = p.src AND x.j = p.j)),
                    'done', concat(acc.done, array(named_struct('slot', t, 'src', p.src, 'j', p.j))))), 1),
            acc -> acc.done)
    """
    return w.select("s", F.explode(F.expr(order)).alias("o")).select(
        F.expr("s[cast(o.src as int)].src").alias("__src"), (F.col("o.j") - 1).alias("mix_block"), F.col("o.slot").alias("mix_slot"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.7, shares: int = SHARES, block: int = 65_536,
        size: Column | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` plus ``mix_block`` (block within its source), ``mix_slot`` (the
    block's place in the whole interleaving) and ``mix_offset`` (size before the row within its source).
    The mixed order is (mix_slot, mix_offset).

    ``weights``: source -> positive target weight; sources not listed get the smallest listed one.
    Without weights a source's weight is its size to the power ``alpha``. ``shares``: weight resolution
    (each source has at least one). ``size``: a row's size (default: code
    points of ``text``); a row lies in the block in which it starts. Within a source rows are ordered by a
    hash of the id. Null sources form a source of their own, null sizes are 0, repeated rows and ids keep their
    own places, an empty table gives an empty result, and input columns named like a result are replaced.
    """
    amount = F.coalesce(F.length("text") if size is None else size, F.lit(0)).cast("long")
    keep = [c for c in docs.columns if c not in RESULT]
    d = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("__src"),
        amount.alias("__amount"), F.col(id_col).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"),
    )
    sources = cut_lineage(_shares(d.groupBy("__src").agg(F.sum("__amount").alias("__sum")), weights, alpha, shares, block))
    plan = cut_lineage(slots(sources))
    d = before(d, ["__src"], [F.xxhash64("__id"), F.col("__id")], "mix_offset", F.col("__amount"))
    d = d.join(small(sources), "__src").withColumn("mix_block", F.least(F.floor(F.col("mix_offset") / block), F.col("n") - 1))
    d = d.select("__src", "mix_block", "mix_offset", "__row").join(small(plan), ["__src", "mix_block"])
    return d.select(*[F.col("__row").getField(c).alias(c) for c in keep], "mix_block", "mix_slot", "mix_offset")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in mixed order: ranges of the order in the output files, sorted within each."""
    m = mix(docs, **options)
    return m.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset").drop(*RESULT)
