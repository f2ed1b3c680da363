"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is shuffled and cut into blocks of equal token count. Slot i of the schedule takes the
golden-ratio point frac(i * phi), in 32-bit integer arithmetic, and belongs to the source whose stretch of
the cumulative weights holds it, so every prefix of the schedule is close to the weights. The r-th slot of
a source takes its r-th block. The schedule ends when each block was taken at least once; a source that
runs out earlier starts again.

Ranks and running token counts are sums over small ranges of the shuffle or slot order plus the totals of
the ranges before, so no task holds a whole source, however large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, parallelism, spread, words, written

#: Tokens of a block.
BLOCK_TOKENS = 2048
#: Default weights are token shares to this power, which lifts small sources.
ALPHA = 0.9
#: Rows of a range of the shuffle order, about.
RANGE_ROWS = 20_000
#: Slots of a range of the schedule.
RANGE_SLOTS = 65_536
#: Bytes of a block's texts, about, of those that a task of mix() puts in order, and rows without tokens that one takes.
BLOCK_BYTES, TASK_BYTES, EMPTY_ROWS = 12_000, 32 << 20, 1_000_000
SEED = "mix-1"
#: Floor of 2**32 divided by the golden ratio, odd.
GOLDEN = 2654435769
_ONE = 1 << 32


def shuffle_key(source: Column, doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cumulative(tokens: dict, weights: dict | None, alpha: float) -> list[tuple]:
    """(source, first point, end) for each source with tokens, in order of its name; points are of 2**32."""
    use = {s: n for s, n in tokens.items() if n > 0}
    raw = {s: float(n) ** alpha if weights is None else float(weights.get(s, 0)) for s, n in use.items()}
    total = sum(raw[s] for s in sorted(raw, key=lambda s: (s is not None, s)))
    if not total > 0:
        return []
    out, at = [], 0.0
    for s in sorted(raw, key=lambda s: (s is not None, s)):
        low, at = at, at + raw[s]
        out.append((s, int(low / total * _ONE), min(_ONE, int(at / total * _ONE))))
    out[-1] = (out[-1][0], out[-1][1], _ONE)
    return [x for x in out if x[2] > x[1]]


def running(df: DataFrame, keys: list[str], part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the earlier rows with equal keys, ordered by part, then order."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, part]]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    joined = own.alias("a").join(sums.alias("b"), cond)
    return joined.select("a.*", (F.col("b.__before") + F.col("a.__own")).alias(name)).drop("__own")


def schedule(
    docs: DataFrame,
    weights: dict | None = None,
    block_tokens: int = BLOCK_TOKENS,
    alpha: float = ALPHA,
    seed: str = SEED,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, n_tokens, block, slot, epoch): a row for every time that a document is taken.

    A document lies in the block that holds its first token. Rows that share source and id are one
    document of their tokens together. Null is a source and an id like any other; the weight of a source
    that `weights` lacks is 0, and such a source and documents without tokens are left out. Ties in the shuffle's order go by id. A
    very long document starts in one block, and the blocks inside it are left out. An empty table gives an empty result. Other
    columns, whatever their names, are ignored.
    """
    return _schedule(docs, weights, block_tokens, alpha, seed, text, doc_id, source)[0]


def _schedule(docs, weights=None, block_tokens=BLOCK_TOKENS, alpha=ALPHA, seed=SEED, text="text", doc_id="doc_id", source="source"):
    """schedule(), the number of its slots and that of the rows without tokens."""
    spark = docs.sparkSession
    base = docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("n"))
    base = written(base, "mix-lengths")
    totals = base.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("empty")).collect()
    stretch = cumulative({r["source"]: r["n"] for r in totals}, weights, alpha)
    plan = spark.createDataFrame(
        [(s, lo, hi, -(-next(r["n"] for r in totals if r["source"] == s) // block_tokens)) for s, lo, hi in stretch],
        "source string, lo long, hi long, blocks long",
    )
    enough = max((_slots(-(-r["n"] // block_tokens), hi - lo) for s, lo, hi in stretch for r in totals if r["source"] == s), default=0)
    bits = max(0, math.ceil(math.log2(max([1, *(r["rows"] for r in totals)]) / RANGE_ROWS)))
    width = min(8, -(-bits // 4))
    units = (
        base.groupBy("source", "doc_id").agg(F.sum("n").alias("n_tokens")).where("n_tokens > 0")
        .withColumn("key", shuffle_key(F.col("source"), F.col("doc_id"), seed))
        .withColumn("part", F.substring("key", 1, width))
    )
    placed = running(units, ["source"], "part", ["key", "doc_id"], F.col("n_tokens"), "first")
    placed = placed.select("doc_id", "source", "n_tokens", F.floor(F.col("first") / block_tokens).cast("long").alias("block"))

    point = F.pmod(F.pmod(F.col("slot"), F.lit(_ONE >> 1)) * F.lit(GOLDEN), F.lit(_ONE))
    slots = spark.range(0, enough, 1, max(1, min(parallelism(spark) * 4, enough // RANGE_SLOTS + 1))).select(F.col("id").alias("slot"))
    slots = slots.withColumn("point", point).withColumn("part", F.floor(F.col("slot") / RANGE_SLOTS).cast("long"))
    slots = slots.join(F.broadcast(plan), (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).drop("point", "lo", "hi")
    ranked = written(running(slots, ["source"], "part", ["slot"], F.lit(1), "rank").drop("part"), "mix-slots")
    last = ranked.where("rank = blocks - 1").agg(F.max("slot")).first()[0]
    slots_n = 0 if last is None else last + 1
    ranked = ranked.where(F.col("slot") < slots_n).select(
        F.col("source").alias("slot_source"), "slot",
        F.pmod(F.col("rank"), F.col("blocks")).alias("slot_block"),
        F.floor(F.col("rank") / F.col("blocks")).cast("long").alias("epoch"),
    )
    joined = placed.join(ranked, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")))
    return joined.select("doc_id", "source", "n_tokens", "block", "slot", "epoch"), slots_n, sum(r["empty"] for r in totals)


def _slots(blocks: int, points: int) -> int:
    """Slots after which a stretch of so many of 2**32 points was surely hit `blocks` times."""
    return -(-(blocks + 3 + max(blocks, 2).bit_length()) * _ONE // points)


def mix(docs: DataFrame, weights: dict | None = None, **options) -> DataFrame:
    """The rows of docs in the order of schedule(), once for every time taken, with docs' own columns.

    Rows whose document has no tokens, null texts among them, come at the start, once. Rows that share source and id are
    taken together, however many and long they are. An empty table gives an empty one; columns and their names are those of docs.
    """
    spark = docs.sparkSession
    taken, slots_n, empty = _schedule(docs, weights, **options)
    names = {c: fresh(docs, f"mix_{c}") for c in ("doc_id", "source", "slot")}
    taken = taken.select(*(F.col(c).alias(n) for c, n in names.items()))
    slot = names["slot"]
    source, doc_id = options.get("source", "source"), options.get("doc_id", "doc_id")
    own = docs.withColumn(fresh(docs, "mix_words"), words(F.col(options.get("text", "text"))))
    counted = own.columns[-1]
    same = F.col(source).cast("string").eqNullSafe(F.col(names["source"])) & F.col(doc_id).cast("long").eqNullSafe(F.col(names["doc_id"]))
    joined = own.join(taken, same, "left").where(F.col(slot).isNotNull() | (F.col(counted) == 0))
    first = -(-empty // EMPTY_ROWS)  # tasks of the rows without tokens, of which there may be very many
    parts = spread(spark, slots_n * BLOCK_BYTES, TASK_BYTES)
    at = F.when(F.col(slot).isNull(), F.pmod(F.xxhash64(doc_id), F.lit(max(first, 1)))).otherwise(F.floor(F.col(slot) * parts / F.lit(max(slots_n, 1))) + first)
    return joined.repartitionById(parts + max(first, 1), at.cast("int")).sortWithinPartitions(F.col(slot).asc_nulls_first(), doc_id).select(*docs.columns)
