"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in order of the md5 of their doc_id, are cut into blocks of ``block_bytes``. With weight w the
source's block j is released at slot floor(j / w) and due before slot ceil((j + 1) / w); slots go to the released block
that is due first. Weights are taken as they are given, as exact fractions of their sum: after any number of slots a
source has its weight's share of them with less than one block of deviation, up to the slot where it runs out; slots
that no released block needs stay empty.

The driver deals out the slots, a step for every block, and writes them in chunks of ``PLANNED``; it holds one block of each
source. Offsets inside a source are prefix sums in two levels (buckets by md5, then rows in a bucket), so no source meets in
one task; each bucket carries the slots of its own blocks. Sources, one row each, come to the driver: up to
``max_sources``, beyond which the call fails. Weights that are not positive fail as well.

Defined results: null text has size 1; a null source is a source of its own; rows with null doc_id come last in their
source; a text longer than a block takes the slots of its first block; repeated rows keep a row each; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import batched
from math import floor, lcm, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import materialise, table

BLOCK_BYTES, ROWS_PER_BUCKET = 1 << 16, 2000
#: Blocks whose slots are written at once.
PLANNED = 1 << 18


def exact_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the very proportions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in parts.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in parts.values()))
    return {s: int(w * scale) for s, w in parts.items()}


def schedule(weights: Mapping[str | None, int], blocks: Mapping[str | None, int], total: int) -> Iterator[tuple[str | None, int, int]]:
    """(source, block, slot) of every block in order of the slots: earliest deadline first among the released. A weight is a part of ``total``."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    share, ends, at = [weights[s] for s in names], [blocks[s] for s in names], [0] * len(names)
    later, ready, t = [(0, n) for n in range(len(names)) if ends[n]], [], 0
    while later or ready:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            n = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(at[n] + 1) * total // share[n]), n))
        n = heapq.heappop(ready)[1]
        yield names[n], at[n], t
        at[n] += 1
        t += 1
        if at[n] < ends[n]:
            heapq.heappush(later, (at[n] * total // share[n], n))


def whole_ticks(weights: Mapping[str | None, float], ticks: int) -> dict[str | None, int]:
    """Weights as positive whole numbers that sum to ``ticks``, by largest remainder: for a schedule that repeats, not for ``mixed``."""
    names = sorted(weights, key=lambda s: (s is None, s or ""))
    total = sum(weights.values())
    exact = {s: weights[s] / total * (ticks - len(names)) for s in names}
    out = {s: 1 + floor(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: floor(exact[s]) - exact[s])[: ticks - sum(out.values())]:
        out[s] += 1
    return out


def period(shares: Mapping[str | None, int], ticks: int) -> dict[str | None, list[int]]:
    """The slot of each source's blocks in one period of a schedule that repeats."""
    slots: dict[str | None, list[int]] = {s: [] for s in shares}
    for s, _, t in schedule(shares, shares, ticks):
        slots[s].append(t)
    return slots


def _plan(spark: SparkSession, weights: Mapping[str | None, float], blocks: Mapping[str | None, int]) -> DataFrame:
    """(source, block, slot) of every block."""
    plan = spark.createDataFrame([], "source string, block long, slot long")
    whole = exact_weights(weights)
    for chunk in batched(schedule(whole, blocks, sum(whole.values())), PLANNED):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*chunk, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        plan = plan.unionAll(materialise(spark.createDataFrame(pa.table(columns, names=plan.columns)), "mix-plan"))
    return plan


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, max_sources: int = 100_000) -> DataFrame:
    """docs with mix_size, mix_block, mix_slot and mix_offset (bytes before the row in its block); (mix_slot, mix_offset) is the order of the mixture.

    Without ``weights`` a source's weight is the square root of its bytes; sources that ``weights`` does not name get the least of them.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    digest = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("~"))
    found = docs.groupBy("source").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("mix_size", "mix_block", "mix_slot", "mix_offset")]
    if weights is None:
        weights = {r["source"]: sqrt(r["bytes"]) for r in found}
    else:
        least = min(weights.values())
        weights = {r["source"]: weights.get(r["source"], least) for r in found}
    plan = _plan(spark, weights, {r["source"]: -(-r["bytes"] // block_bytes) for r in found})

    digits, n = 1, sum(r["rows"] for r in found)
    while 16**digits * ROWS_PER_BUCKET < n:
        digits += 1
    # the row travels as one column, so no name of a document's column can meet one of these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "source", "doc_id", F.xxhash64("text").alias("th"), size.alias("mix_size"), digest.alias("mix_key"), F.substring(digest, 1, digits).alias("mix_bucket"))
    before = Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("source", F.substring(digest, 1, digits).alias("mix_bucket")).agg(F.sum(size).alias("bytes"))
    starts = sums.select("source", "mix_bucket", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("mix_before"))
    of = lambda c: F.floor(c / block_bytes).cast("long")
    held = starts.withColumn("block", F.explode(F.sequence(of(F.col("mix_before")), of(F.col("mix_before") + F.col("bytes") - 1))))
    a, b = held.alias("a"), plan.alias("b")
    held = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))).select("a.*", "b.slot")
    starts = held.groupBy("source", "mix_bucket", "mix_before").agg(F.array_sort(F.collect_list("slot")).alias("mix_slots"))  # slots grow with the block
    within = Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("mix_in", F.sum("mix_size").over(within) - F.col("mix_size"))
    a, b = placed.alias("a"), starts.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.mix_bucket") == F.col("b.mix_bucket")))
    start = F.col("b.mix_before") + F.col("a.mix_in")
    slot = F.get(F.col("b.mix_slots"), (of(start) - of(F.col("b.mix_before"))).cast("int"))
    return joined.select("a.row.*", "a.mix_size", of(start).alias("mix_block"), slot.alias("mix_slot"), (start - of(start) * block_bytes).alias("mix_offset"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document's slot in the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", F.col("mix_size").alias("size"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_offset").alias("offset"))


def mixed_order(docs: DataFrame) -> DataFrame:
    """All rows and columns of documents, written in the order of the mixture."""
    return mixed(docs).orderBy("mix_slot", "mix_offset").select(*docs.columns)
