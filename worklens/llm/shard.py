"""Histogram sort of documents into shards of near equal bytes.

Law ``bytes``. The sort key is (hash of the text, hash of the doc_id), both 64 bits, so equal texts are neighbours.
Splitters are found by counting: bytes are summed for every value of the next ``bits`` bits of the key over all rows;
each splitter lies in one of these bins, and only the bins that hold a splitter are counted again by their next bits.
A splitter stops as soon as a bin edge lies within ``tolerance`` of its target (as a part of a shard's bytes); where one
text alone holds more, the doc_id's hash goes on. So a group of equal texts, of whatever size, lies in neighbouring
shards, and is divided only where a splitter's target falls into it. Then rows move once.

Slots inside a shard are prefix counts in two levels: buckets, then rows in a bucket. With ``order`` the buckets are ranges of
its first column, and slots follow the columns ``order``; else buckets are dealt by the doc_id's hash.

Defined results: null text has size 1 and checksum 0 and counts as the empty text; a null doc_id is a value like any other; repeated rows
keep a row each, in one shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import materialise, table

KEY_BITS = 64


def _bits(col: str, skip: int, n: int) -> Column:
    """Bits skip .. skip+n of a 64-bit key as a number (for all 64 bits, the signed key)."""
    return F.shiftrightunsigned(F.shiftleft(F.col(col), skip), KEY_BITS - n)


def _histogram(keys: DataFrame, col: str, skip: int, width: int, spots: set[tuple]) -> dict[tuple, dict[int, tuple[int, bool]]]:
    """For each spot (text or None, prefix), bytes for every value of the bits behind the prefix, and whether one key alone holds them.

    One job for all spots of a round; 2^width rows for each splitter at most come to the driver.
    """
    texts, prefixes = sorted({t for t, _ in spots if t is not None}), sorted({p for _, p in spots})
    rows = keys.filter(F.col("th").isin([_signed(t) for t in texts])) if texts else keys
    prefix = _bits(col, 0, skip) if skip else F.lit(0)
    rows = rows.filter(prefix.isin(prefixes)) if skip else rows
    group = F.col("th") if texts else F.lit(None).cast("long")
    counted = rows.groupBy(group.alias("text"), prefix.alias("prefix"), _bits(col, skip, width).alias("bin"))
    found: dict[tuple, dict[int, tuple[int, bool]]] = {s: {} for s in spots}
    for r in counted.agg(F.sum("size").alias("bytes"), (F.min(col) == F.max(col)).alias("single")).collect():
        spot = (None if r["text"] is None else r["text"] % (1 << 64), r["prefix"] % (1 << 64))
        if spot in found:
            found[spot][r["bin"] % (1 << 64)] = (r["bytes"], r["single"])
    return found


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float, bits: int = 12) -> list[tuple[int, int]]:
    """Splitters (text hash, doc hash) as unsigned numbers: a row goes behind every splitter that is at most its key.

    keys: (size, th, dh). A splitter's second part is 0 where it does not divide a group of equal texts.
    """
    total = keys.agg(F.sum("size")).first()[0]
    slack = tolerance * total / n_shards
    # of each open splitter: the bytes it still needs behind the bins that lie before it, and the bin it is in
    open_ = {k: (k * total / n_shards, "th", None, 0, 0) for k in range(1, n_shards)}
    done: dict[int, tuple[int, int]] = {}
    while open_:
        spots: dict[tuple, set[tuple]] = {}
        for _, col, text, prefix, skip in open_.values():
            spots.setdefault((col, skip), set()).add((text, prefix))
        counts = {(c, skip): _histogram(keys, c, skip, min(bits, KEY_BITS - skip), x) for (c, skip), x in spots.items()}
        for k, (need, col, text, prefix, skip) in list(open_.items()):
            width, run = min(bits, KEY_BITS - skip), 0
            for edge, (n, single) in sorted(counts[col, skip][text, prefix].items()):
                before, run = run, run + n
                if run >= need:
                    break
            low, shift = prefix << width | edge, KEY_BITS - skip - width
            near = min(need - before, run - need)
            cut = (low if need - before <= run - need else low + 1) << shift
            if near <= slack or single and col == "dh":
                done[k] = (cut, 0) if col == "th" else (text, cut)
                del open_[k]
            elif single or not shift:  # one large group of equal texts
                whole = keys.filter(_bits("th", 0, skip + width) == _signed(low)).select("th").first()[0] % (1 << 64)
                open_[k] = (need - before, "dh", whole, 0, 0)
            else:
                open_[k] = (need - before, col, text, low, skip + width)
    return [done[k] for k in sorted(done)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _at_least(splitter: tuple[int, int]) -> Column:
    """Is the row's key at or behind the splitter? Keys are unsigned; flipping the top bit makes signed order of unsigned order."""
    flip = lambda x: _signed(x ^ (1 << 63))
    flipped = lambda c: F.col(c).bitwiseXOR(F.lit(_signed(1 << 63)))
    text, doc = splitter
    if text >= 1 << 64:
        return F.lit(False)
    if doc == 0:
        return flipped("th") >= F.lit(flip(text))
    same = F.lit(False) if doc >= 1 << 64 else (flipped("th") == F.lit(flip(text))) & (flipped("dh") >= F.lit(flip(doc)))
    return (flipped("th") > F.lit(flip(text))) | same


def _bucket(keys: DataFrame, order: tuple[str, ...], n: int) -> Column:
    """A number that grows with (order, th): equal parts of the range of the first order column that has two values, else of the text's hash. Nulls come before."""
    ends = keys.agg(*[f(f"order{k}").alias(f"{end}{k}") for k in range(len(order)) for end, f in (("low", F.min), ("high", F.max))]).first()
    nulls = keys.agg(*[F.count_if(F.col(f"order{k}").isNull()).alias(f"null{k}") for k in range(len(order))]).first()
    for k in range(len(order)):
        low, high = ends[f"low{k}"], ends[f"high{k}"]
        if low is not None and low < high:
            part = F.floor((F.col(f"order{k}").cast("double") - low) / (high - low + 1) * n).cast("long")
            return F.coalesce(part, F.lit(-1))
        if low is not None and nulls[f"null{k}"]:
            return F.when(F.col(f"order{k}").isNull(), -1).otherwise(0)
    return F.floor((F.col("th") / 2.0**64 + 0.5) * n).cast("long")


def histogram_sort(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.005, rows_per_bucket: int = 20_000, whole_rows: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; with ``whole_rows`` all its columns, then size, text_crc32, shard, slot in place of columns of these names.

    Slots run through a shard's buckets, which are dealt by the doc_id's hash, and in a bucket by key; with ``order``, columns of which the
    first is a whole number, they run in its order, nulls first, then by key.
    """
    text = F.coalesce("text", F.lit(""))
    key = [
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("th"),
        F.xxhash64("doc_id", text).alias("dh"),
    ]
    key += [F.col(c).alias(f"order{k}") for k, c in enumerate(order)]
    keys = materialise(docs.select("doc_id", *key), "shard-keys")
    rows = keys.count()
    shard = F.lit(0)
    for s in find_splitters(keys, n_shards, tolerance) if rows else []:
        shard = shard + _at_least(s).cast("int")
    n_buckets = max(8, -(-rows // (n_shards * rows_per_bucket)))
    bucket = _bucket(keys, order, n_buckets) if order and rows else F.pmod("dh", F.lit(n_buckets))
    shard, bucket = shard.alias("shard"), bucket.alias("bucket")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy(shard, bucket).count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", *key) if whole_rows else keys
    dealt = carried.select("*", shard, bucket)
    within = Window.partitionBy("shard", "bucket").orderBy(*(f"order{k}" for k in range(len(order))), "th", "dh", "doc_id")
    placed = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(starts) if n_buckets <= 4096 else starts, ["shard", "bucket"])
    made = ["size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("place") - 1).cast("long").alias("slot")]
    first = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")] if whole_rows else ["doc_id"]
    return placed.select(*first, *made)


def op4_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 under the law ``bytes``."""
    return histogram_sort(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
