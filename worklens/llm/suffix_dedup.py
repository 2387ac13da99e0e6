"""Removal of every byte that a string of ``length`` bytes covers which starts at two places or more, exact.

Bucket-pointer refinement, on places chosen by the texts themselves. An initial bucket is a q-gram; every string of
``length`` bytes is filed under the smallest q-gram (by hash) that it holds, so equal strings are filed in equal buckets
at equal offsets, and neighbouring strings share one entry ("anchor"). Copies of a text are one entry with a count from
the first shuffle on. Buckets are then refined:

1. A bucket with one entry holds no repeated string and goes.
2. The rest is sorted by the identifier of all bytes that the entry stands for, from its first string's start to its last
   string's end. Entries in the same refined bucket are repeated as a whole.
3. Only where a bucket fell into several refined ones are their strings told apart; one member stands for each refined
   bucket, and what is found is passed to its members. Positions start in the buckets of their q-grams of an eighth of
   ``length`` bytes. A round sorts them by (own bucket, bucket of the place as many bytes later) and numbers the runs:
   these are the buckets of twice the width, which the next round takes up for both places. After each round strings that
   share their bucket with no other entry go, and with them the positions that only they needed.

A bucket with the bytes of up to ``TOGETHER`` of the longest entries is refined in one place. Of a larger one every string
is a row of its own, named by a hash of its bytes, and rows are counted. Hashes have 64 bits.

Entries of buckets that may hold others, members whose bytes are asked for and texts with something to remove are told
from the rest by filters, whose size follows what they hold; the few others that pass them change no result.

Defined results: null text is empty; texts of fewer than ``length`` bytes stay as they are; repeated rows are two places;
rows with a null or repeated doc_id keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import textkernel as K
from worklens.llm.common import materialise, release, table

GRAM = 32
#: Bits of a filter's block, and bits of a filter for each key: of 10,000 other keys about 6 pass.
FILTER_BITS, KEY_BITS = 1 << 16, 24
#: Blocks of a filter at most: 128 MB, for 45 million keys. More of them fill it up; then more rows are sent than needed.
MOST_BLOCKS = 1 << 14
#: Entries, of the longest kind, whose bytes are refined further in one place, and rows of whole buckets taken at once.
TOGETHER, ROWS = 4000, 1000


def _entries(data: np.ndarray, cuts: np.ndarray, length: int):
    """(rolling sums, bucket, first start, number of starts, text number, place of the q-gram) of the entries of some texts."""
    sums, n = K.rolling(data), len(data)
    starts = n - length + 1
    if starts <= 0:
        nothing = np.zeros(0, dtype=np.int64)
        return sums, nothing.view(np.uint64), nothing, nothing, nothing, nothing
    grams = (sums[GRAM:] - sums[:-GRAM]) * K.powers(n - GRAM + 1, -1)
    grams = K.mix(grams)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(cuts, np.arange(starts), side="right") - 1 if len(cuts) > 2 else np.zeros(starts, dtype=np.int64)
    whole = np.arange(starts) + length <= cuts[text + 1]
    head = whole.copy()
    head[1:] &= (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(head)
    upto = np.cumsum(whole)
    many = np.diff(np.append(upto[first] - 1, upto[-1]))
    return sums, grams[at[first]], first, many, text[first], at[first]


def _segments(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(number of the first text, bytes, cuts, offset in the text): some texts, or a part of a long one with the overlap it needs."""
    data, offsets = K.utf8(column)
    for i, j in K.groups(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > 2 * K.CHUNK:
            for a in range(0, int(offsets[j] - offsets[i]) - length + 1, K.CHUNK):
                part = data[offsets[i] + a : min(offsets[j], offsets[i] + a + K.CHUNK + length - 1)]
                yield i, part, np.array([0, len(part)]), a
        else:
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column("th"))
            for i, data, cuts, a in _segments(batch.column("text"), length):
                sums, bucket, first, many, text, _ = _entries(data, cuts, length)
                if len(first):
                    refined = K.span_hash(sums, first, first + many - 1 + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(K.signed(bucket)), pa.array(K.signed(refined)), pa.array(key[i + text]), pa.array(first - cuts[text] + a), pa.array(many.astype(np.int32))],
                        names=["bucket", "refined", "th", "start", "many"],
                    )

    return run


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (K.mix(K.mix(keys.view(np.uint64)) + np.uint64(1)) % np.uint64(blocks)).astype(np.int32)


def _places(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Four places of every key in its block."""
    mixed = K.mix(keys.view(np.uint64))
    for k in range(0, 64, 16):
        yield (mixed >> np.uint64(k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    first = _block(keys, len(bits) * 8 // FILTER_BITS).astype(np.int64) * FILTER_BITS
    out = np.ones(len(keys), dtype=bool)
    for place in _places(keys):
        out &= bits[first + place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
    return out


def _key(th: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The key of an entry."""
    return th.view(np.uint64) ^ K.mix(start.astype(np.uint64) + np.uint64(1))


def _chosen(batches: Iterator[pa.RecordBatch], length: int, bits: np.ndarray):
    """(bytes, bucket, first, many, refined) of the entries in the filter, for each part of the texts that has some.

    Of equal entries in a part only the first is sent: copies of a text hold the same chosen entry each.
    """
    for batch in batches:
        key = np.asarray(batch.column("th"))
        for i, data, cuts, a in _segments(batch.column("text"), length):
            sums, bucket, first, many, text, _ = _entries(data, cuts, length)
            k = np.flatnonzero(_inside(bits, _key(key[i + text], first - cuts[text] + a)))
            if len(k):
                refined = K.span_hash(sums, first[k], first[k] + many[k] - 1 + length)
                order = np.lexsort((refined, bucket[k]))
                new = np.ones(len(k), dtype=bool)
                new[1:] = (np.diff(refined[order]) != 0) | (np.diff(bucket[k][order]) != 0)
                one = np.sort(order[new])
                k, refined = k[one], refined[one]
                yield data, bucket[k], first[k], many[k], refined


def _bytes_of(length: int, bits: np.ndarray, large: np.ndarray):
    """bucket, part, refined, bytes of entries in the filter. A bucket is one part, 0, but entries of large ones are parts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, bucket, first, many, refined in _chosen(batches, length, bits):
            parts = [data[s : s + m - 1 + length].tobytes() for s, m in zip(first, many, strict=True)]
            own = np.where(np.isin(K.signed(bucket), large), K.signed(refined) | 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(bucket)), pa.array(own), pa.array(K.signed(refined)), pa.array(parts, pa.binary())], names=["bucket", "part", "refined", "bytes"])

    return run


def _compare(length: int):
    """Rows (bucket, part, refined, bytes) in order of bucket and part -> (refined, nth, many, string).

    Of part 0: runs of ``many`` strings that another refined bucket of the bucket holds. Of others: every string with its hash, to be compared elsewhere.
    """
    names = ["refined", "nth", "many", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            whole = batch.column("part").to_numpy() == 0
            yield from singly(pa.Table.from_batches([batch.filter(pa.array(~whole))]))
            if not whole.any():
                continue
            rows = pa.Table.from_batches([batch.filter(pa.array(whole))])
            rows = rows if held is None else pa.concat_tables([held, rows])
            bucket = rows.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            yield from compared(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from compared(held)

    def singly(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.num_rows, ROWS):
            some = rows.slice(a, ROWS)
            data, entry, nth, start = _strings(some.column("bytes").to_pylist(), length)
            string = K.span_hash(K.rolling(data), start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(some.column("refined").to_numpy()[entry]), pa.array(nth.astype(np.int32)), pa.array(np.ones(len(nth), dtype=np.int32)), pa.array(K.signed(string))], names=names)

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets, about ROWS rows at once."""
        heads = np.flatnonzero(np.append(True, np.diff(rows.column("bucket").to_numpy()) != 0)) if rows.num_rows else np.zeros(0, dtype=np.int64)
        ends, a = np.append(heads[1:], rows.num_rows), 0
        while a < rows.num_rows:
            b = int(ends[min(np.searchsorted(ends, a + ROWS), len(ends) - 1)])
            some = rows.slice(a, b - a)
            entry, nth = refined_strings(some.column("bucket").to_numpy(), some.column("bytes").to_pylist(), length)
            head = np.flatnonzero(np.append(True, (np.diff(entry) != 0) | (np.diff(nth) != 1))) if len(entry) else np.zeros(0, dtype=np.int64)
            many = np.diff(np.append(head, len(entry))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(some.column("refined").to_numpy()[entry[head]]), pa.array(nth[head].astype(np.int32)), pa.array(many), pa.nulls(len(head), pa.int64())], names=names)
            a = b

    return run


def _strings(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and entry, place in the entry and place in the bytes of every string of ``length`` bytes."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    data, offset, many = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(size) - size, size - length + 1
    entry = np.repeat(np.arange(len(parts)), many)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    return data, entry, nth, offset[entry] + nth


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0."""
    order = np.argsort(keys, kind="stable")
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(np.append(False, keys[order[1:]] != keys[order[:-1]])) if len(keys) else 0
    return out


def refined_strings(bucket: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place in the entry) of strings of ``length`` bytes that another entry of the same bucket holds; entries are different byte strings."""
    data, entry, nth, start = _strings(parts, length)
    of = _numbered(bucket)[entry]
    width = max(1, length // 8)
    sums, places = K.rolling(data), np.arange(len(data) - width + 1)
    ids = _numbered(K.span_hash(sums, places, places + width))
    while True:
        # strings whose bucket holds another entry's string stay
        run = _numbered(of << np.int64(32) | ids[start])
        low, high = np.full(len(run), len(parts)), np.full(len(run), -1)
        np.minimum.at(low, run, entry)
        np.maximum.at(high, run, entry)
        stays = low[run] != high[run]
        entry, nth, start, of = entry[stays], nth[stays], start[stays], of[stays]
        if width == length or not len(start):
            return entry, nth
        step = min(width, length - width)
        edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + length - width - step + 1, minlength=len(data) + 1)
        needed = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        wider = np.zeros(len(data), dtype=np.int64)
        wider[needed] = _numbered(ids[needed] << np.int64(32) | ids[needed + step])
        ids, width = wider, width + step


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(_key(np.asarray(batch.column("th")), np.asarray(batch.column("start")))))], names=["key"])


def _passing(column: str, bits, inside: bool = True):
    """Rows whose column the filter (a broadcast) lets through, or those that it doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(bits.value, np.asarray(batch.column(column))) == inside))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.utf8(batch.column("text"))
            runs, at = batch.column("runs"), 0
            flat, where = runs.flatten(), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
            first, many = np.asarray(flat.field("start")), np.asarray(flat.field("many"))
            out = []
            for k, n in enumerate(where):
                text = data[offsets[k] : offsets[k + 1]]
                if not n:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                a, b = first[at : at + n], first[at : at + n] + many[at : at + n] - 1 + length
                edge = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
                at += n
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), pa.int64()) for c in cols[:3]), pa.array(list(cols[3]), pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def _marked(keys: DataFrame):
    """The filter of a stored column ``key``, sent to all workers. Its blocks are filled in tasks; MOST_BLOCKS of them at most come to the driver."""
    blocks = min(MOST_BLOCKS, -(-keys.count() * KEY_BITS // FILTER_BITS) or 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_block(np.asarray(batch.column("key")), blocks)), batch.column("key")], names=["block", "key"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, key = np.asarray(batch.column("block")), np.asarray(batch.column("key"))
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                bits = made.setdefault(int(block[part[0]]), np.zeros(FILTER_BITS // 8, dtype=np.uint8))
                for place in _places(key[part]):
                    np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        for block, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros((blocks, FILTER_BITS // 8), dtype=np.uint8)
    for r in keys.mapInArrow(dealt, "block int, key long").repartition("block").mapInArrow(filled, "block int, bits binary").toLocalIterator(prefetchPartitions=True):
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.reshape(-1))


def repeated_entries(docs: DataFrame, length: int = 200) -> DataFrame:
    """(th, runs): starts of repeated strings by the text's hash, as runs (start, many) of neighbouring ones. A table of ``materialise``."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length).select("text", F.xxhash64("text").alias("th"))
    raw = materialise(texts.mapInArrow(_anchors(length), "bucket long, refined long, th long, start long, many int"), "entries")
    often = materialise(raw.groupBy("bucket").count().filter("count > 1").select(F.col("bucket").alias("key")), "shared-buckets")
    shared = raw.mapInArrow(_passing("bucket", _marked(often)), raw.schema)
    entries = materialise(shared.groupBy(*raw.columns).agg(F.count("*").alias("copies")), "shared-entries")
    release(raw, often)
    refined = entries.groupBy("bucket", "refined").agg(F.sum("copies").alias("members"), F.min(F.struct("th", "start", "many")).alias("one"))
    refined = materialise(refined, "refined")
    split = refined.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("one.many") + length - 1).alias("size")).filter("n > 1")
    split = materialise(split.select("bucket", "size"), "split-buckets")
    apart = materialise(refined.join(split, "bucket").select("one.th", "one.start").mapInArrow(_keys_of, "key long"), "apart")
    # a large bucket has over a megabyte of different entries, so few are large
    large = np.array([r[0] for r in split.filter(F.col("size") > TOGETHER * (2 * length - GRAM)).select("bucket").toLocalIterator()], dtype=np.int64)
    asked, large = _marked(apart), spark.sparkContext.broadcast(large)
    release(split, apart)

    def send_bytes(batches):
        return _bytes_of(length, asked.value, large.value)(batches)

    near = texts.mapInArrow(send_bytes, "bucket long, part long, refined long, bytes binary").repartition("bucket", "part")
    near = near.dropDuplicates(["bucket", "part", "refined"]).sortWithinPartitions("bucket", "part")  # no shuffle more: the bucket's rows are in one place
    compared = materialise(near.mapInArrow(_compare(length), "refined long, nth int, many int, string long"), "strings")
    strings = compared.filter("string is not null")
    twice = strings.groupBy("string").agg(F.min("refined").alias("low"), F.max("refined").alias("high")).filter("low <> high").select("string")
    found = compared.filter("string is null").drop("string").unionAll(strings.join(twice, "string").select("refined", "nth", "many"))
    found = found.groupBy("refined").agg(F.collect_list(F.struct("nth", "many")).alias("runs"))
    state = refined.select("refined", (F.col("members") > 1).alias("all")).join(found, "refined", "left").filter("all or runs is not null")
    own = entries.select("refined", "th", "start", "many").join(state, "refined")
    whole = F.array(F.struct(F.lit(0).alias("nth"), "many"))
    own = own.select("th", "start", F.explode(F.when(F.col("all"), whole).otherwise(F.col("runs"))).alias("run"))
    runs = own.select("th", (F.col("start") + F.col("run.nth")).alias("start"), "run.many").groupBy("th").agg(F.collect_list(F.struct("start", "many")).alias("runs"))
    runs = materialise(runs, "repeats")
    release(entries, refined, compared)
    return runs


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. Texts without a repeated string are not moved."""
    repeats = repeated_entries(docs, length)
    bits = _marked(repeats.select(F.col("th").alias("key")))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    some, none = (texts.mapInArrow(_passing("th", bits, inside), texts.schema) for inside in (True, False))
    joined = some.join(repeats.hint("shuffle_hash"), "th", "left").select("doc_id", "text", "runs")
    joined = joined.unionAll(none.select("doc_id", "text", F.lit(None).cast(repeats.schema["runs"].dataType).alias("runs")))
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document when all repeated strings of 200 bytes are removed."""
    return remove_repeats(table(spark, sf_dir, "documents"))
