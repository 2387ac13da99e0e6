"""Queries whose results were only tested by their operators: sharding through the query, odd sources in the mixture."""

import random
import zlib
from collections import defaultdict

from worklens.llm import mix_sources, shard


def test_histogram_sort_query(spark, tmp_path):
    """Sizes, checksums and law of every row; equal texts side by side; shards near an equal part of the bytes, as near as the cut between two keys allows; slots gapless in order of key."""
    rng = random.Random(44)
    rows = [(i, " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(1, 60))), 7) for i in range(3000)]
    rows += [(5000, None, 7), (5001, "", 7), (None, "z", 7), rows[0], rows[0], (5002, "é" * 400, 7), (5003, "long " * 300, 7)]
    rows += [(6000 + i, "a copy of a text", 7) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    got = shard.op4_histogram_sort(spark, str(tmp_path)).collect()
    assert got[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    expected = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == expected
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    total, sums, slots, texts = sum(r["size"] for r in got), defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        texts[r["text_crc32"]].add(r["shard"])
    assert set(sums) == set(range(16))
    assert max(abs(s - total / 16) for s in sums.values()) <= 0.01 * total / 16 + 1600  # the tolerance, and the longest row at either end
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(max(s) - min(s) + 1 == len(s) for s in texts.values())  # a group is divided at shards' borders only


def test_mixture_of_odd_sources(spark):
    """Null sources only; a source of empty texts only; one row."""
    rows = [(i, None if i % 2 else "", None) for i in range(50)]
    got = mix_sources.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["mix_offset"] for r in got) == list(range(50)) and {(r["mix_size"], r["mix_block"], r["mix_slot"]) for r in got} == {(1, 0, 0)}
    both = mix_sources.mixed(spark.createDataFrame([*rows, (99, "x" * 70_000, "s"), (98, "", "e")], "doc_id long, text string, source string")).collect()
    assert len(both) == 52 and len({(r["source"], r["mix_slot"]) for r in both}) == 3
    assert len({r["mix_slot"] for r in both}) == 3  # one slot for each source's first block
