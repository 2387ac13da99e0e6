"""Cases at the borders of parts, names that meet internal ones, and orders without a spread."""

import random

import pytest

import corpus_pipeline
from worklens.llm import decontaminate, jaccard_join, mix_sources, secret_scan, shard

WORDS = [f"w{i}" for i in range(300)]


@pytest.mark.parametrize("shift", range(-20, 3))
def test_short_items_at_the_border_of_a_part(shift):
    """A part of a long text that begins in mid-word doesn't make a word's rest an item; the item by itself is found wherever it stands."""
    passages = decontaminate.Passages([(1, "hidden answer z")])
    fill = ("filler words " * (decontaminate.PART // 13 + 1))[: decontaminate.PART + shift - 1]
    inner = fill + "xhidden answer z and more" + " end" * 1000
    alone = fill + " hidden answer z and more" + " end" * 1000
    behind = fill + " hidden answer zz and more" + " end" * 1000
    got = decontaminate.scan(passages, [inner, alone, behind])
    assert got == {(1, 1): (0, len(fill) + 1, len(fill) + 16)}


def test_short_items_at_the_end_of_a_part():
    passages = decontaminate.Passages([(1, "hidden answer z")])
    for at in range(decontaminate.PART + decontaminate.OVERLAP - 20, decontaminate.PART + decontaminate.OVERLAP + 3):
        fill = ("filler words " * (at // 13 + 1))[: at - 1]
        texts = [f"{fill} hidden answer z{tail}" + " end" * 1000 for tail in ("", "z", "9")]
        assert decontaminate.scan(passages, texts) == {(0, 1): (0, at, at + 15)}


CLASHING = ("near_key", "near_stays", "near_row", "filter_word", "filter_bits", "best_id", "comp", "th", "mix_in", "mix_key", "mix_bucket", "mix_before", "mix_slots", "row", "bytes", "block", "slot_", "order0", "dh", "place", "start", "stat_x", "a.b")


def test_columns_of_any_name_pass_the_stages(spark, tmp_path):
    """Documents' own columns come out as they went in, whatever they are called."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40)), f"s{i % 3}", *(f"{c}{i}" for c in CLASHING)) for i in range(60)]
    rows += [(100 + i, rows[i][1], "s0", *(f"{c}{100 + i}" for c in CLASHING)) for i in range(5)]
    names = ["doc_id", "text", "source", *CLASHING]
    docs = spark.createDataFrame(rows, names)
    kept = jaccard_join.near_duplicates_removed(docs)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == sorted(rows[:60])
    placed = mix_sources.mixed(docs)
    assert placed.columns == [*names, "mix_size", "mix_block", "mix_slot", "mix_offset"]
    assert sorted(tuple(r)[: len(names)] for r in placed.collect()) == sorted(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*names, "size", "text_crc32", "shard", "slot"]
    assert sorted(tuple(r)[: len(names)] for r in got.collect()) == sorted(rows[:60])


def test_repositories_and_owners_decide(spark):
    """One owner's value stays live when two others copied it once; a value spread evenly over three owners is an example, however few repositories."""
    own, spread = "Zx81kQm4Tt7Lw2Vb9Nc3", "Pq92mWn5Rr8Ks1Jd6Hf4"
    rows = [(i, f"use {own} here", "a") for i in range(40)] + [(50, f"use {own} here", "b"), (51, f"use {own} here", "c")]
    rows += [(60 + i, f"use {spread} here", f"o{i}") for i in range(3)]
    got = {r["doc_id"]: (r["spans"], r["n_live"], r["n_example"]) for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i] for i in (*range(40), 50, 51)} == {("owned:4:24", 1, 0)}
    assert {got[60 + i] for i in range(3)} == {("", 0, 1)}


def test_many_base_spans_and_candidates():
    """Candidates that touch a base span are left out, found by bisection as by trying all."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["password=Ab3dEf9hIj", "AKIA" + "B2C3D4E5" * 3, "deadbeef" * 4 + "Zk", "Tg5" + "k8Lm2Qw" * 4]) for _ in range(400))
    found = secret_scan.candidates(text)
    base = [(s, e) for s, k, e, _ in found if k < 3]
    assert base and not any(s < b and a < e for s, k, e, _ in found if k == 3 for a, b in base)
    more = [m.span() for m in secret_scan.OTHER.finditer(text) if secret_scan.entropy(m[0]) >= secret_scan.MIN_ENTROPY and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    assert [(s, e) for s, k, e, _ in found if k == 3] == [(s, e) for s, e in more if not any(s < b and a < e for a, b in base)]


@pytest.mark.parametrize("values", [lambda i: 7, lambda i: None, lambda i: i, lambda i: i % 2 * (1 << 60), lambda i: None if i % 3 else -i])
def test_slots_follow_any_order(spark, values):
    """Constant, null, dense and far values: slots are gapless and sorted by the order, then by key."""
    rows = [(i, f"text {i % 90}", values(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at long")
    got = shard.histogram_sort(df, n_shards=3, rows_per_bucket=10, whole_rows=True, order=("at",)).collect()
    assert len(got) == 400
    for k in range(3):
        own = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        order = [(r["at"] is not None, r["at"] or 0) for r in own]
        assert order == sorted(order)
