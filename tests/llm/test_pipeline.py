"""The pipeline's last stages: the mixture's order reaches the shards."""

import random

import corpus_pipeline

from worklens.llm import mix_sources


def test_slots_follow_the_mixture(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"{i} " + "ab " * rng.randrange(2000), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    places = {}
    for name, weights in (("own", None), ("other", {"s0": 8.0, "s1": 1.0, "s2": 1.0})):
        mixing = corpus_pipeline.mixing if weights is None else lambda spark, docs, sf_dir, w=weights: mix_sources.mixed(docs, w)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", mixing), ("sharding", corpus_pipeline.sharding)])
        got = corpus_pipeline.run(spark, str(tmp_path))
        assert got.columns == ["doc_id", "text", "source", "size", "text_crc32", "shard", "slot"]
        found = got.select("doc_id", "shard", "slot").collect()
        position = {r["doc_id"]: (r["mix_slot"], r["mix_offset"]) for r in mix_sources.mixed(docs, weights).select("doc_id", "mix_slot", "mix_offset").collect()}
        for s in range(16):
            own = sorted((r["slot"], r["doc_id"]) for r in found if r["shard"] == s)
            assert [k for k, _ in own] == list(range(len(own)))
            assert [position[d] for _, d in own] == sorted(position[d] for _, d in own)
        places[name] = {r["doc_id"]: (r["shard"], r["slot"]) for r in found}
    assert len(places["own"]) == len(rows) and places["own"] != places["other"]
    assert {d: s for d, (s, _) in places["own"].items()} == {d: s for d, (s, _) in places["other"].items()}


def test_stages_against_brute_force(spark, tmp_path):
    """Planted junk, copies, near copies and benchmark passages go, the clean rest stays; nulls, empty texts, repeated rows and more columns."""
    rng = random.Random(81)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    rows, gone = [], set()

    def add(text, keep, source="s"):
        rows.append((len(rows), text, source, 1, "x"))
        if not keep:
            gone.add(len(rows) - 1)

    clean = [prose(rng.randrange(40, 150)) for _ in range(120)]
    for k, t in enumerate(clean):
        add(t, True, f"s{k % 3}")
    for _ in range(60):
        add(" | ".join(str(rng.randrange(10**6)) for _ in range(40)), False)
    for t in clean[:10]:
        add(t, False)
        w = t.split()
        w[len(w) // 2] = "other"
        add(" ".join(w), 100 * (len(w) - 4 - 5) < 75 * (len(w) - 4 + 5))
    for _ in range(5):
        add(prose(40) + " " + item.upper() + " " + prose(30), False)
    rows += [(5000, None, "s1", 1, "x"), rows[3], (None, rows[4][1], "s1", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, mix_slot string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not (120 <= i < 180)), 0) for i in range(len(rows) - 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in got if r["doc_id"] not in (None, 5000)]
    assert sorted(ids) == [i for i in range(len(rows) - 3) if i not in gone]
    assert None not in {r["doc_id"] for r in got}
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "mix_slot", "size", "text_crc32", "shard", "slot"} or "mix_slot" not in got[0].asDict()
    empty = f"{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
