"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worklens.llm import chat_format, decontaminate, jaccard_join, mix_sources, quality_rules, secret_scan, shard, suffix_dedup, topk_search, url_filter
from worklens.llm.components import components

DOCS = "doc_id long, text string, source string, shard string, node string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(12)]
    line = prose(rng, 60)
    texts = [None, "", "  \n ", "one two", "One two", *base, *base[:4]]
    for b in base[:6]:
        for k in (3, 12, 30):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [b + "\n" + line for b in base[6:]] + [line, "ab " * 6000, "é" * 300, "é" * 300]
    out = [(i, t, f"s{i % 3}" if i % 7 else None, "x", "y") for i, t in enumerate(texts)]
    return out + [out[6], (None, base[0], "s1", "x", "y")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(sets):
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = comp[i], comp[j]
                comp = [new if x == old else x for x in comp]
    return [comp.index(x) for x in comp]


def test_jaccard(docs, empty, rows):
    sets = [shingles(r[1]) for r in rows]
    comp = components_of(sets)
    smallest = {k: min((r[0] for r, x in zip(rows, comp) if x == k and r[0] is not None), default=None) for k in comp}
    expected = Counter((r[0], len(s), smallest[k] if s else r[0]) for r, s, k in zip(rows, sets, comp))
    got = jaccard_join.similarity_classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == expected
    assert jaccard_join.similarity_classes(empty).count() == 0
    kept = jaccard_join.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter({r[0] for r, s, k in zip(rows, sets, comp) if not s or smallest[k] == r[0]})


def test_jaccard_regions_around_medians(spark):
    """A large group of near copies of two texts that share half: hardly any of its pairs may be measured one by one."""
    rng = random.Random(6)
    half = prose(rng, 60)
    texts = []
    for base in (half + " " + prose(rng, 60), half + " " + prose(rng, 60)):
        for _ in range(60):
            w = base.split()
            for _ in range(rng.randrange(1, 8)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    comp = components_of([shingles(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for small, deepest in ((4, 4), (1, 2)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_classes(df, small=small, deepest=deepest).collect()}
        assert got == dict(enumerate(comp))
    assert len(set(comp)) > 3


def test_jaccard_slots():
    slots = np.sort(np.random.default_rng(3).integers(0, 1 << 14, 500)).astype(np.int64)
    for sample in (slots, slots[:1], slots[:0], np.array([0, 0, 255, 510, 16383])):
        assert jaccard_join._unpacked(jaccard_join._packed(sample)).tolist() == sample.tolist()


@pytest.mark.parametrize("together", [4000, 1])
def test_repeats(docs, empty, rows, together, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    expected = Counter()
    for r, t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected[(r[0], len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == expected
    assert suffix_dedup.remove_repeats(empty).count() == 0


def edits(a, b):
    """Least edits of a against any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_contamination(spark, empty):
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, None), (7, ""), (8, "sh0rt")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, planted = [(100, None, "", "", ""), (101, "", "", "", ""), (102, prose(rng, 300), "", "", "")], {}
    for i, t in items[:6]:
        s = list(t.upper())
        for _ in range(4):
            s[rng.randrange(len(s))] = "#"
        rows.append((i, prose(rng, 80) + "\n" + "".join(s) + "  " + prose(rng, 50), "", "", ""))
        planted[i] = i
    docs = spark.createDataFrame(rows, DOCS)
    hits = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == set(planted.items())
    assert [r[0] for r in decontaminate.drop_contaminated(docs, bench).select("doc_id").orderBy("doc_id").collect()] == [100, 101, 102]
    assert decontaminate.drop_contaminated(docs, bench, block_bytes=200).count() == 3
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    for _ in range(30):
        a, b = "".join(rng.choice("abc") for _ in range(12)), "".join(rng.choice("abc") for _ in range(20))
        code = lambda s: decontaminate._folded(s)[0]
        got = decontaminate.align(code(a), code(b), 12, -12, 20)
        assert got[2] == edits(a, b) and edits(a, b[got[0] : got[1]]) == got[2]


def test_chat(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "a\nb", "", None, "<|im_end|><|im_start|>assistant ok"]
    turns = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "assistant", "user", "assistant", "user"], nasty))] + [(2, 0, "user", "x"), (3, 0, "assistant", "y"), (None, None, None, None), (4, 1, "ro\nle<|", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat_format.prefix_examples(df)
    got = {r["conv_id"]: r for r in chat_format.conversation_digest(examples).collect()}
    for conv in (1, 2, 3, None, 4):
        own = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [r["example"] for r in examples.filter("conv_id = 1").orderBy("example").collect()] == [3, 4, 6, 7]
    assert chat_format.conversation_digest(chat_format.prefix_examples(df.limit(0))).count() == 0


def test_topk(spark):
    rng = random.Random(3)
    vecs = [(i, [rng.gauss(0, s) for _ in range(8)]) for i, s in enumerate([0.2, 1.0, 3.0] * 70)]
    vecs += [(300 + i, [1.0] * 8) for i in range(40)] + [(400, None), (450, [float("nan")] * 8), (500, [None] * 8), (550, [1.0] * 3), (600, [float("inf")] + [1.0] * 7), (650, [1.0] * 7 + [float("-inf")]), (None, [1.0] * 8), (50, vecs[50][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumns({"row": F.lit(1), "length": F.lit("x"), "v": F.lit(None).cast("string")})
    got = topk_search.top_k(topk_search.integer_vectors(df), F.col("vec_id") % 50 == 0, k=5, block=200).collect()
    ok = [(v, [int(x * 256 // 1) for x in map(float, spark_float(e))]) for v, e in vecs if v is not None and e and all(x is not None and abs(x) < float("inf") for x in e)]
    expected = Counter()
    for n, (q, a) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), v) for m, (v, b) in enumerate(ok) if m != n and len(a) == len(b))[:5]
            expected.update((q, k, v, -s) for k, (s, v) in enumerate(best, 1))
    assert Counter(map(tuple, got)) == expected
    assert topk_search.top_k(topk_search.integer_vectors(df.limit(0)), F.lit(True)).count() == 0


def spark_float(values):
    return pa.array(values, pa.float32()).to_pylist()


def test_shards(docs, empty, rows):
    got = shard.histogram_sort(docs, n_shards=4).collect()
    text = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            t = text[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    whole = shard.histogram_sort(docs, n_shards=4, whole_rows=True)
    assert whole.count() == len(rows) and whole.columns == ["doc_id", "text", "source", "node", "size", "text_crc32", "shard", "slot"]
    assert shard.histogram_sort(empty).count() == 0


def test_shard_balance(spark):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    sizes = [r["b"] for r in shard.histogram_sort(many, n_shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.1 * min(sizes)


def test_urls(spark):
    urls = ["http://A.Com/x?y", "https://www.example.com/en/1", "https://a.example.com/en/1#t", "http://b.net/es/2", "http://b.net/de/2", None, "no scheme", "http://x.org", "http://b.net?es/"] * 3
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got[:9]] == [("a.com", "/x", "com/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/1", "example.com/en/"), ("b.net", "/es/2", "net/es/"), ("b.net", "/de/2", None), ("", "", None), ("", "", None), ("x.org", "", None), ("b.net", "", None)]
    assert [r["verdict"] for r in got[:4]] == ["allow", "allow", "block", "block"] and {r["verdict"] for r in got} == {"allow", "block"}
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secrets(spark):
    live, common = "Zx9" + "kQ7pL2mN8vB4" * 2, "Ab1" + "cD3eF5gH7jK9" * 2
    texts = [None, "", 'é token = "abcdef12" secret:short pass', "AKIA" + "B" * 16 + " AKIAB", "f" * 24 + " " + "0" * 23, "x " + live, *[f"see {common} {i}" for i in range(5)], "API_KEY=token=abcdef"]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    spans = {0: "", 1: "", 2: "assign:2:19", 3: "access:0:20", 4: "hex:0:24", 5: f"owned:2:{2 + len(live)}", 6: "", 11: "assign:0:20"}
    assert {k: got[k]["spans"] for k in spans} == spans
    assert got[2]["base_sha256"] == hashlib.sha256(b"assign:2:19").hexdigest() and (got[6]["n_example"], got[5]["n_live"]) == (1, 1)
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_mixture(docs, empty, rows):
    shares = mix_sources.whole_ticks({"a": 5.0, "b": 3.0, None: 0.01}, 100)
    slots = mix_sources.period(shares, 100)
    assert sum(shares.values()) == 100 and sorted(x for s in slots.values() for x in s) == list(range(100))
    for s, a in shares.items():
        for t in range(101):
            assert abs(sum(x < t for x in slots[s]) - a * t / 100) < 1
    got = mix_sources.mixed(docs, block_bytes=2000).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append((r["mix_block"] * 2000 + r["mix_offset"], r["mix_size"]))
    for own in by_source.values():
        at = 0
        for start, size in sorted(own):
            assert start == at
            at += size
    assert mix_sources.mixed(empty).count() == 0
    assert mix_sources.mixed_order(docs).columns == docs.columns


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 4 else " | ".join(prose(rng, 40).split()), i) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame(rows, "doc_id long, text string, stat_x long")
    kept = quality_rules.drop_low_quality(texts, labels)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4}
    assert quality_rules.drop_low_quality(docs, labels.limit(0)).count() == docs.count()
    assert quality_rules.drop_low_quality(empty, labels).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (50, 50)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30}


def test_mixture_keeps_given_weights(spark):
    weights = {"s0": 0.5, **{f"s{k}": 0.5 / 599 for k in range(1, 600)}}
    docs = spark.range(1800).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 39).alias("text"), F.when(F.col("id") < 1200, "s0").otherwise(F.concat(F.lit("s"), F.col("id") - 1200)).alias("source"))
    got = mix_sources.mixed(docs, {**weights, "absent": 3.0}, block_bytes=40).filter("source <> 's0' or mix_slot < 1200").collect()
    assert len({r["mix_slot"] for r in got}) == len(got) and {r["source"] for r in got} == set(weights)
    own = sorted((r["mix_block"], r["mix_slot"]) for r in got if r["source"] == "s0")
    assert len(own) in (599, 600, 601) and all(2 * j <= t < 2 * j + 2 for j, t in own)
    exact = mix_sources.exact_weights(weights)
    slots = {}
    for s, j, t in mix_sources.schedule(exact, dict.fromkeys(weights, 3) | {"s0": 1798}, sum(exact.values())):
        slots.setdefault(s, []).append(t)
        assert j * sum(exact.values()) // exact[s] <= t < -(-(j + 1) * sum(exact.values()) // exact[s])
    assert [len(slots[s]) for s in ("s0", "s1", "s599")] == [1798, 3, 3]
    with pytest.raises(ValueError):
        mix_sources.mixed(docs.limit(1), {"s0": 0.0})


def test_contamination_beside_dotted_capital_i(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, item), (2, "İ" + prose(rng, 30))], "item_id long, text string")
    second = bench.filter("item_id = 2").first()["text"]
    rows = [(1, item.upper()), (2, "İstanbul " + prose(rng, 40)), (3, second.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    hits = decontaminate.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in hits} == {(1, 1, 0), (3, 2, 0)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    points, at = decontaminate._folded("Aİ  ΟΔΟΣ οδος")
    assert "".join(map(chr, points)) == "ai οδοσ οδοσ" and list(at[:4]) == [0, 1, 2, 4]


@pytest.mark.parametrize("sign", [-1, 1])
def test_topk_with_one_dominant_component(sign):
    """One query at a time, so that no other one keeps a vector."""
    rng = random.Random(9)
    vectors = np.array([[sign * rng.randrange(900, 1001), *(rng.randrange(-lean, lean + 1) for _ in range(3))] for lean in (1, 300) for _ in range(150)] + [[sign * 1000, 0, 0, 0]] * 3, dtype=np.int64)
    ids = np.arange(len(vectors))
    for q in range(0, len(vectors), 5):
        best = topk_search.Best(topk_search.Block(ids[q : q + 1], vectors[q : q + 1]), 5)
        for part in np.array_split(ids, 4):
            topk_search.retrieve(best, vectors[part], part, part)
        score = vectors @ vectors[q]
        expected = sorted((-int(s), int(v)) for v, s in enumerate(score) if v != q)[:5]
        assert [(-int(s), int(v)) for s, v in zip(best.held[1], best.held[2])] == expected


@pytest.mark.parametrize("together", [4000, 1])
def test_repeats_send_copies_once(spark, together, monkeypatch):
    rng = random.Random(12)
    common = prose(rng, 60)
    copied = prose(rng, 20) + common + prose(rng, 20)
    docs = spark.createDataFrame([(i, copied) for i in range(300)] + [(1000 + i, prose(rng, 20) + common + prose(rng, 20)) for i in range(6)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    compare, written = suffix_dedup._compare, suffix_dedup.materialise

    def counted(length):
        inner = compare(length)

        def run(batches):
            batches = list(batches)
            seen = [x for b in batches for x in zip(b.column("bucket").to_pylist(), b.column("refined").to_pylist())]
            if len(seen) != len(set(seen)):
                raise ValueError("an entry was sent again")
            return inner(iter(batches))

        return run

    def once(df, name):
        out = written(df, name)
        assert name != "strings" or out.count() == out.select("refined", "nth").distinct().count()
        return out

    monkeypatch.setattr(suffix_dedup, "_compare", counted)
    monkeypatch.setattr(suffix_dedup, "materialise", once)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert all(got[i]["n_removed"] == len(copied) for i in range(300))
    assert all(len(common) <= got[1000 + i]["n_removed"] < got[1000 + i]["n_bytes"] for i in range(6))


def test_repeats_leave_the_rest_in_place(spark, monkeypatch):
    """Entries without a match and texts with nothing to remove aren't moved."""
    rng = random.Random(14)
    common = prose(rng, 60)
    rows = [(i, prose(rng, 90)) for i in range(400)] + [(1000 + i, prose(rng, 30) + common + prose(rng, 30)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sent, written = {}, suffix_dedup.materialise

    def counted(df, name):
        out = written(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialise", counted)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert sent["repeats"] == 200 and sent["entries"] > 2 * sent["shared-entries"]
    assert all(got[i]["n_removed"] == 0 for i in range(400)) and all(got[1000 + i]["n_removed"] >= len(common) for i in range(200))


def test_filter_holds_its_keys(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 30_000, dtype=np.int64)
    bits = suffix_dedup._marked(spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)).value
    assert len(bits) * 8 >= len(keys) * suffix_dedup.KEY_BITS and suffix_dedup._inside(bits, keys).all()
    assert suffix_dedup._inside(bits, rng.integers(-(1 << 63), (1 << 63) - 1, 100_000, dtype=np.int64)).sum() < 200
    assert not suffix_dedup._inside(suffix_dedup._marked(spark.createDataFrame([], "key long")).value, keys).any()


def test_secrets_copied_by_their_owner(spark):
    own, common = "Qx7" + "mN4kP9tR2wY6" * 2, "Ld5" + "sG8hJ3fK1zV0" * 2
    rows = [(i, f"use {own} now", "hot") for i in range(100)] + [(200 + i, f"see {common}", f"o{i % 3}") for i in range(6)]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((got[i]["spans"], got[i]["n_live"], got[i]["n_example"]) == (f"owned:4:{4 + len(own)}", 1, 0) for i in range(100))
    assert all((got[200 + i]["spans"], got[200 + i]["n_example"]) == ("", 1) for i in range(6))


def least_edits(passage, text):
    a, b = ("".join(map(chr, decontaminate._folded(x)[0])) for x in (passage.strip(), text))
    return edits(a, b)


def test_contamination_is_each_document_by_itself(spark, monkeypatch):
    """Against edit distances of every document and piece, for any order and neighbours of the rows; texts over one part, short items, passages over part edges."""
    rng = random.Random(21)
    items = [prose(rng, 25)[:150] for _ in range(4)]
    items.append(items[0][:75] + prose(rng, 15)[:70])  # shares grams with another
    rows = []
    for i, t in enumerate(items):
        half = len(t) // 2
        rows += [prose(rng, 10) + " " + t[:half], t[half:] + " " + prose(rng, 10)]  # an end and a beginning, to stand side by side
        rows.append(prose(rng, 170) + " " + t[:half] + " " * 700 + t[half:].upper() + prose(rng, 5))
        s = list(t)
        for _ in range(3 + 6 * (i % 2)):
            s[rng.randrange(len(s))] = "#"
        rows.append(prose(rng, 30) + "".join(s) + prose(rng, 30))
    rows += [None, "", prose(rng, 60), rows[3], rows[3]]
    short = [(50, "Q7x zz"), (51, "k9"), (52, "unseen words")]
    rows += ["say q7X  ZZ.", "xk9 k9y", "only k9", "Q7x zzz"]
    found = set()
    for r, text in enumerate(rows):
        for i, t in enumerate(items):
            budget = min(int(0.08 * len(t)), (len(t) - 8) // 8)
            if text and least_edits(t, text) <= budget:
                found.add((r, i))
    found |= {(len(rows) - 4, 50), (len(rows) - 2, 51)}
    bench = spark.createDataFrame([*enumerate(items), *short], "item_id long, text string")
    wanted = Counter(found)
    for order in range(3):
        shuffled = list(enumerate(rows)) if not order else rng.sample(list(enumerate(rows)), len(rows))
        docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(1 + 2 * order)
        got = decontaminate.contaminated(docs.coalesce(1) if not order else docs, bench).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in got) == wanted
        places = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in got}
        assert not order or places == before
        before = places
    assert decontaminate.drop_contaminated(docs, bench).count() == len(rows) - len({r for r, _ in found})
    passages = decontaminate.Passages([*enumerate(items), *short])
    whole = decontaminate.scan(passages, rows)
    assert set(whole) == found and {k: (s, e, n) for k, (n, s, e) in whole.items()} == places
    monkeypatch.setattr(decontaminate, "PART", 900)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 50)
    assert decontaminate.scan(passages, rows) == whole


def test_topk_prunes_in_clusters():
    """Vectors in tight clusters of similar lengths: most pairs are never multiplied, by both prunings, and nothing is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    vectors = np.concatenate([c / np.linalg.norm(c) * 1000 * s + rng.normal(size=(60, 24)) * 12 for c in centres for s in (1.0, 0.5)]).astype(np.int64)
    ids = np.arange(len(vectors))
    queries = ids[::30]
    best = topk_search.Best(topk_search.Block(queries, vectors[queries]), 5)
    order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    for part in np.array_split(order, 6):
        topk_search.retrieve(best, vectors[part], part, part)
    number, score, found, _ = best.held
    for k, q in enumerate(queries):
        expected = sorted((-int(s), int(v)) for v, s in enumerate(vectors @ vectors[q]) if v != q)[:5]
        assert [(-int(s), int(v)) for s, v in zip(score[number == k], found[number == k])] == expected
    assert best.by_coordinates > 0 and best.multiplied < 0.5 * best.pairs


def test_refined_strings():
    rng = random.Random(31)
    parts = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(30)})
    bucket = np.array([i % 3 for i in range(len(parts))], dtype=np.int64) * 7**20
    for length in (8, 16, 20):
        holders = {}
        for i, p in enumerate(parts):
            for k in range(len(p) - length + 1):
                holders.setdefault((i % 3, p[k : k + length]), set()).add(i)
        expected = {(i, k) for i, p in enumerate(parts) for k in range(len(p) - length + 1) if len(holders[i % 3, p[k : k + length]]) > 1}
        entry, nth = suffix_dedup.refined_strings(bucket, parts, length)
        assert set(zip(entry.tolist(), nth.tolist())) == expected
        assert (len(expected) > 0) == (length == 8) or length > 8


def test_repeats_in_texts_over_one_part(monkeypatch):
    """The same strings in the same buckets whether a text is taken whole or in overlapping parts."""
    rng = random.Random(33)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (5000, 150, 260, 2600, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(5), pa.int64())], names=["text", "th"])

    def strings():
        found = {}
        for part in suffix_dedup._anchors(200)(iter([batch])):
            for r in part.to_pylist():
                for k in range(r["many"]):
                    assert (r["th"], r["start"] + k) not in found
                    found[r["th"], r["start"] + k] = r["bucket"]
        return found

    whole = strings()
    assert set(whole) == {(i, k) for i, t in enumerate(texts) for k in range(len(t.encode()) - 199)}
    monkeypatch.setattr(suffix_dedup.K, "CHUNK", 300)
    assert strings() == whole
    chosen = suffix_dedup._chosen(iter([batch]), 200, np.full(suffix_dedup.FILTER_BITS // 8, 255, dtype=np.uint8))
    assert sum(int(many.sum()) for *_, many, _ in chosen) == len(whole)


def test_shingles_in_texts_over_one_part(monkeypatch):
    rng = random.Random(34)
    column = pa.array([prose(rng, 400), None, "one", prose(rng, 3) + "x" * 500, prose(rng, 80)])
    whole = [s.tolist() for s in jaccard_join.K.shingle_sets(column)]
    monkeypatch.setattr(jaccard_join.K, "CHUNK", 70)
    assert [s.tolist() for s in jaccard_join.K.shingle_sets(column)] == whole


def test_url_ratio(spark, monkeypatch):
    """Counts, smoothing, scores and threshold against dictionaries; long and repeated URLs, more columns."""
    monkeypatch.setattr(url_filter, "PIECE", 16)  # read while the plan is made
    rng = random.Random(41)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    urls = [f"http://{word('abcd')}.com/{word('abcdx')}" for _ in range(60)] + [f"http://{word('mnop')}.net/es/{word('mnopÄ')}" for _ in range(60)]
    urls += [f"http://{word('abcd')}.org/{word('abcdx')}?q={word('mn')}" for _ in range(30)] + [f"HTTP://{word('MNOP')}.org/{word('MNOP')}" for _ in range(30)] + ["http://a.com/" + "abcd" * 200, urls[0], urls[0], "http://", None]
    df = spark.createDataFrame([(i, u, "x", 1.0, "k") for i, u in enumerate(urls)], "page_id long, url string, text string, score double, key string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    parts = {i: (got[i]["host"], got[i]["path"]) for i in got}
    keys = {(r["host"], r["path"]): (r["out"], r["text"]) for r in spark.createDataFrame(sorted(set(parts.values())), "host string, path string").select("*", (F.pmod(F.xxhash64(F.xxhash64("host", "path")), F.lit(4)) == 0).alias("out"), F.lower(F.concat("host", "path")).alias("text")).collect()}
    label = {p: got[i]["verdict"] for i, p in parts.items() if got[i]["rule"]}
    begin, counts = "\x02" * 4, {True: Counter(), False: Counter()}
    every = set()
    for p, (out, text) in keys.items():
        padded = begin + text
        for k in range(4, len(padded)):
            every.add(padded[k])
            if p in label and not out:
                for n in range(5):
                    counts[label[p] == "allow"].update([(padded[k - n : k], padded[k]), (padded[k - n : k], None)])

    def probability(side, context, char):
        c = counts[side]
        p = (c["", char] + 1) / (c["", None] + len(every))
        for n in range(1, 5):
            p = (c[context[4 - n :], char] + 4 * p) / (c[context[4 - n :], None] + 4)
        return p

    score = {}
    for p, (_, text) in keys.items():
        padded = begin + text
        llr = [math.log(probability(True, padded[k - 4 : k], padded[k]) / probability(False, padded[k - 4 : k], padded[k])) for k in range(4, len(padded))]
        score[p] = sum(llr) / len(llr) if llr else 0.0
    held = [(math.floor(score[p] * 100) / 100, label[p] == "allow") for p, (out, text) in keys.items() if out and p in label]
    ups, downs = sum(x for _, x in held), sum(not x for _, x in held)
    halfway = lambda t: (t + max([s for s, _ in held if s < t], default=t)) / 2
    threshold = max((sum(x and s >= t for s, x in held) / ups + sum(not x and s < t for s, x in held) / downs, halfway(t)) for t, _ in held)[1]
    for i, p in parts.items():
        assert abs(got[i]["score"] - score[p]) < 1e-5
        assert got[i]["verdict"] == label.get(p, "allow" if score[p] >= threshold else "block")
    free = [got[i]["verdict"] for i in range(120, 180)]
    assert free[:30].count("allow") > 25 and free[30:].count("block") > 25
    one_sided = url_filter.url_filter(df.filter("page_id < 60 or page_id >= 120")).collect()
    assert {r["verdict"] for r in one_sided} == {"allow"}


def test_secrets_query(spark, tmp_path):
    """The query against patterns written out again, and ownership counted by hand; repeated rows, null owners, a long text."""
    rng = random.Random(51)
    token = lambda n, letters="abcdefXYZ0123456789": "".join(rng.choice(letters) for _ in range(n))
    shared = [token(24) + "7a" for _ in range(6)]
    make = [
        lambda: f"{rng.choice(['Password', 'api_key', 'APIKEY', 'secret', 'tokens', 'passwd'])}{rng.choice([chr(34), '', chr(39)])}{rng.choice(['=', ' : ', ' '])}{token(rng.randrange(3, 12))}",
        lambda: "AKIA" + token(rng.randrange(10, 24), "ABCDEF0123"), lambda: token(rng.randrange(18, 30), "0123456789abcdef"), lambda: rng.choice(shared), lambda: "é" * 3 + token(22), lambda: prose(rng, 4),
    ]
    texts = [" ".join(rng.choice(make)() for _ in range(rng.randrange(1, 9))) for _ in range(120)] + [None, "", prose(rng, 9000) + " token=abcdefgh " + prose(rng, 9000)]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 4}", "x") for i, t in enumerate(texts)]
    rows += rows[:5]
    spark.createDataFrame(rows, "doc_id long, text string, source string, owner string").write.parquet(f"{tmp_path}/documents.parquet")
    assign = re.compile("(?a)([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans, owners = [], {}
    for _, text, owner, _ in rows:
        text = text or ""
        own = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        own += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        own += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        taken = [x for s, _, e, _ in own for x in range(s, e)]
        for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
            h = -sum(v / len(m[0]) * math.log2(v / len(m[0])) for v in Counter(m[0]).values())
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and h >= 3.0 and not set(range(m.start(), m.end())) & set(taken):
                own.append((m.start(), 3, m.end(), m[0]))
        spans.append(sorted(own))
        for *_, value in own:
            owners.setdefault(value, set()).add(owner)
    name = lambda x: ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{s}:{e}" for s, k, e, _ in x)
    expected = Counter()
    for (doc, *_), own in zip(rows, spans):
        base = [x for x in own if x[1] < 3]
        shown = [x for x in own if x[1] < 3 or len(owners[x[3]]) <= 2]
        expected[(doc, *(sum(x[1] == k for x in own) for k in range(3)), hashlib.sha256(name(base).encode()).hexdigest(), name(shown))] += 1
    got = secret_scan.op6_secret_scan(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert Counter(map(tuple, got.collect())) == expected
    assert any("owned" in e[5] for e in expected) and any(x[1] == 3 and len(owners[x[3]]) > 2 for own in spans for x in own)


@pytest.mark.parametrize("n", [2, 100, 1000])
def test_schedule_stays_within_a_block_of_given_weights(n):
    from fractions import Fraction

    rng = random.Random(n)
    weights = {f"s{k}": rng.choice([1 / 3, 0.1, rng.random() + 0.01]) * (50 if not k else 1) for k in range(n)}
    whole = mix_sources.exact_weights(weights)
    total = sum(map(Fraction, weights.values()))
    slots = 4 * n + 500
    taken = [s for s, _, t in mix_sources.schedule(whole, dict.fromkeys(weights, slots), sum(whole.values())) if t < slots][:slots] if n < 1000 else None
    if taken is None:
        taken, plan = [], mix_sources.schedule(whole, dict.fromkeys(weights, slots), sum(whole.values()))
        while len(taken) < slots:
            taken.append(next(plan)[0])
    count = Counter()
    for t, s in enumerate(taken, 1):
        count[s] += 1
        assert abs(count[s] - Fraction(weights[s]) / total * t) < 1
    assert all(abs(count[s] - Fraction(w) / total * slots) < 1 for s, w in weights.items())


def test_mixture_query(spark, tmp_path):
    """Blocks, offsets and slots of the query, worked out row by row; null and hot sources, a text over a block, repeated rows."""
    rng = random.Random(61)
    rows = [(i, prose(rng, rng.randrange(1, 900)), "hot" if i % 3 else rng.choice(["a", "b", None]), 7) for i in range(300)]
    rows += [(1000, "x" * 200_000, "a", 7), (1001, None, "b", 7), (None, "z", "b", 7), rows[0], rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot int").write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda t: len((t or "").encode()) + 1
    digest = lambda d: hashlib.md5(str(d).encode()).hexdigest() if d is not None else "~"
    by_source, place = {}, {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    for source, own in by_source.items():
        at = 0
        for d, t, *_ in sorted(own, key=lambda r: digest(r[0])):
            place.setdefault((d, source), []).append((at // 65536, at % 65536, size(t)))
            at += size(t)
    total = {s: sum(size(t) for _, t, *_ in own) for s, own in by_source.items()}
    whole = mix_sources.exact_weights({s: math.sqrt(b) for s, b in total.items()})
    slot, used, t, sum_ = {}, set(), 0, sum(whole.values())
    todo = {s: -(-b // 65536) for s, b in total.items()}
    done = dict.fromkeys(todo, 0)
    while any(done[s] < todo[s] for s in todo):
        ready = [(-(-(done[s] + 1) * sum_ // whole[s]), s is None, s or "", s) for s in todo if done[s] < todo[s] and done[s] * sum_ // whole[s] <= t]
        if ready:
            s = min(ready)[-1]
            slot[s, done[s]] = t
            used.add(t)
            done[s] += 1
        t += 1
    got = Counter((r["doc_id"], r["source"], r["block"], r["offset"], r["size"], r["slot"]) for r in mix_sources.op9_mix_sources(spark, str(tmp_path)).collect())
    expected = Counter((d, s, b, o, n, slot[s, b]) for (d, s), places in place.items() for b, o, n in places)
    assert got == expected


def test_quality_query(spark, tmp_path):
    """The query on labelled prose and junk: the held-out quarter, the cut at 0.7, accuracy there, and nothing but the text and the other labels decides."""
    rng = random.Random(71)
    rows = [(i, prose(rng, rng.randrange(20, 120)) if i % 3 else " | ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(10, 60))), f"l{i % 5}", f"s{i % 7}", 0) for i in range(600)]
    rows += [(700, None, "l", "s", 0), (701, "", "l", "s", 0), rows[5], (None, rows[3][1], "l", "s", 0), (702, prose(rng, 30_000), "l", "s", 0)]
    out = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows if d is not None}
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, 1, 0), (6, None, 0), (None, 1, 0)]
    found = []
    for name, flip, change in (("plain", False, False), ("other", True, True)):
        folder = f"{tmp_path}/{name}"
        own = [(d, t, "zz" if change else la, "yy" if change else so, x) for d, t, la, so, x in rows]
        marks = [(d, 1 - q if flip and d is not None and out.get(d) and q is not None else q, x) for d, q, x in labels]
        spark.createDataFrame(own, "doc_id long, text string, lang string, source string, label int").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found.append(sorted(map(tuple, quality_rules.op10_quality_rules(spark, folder).collect()), key=repr))
    assert [x[:2] + x[3:] for x in found[0]] == [x[:2] + x[3:] for x in found[1]] and max(abs(a[2] - b[2]) for a, b in zip(*found)) < 1e-9
    assert len(found[0]) == len(rows)
    for d, held, score, predicted in found[0]:
        assert 0 <= score <= 1 and predicted == int(score >= 0.7) and (d is None or held == out[d])
    judged = [(d % 3 > 0, p) for d, held, _, p in found[0] if held and d is not None and d < 600]
    assert len(judged) > 100 and sum(int(a) == p for a, p in judged) > 0.95 * len(judged)


def test_chat_odd_rows(spark):
    """Repeated turns stay turns, rows without a conversation are one, other columns of any name don't matter."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b")] + [(None, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(60)]
    df = spark.createDataFrame([(*r, "p", 1, "f") for r in rows], "conv_id long, turn long, role string, text string, pieces string, example int, formatted string")
    got = {r["conv_id"]: r for r in chat_format.conversation_digest(chat_format.prefix_examples(df)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["n_examples"]) == (4, 2, 2)
    assert got[None]["n_turns"] == 60 and got[None]["loss_chars"] == sum(len(f"t{k}") for k in range(0, 60, 2))


def test_shards_of_odd_rows(spark):
    """Columns named like the result's, and many rows that are equal in text and doc_id: these stay together."""
    rows = [(i, f"text {i}" * 5, 9, "s", -1) for i in range(300)] + [(7, "same", 9, "s", -1)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string, slot int")
    got = shard.histogram_sort(df, n_shards=4, whole_rows=True).collect()
    assert len(got) == 400 and {r["size"] for r in got if r["text"] == "same"} == {5} and len({r["shard"] for r in got if r["text"] == "same"}) == 1
    for k in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
