"""Commits of several tables, streams that fail in between, the audit and the bound of a stream's state."""

import json
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from worklens.sources import keyed
from worklens.sources.keyed import Store, Upsert
from worklens.streaming import intake


def line(k, status, hour, log=()):
    histories = [{"created": f"2001-01-01T{h:02d}:00:00.000+0000", "items": [{"field": "status", "toString": s}]} for h, s in log]
    return (json.dumps({"key": f"OPS-{k}", "id": str(k), "fields": {"status": {"name": status}, "updated": f"2001-01-01T{hour:02d}:00:00.000+0000"}, "changelog": {"histories": histories}}),)


def add(spark, source, lines):
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(source)


def whole(store):
    issues = sorted((r["id"], r["status"]) for r in store.table("issues").collect())
    log = sorted((int(r["key"][4:]), r["seq"], r["to_status"]) for r in store.table("transitions").collect())
    return issues, log


def test_batch_killed_between_two_tables(spark, tmp_path, monkeypatch):
    """Readers see both tables of the commit before; the next run reads the same lines; a batch that is in already isn't done again."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, source, [line(k, "To Do", 1, [(1, "To Do")]) for k in range(20)])
    intake.run_issue_stream(spark, source, target, buckets=4).awaitTermination()
    before = whole(Store(spark, target))
    assert before == ([(k, "To Do") for k in range(20)], [(k, 0, "To Do") for k in range(20)])
    add(spark, source, [line(k, "Done", 2, [(1, "To Do"), (2, "Done")]) for k in range(10)])
    write = Store._write

    def dies(self, name, rows, key, number):
        found = write(self, name, rows, key, number)
        if name == "transitions":
            raise RuntimeError("lost")
        return found

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        intake.run_issue_stream(spark, source, target).awaitTermination()
    assert whole(Store(spark, target)) == before and Store(spark, target).audit().count() == 1
    assert Store(spark, target).watermark() == D(2001, 1, 1, 1)
    monkeypatch.setattr(Store, "_write", write)
    # the commit succeeds but the stream dies before its checkpoint knows
    forget = Store._forget
    monkeypatch.setattr(Store, "_forget", lambda self, number: (_ for _ in ()).throw(RuntimeError("late")))
    with pytest.raises(Exception, match="late"):
        intake.run_issue_stream(spark, source, target).awaitTermination()
    monkeypatch.setattr(Store, "_forget", forget)
    after = whole(Store(spark, target))
    assert after[0] == [(k, "Done" if k < 10 else "To Do") for k in range(20)]
    assert after[1] == sorted([(k, 0, "To Do") for k in range(20)] + [(k, 1, "Done") for k in range(10)])
    intake.run_issue_stream(spark, source, target).awaitTermination()
    assert whole(Store(spark, target)) == after
    audit = [(r["number"], r["batch"], r["whole"], r["fetched"], r["total"], r["watermark"]) for r in Store(spark, target).audit().orderBy("number").collect()]
    assert audit == [(0, 0, True, {"issues": 20, "transitions": 20}, {"issues": 20, "transitions": 20}, D(2001, 1, 1, 1)), (1, 1, False, {"issues": 10, "transitions": 20}, {"issues": 20, "transitions": 30}, D(2001, 1, 1, 2))]


def test_children_follow_the_row_that_stays(spark, tmp_path):
    """An older reading changes nothing; at equal times the later batch, within a batch the greater line; a null key is a key; keys without children lose theirs."""
    store = Store(spark, str(tmp_path / "t"), 3)

    def commit(rows, kids):
        store.commit({"a": Upsert(spark.createDataFrame(rows, "key string, at timestamp_ntz, v int"), "key", "at", {"b": spark.createDataFrame(kids, "key string, c string")})})

    t = [D(2001, 1, d) for d in range(1, 9)]
    commit([("x", t[3], 1), ("y", t[3], 1), ("z", None, 1), ("w", t[1], 2), ("w", t[1], 5)], [("x", "old"), ("y", "old"), ("z", "old"), ("w", "w")])
    commit([("x", t[2], 2), ("y", t[3], 2), ("z", t[0], 2)], [("x", "no"), ("y", "new"), ("y", "new2")])
    got = {(r["key"], r["v"]) for r in store.table("a").collect()}
    assert got == {("x", 1), ("y", 2), ("z", 2), ("w", 5)}
    assert sorted((r["key"], r["c"]) for r in store.table("b").collect()) == [("w", "w"), ("x", "old"), ("y", "new"), ("y", "new2")]
    commit([], [])
    assert store.table("a").count() == 4 and store.audit().count() == 3
    assert sorted(r["c"] for r in store.rows_of("b", "key", ["y", "y", "nobody"]).collect()) == ["new", "new2"]


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    """Thirty batches leave as many files as one, and the versions that nothing names are gone."""
    root = tmp_path / "t"
    store = Store(spark, str(root), 4, keep=2)
    for k in range(30):
        rows = spark.range(40).select(F.col("id").alias("key"), F.lit(D(2001, 1, 1)).cast("timestamp_ntz").alias("at"), F.lit(k).alias("v")).filter(F.col("key") % 7 == k % 7)
        store.commit({"a": Upsert(rows, "key", "at")})
    found = store.table("a")
    assert {(r["key"], r["v"]) for r in found.collect()} == {(k, max(b for b in range(30) if b % 7 == k % 7)) for k in range(40)}
    assert len(found.inputFiles()) == 4
    assert len(list(root.glob("a/v=*/bucket=*"))) <= 4 * 3 and len(list(root.glob("_commits/state-*.json"))) == 2
    assert Store(spark, str(root), 99).buckets == 4


def test_stores_without_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert store.last() is None and store.watermark() is None and store.audit().collect() == []
    with pytest.raises(ValueError, match="no commit"):
        store.table("a")


def test_newest_by_columns_in_order(spark):
    rows = spark.createDataFrame([("a", 1, [1]), ("a", 1, [2]), ("b", None, None), (None, 2, [3]), (None, 1, [9])], "k string, t int, x array<int>")
    assert sorted((r["k"] or "", r["x"]) for r in keyed.newest(rows, "k", F.col("t")).collect()) == [("", [3]), ("a", [2]), ("b", None)]


def test_state_of_completions_is_bounded(spark, tmp_path):
    """Rows later than the bound are dropped and counted, days past it are final and their state is gone."""
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, n: [("k", "Done", D(2001, 1, d)) for _ in range(n)]
    batches = [day(1, 3) + day(2, 1), day(2, 2) + day(20, 1), day(21, 5) + day(22, 1), day(1, 7) + day(22, 2)]  # the last has seven rows too late
    dropped, state = 0, []
    for rows in batches:
        spark.createDataFrame(rows, "key string, to_status string, changed_at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, to_status string, changed_at timestamp").parquet(source)
        query = intake.run_completions(stream, target, bound="3 days", buckets=2)
        query.awaitTermination()
        for p in query.recentProgress:
            dropped += sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
            state += [o["numRowsTotal"] for o in p["stateOperators"]]
    got = {r["day"].day: r["n"] for r in Store(spark, target).table("days").collect()}
    assert got == {1: 3, 2: 3, 20: 1, 21: 5, 22: 3}
    assert dropped > 0 and state[-1] <= 3


def test_first_commit_without_rows(spark, tmp_path):
    """Empty tables are tables: they can be read, and the next commit fills them."""
    store = Store(spark, str(tmp_path / "t"), 3)
    schema = "key string, at timestamp_ntz, v int"
    assert store.commit({"a": Upsert(spark.createDataFrame([], schema), "key", "at", {"b": spark.createDataFrame([], "key string, c string")})}) == 0
    assert store.table("a").collect() == [] and store.table("b").columns == ["key", "c"] and store.watermark() is None
    store.commit({"a": Upsert(spark.createDataFrame([("x", D(2001, 1, 1), 1)], schema), "key", "at", {"b": spark.createDataFrame([("x", "y")], "key string, c string")})})
    assert store.table("a").count() == store.table("b").count() == 1
    assert [r["total"] for r in store.audit().orderBy("number").collect()] == [{"a": 0, "b": 0}, {"a": 1, "b": 1}]
