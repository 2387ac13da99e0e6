"""Reports that leave no issue and no month out."""

from datetime import datetime as D
from types import SimpleNamespace

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from worklens.operators import ml as M
from worklens.plans import catalog, registry  # noqa: F401

ISSUE = "key string, status string, created timestamp_ntz, updated timestamp_ntz, resolved timestamp_ntz, target_end_date timestamp_ntz"


@pytest.fixture
def run(spark, monkeypatch):
    """A query by name over two issues that lie years apart; the second has no target date."""
    rows = [("a", "Done", D(1995, 1, 5), D(1995, 3, 7), None, D(1995, 2, 1)), ("b", "To Do", D(2001, 8, 1), D(2001, 12, 2), None, None)]
    tables = SimpleNamespace(spark=spark, issues=spark.createDataFrame(rows, ISSUE))
    monkeypatch.setattr(registry, "Tables", lambda spark, sf_dir: tables)
    return lambda name: [tuple(r) for r in registry.QUERIES[name](spark, "").collect()]


def test_timeline_has_every_issue(run):
    assert sorted(run("target_timeline_bucket")) == [("a", "Overdue"), ("b", "No Target Date")]


def test_month_spine_has_every_month(run):
    got = sorted(run("month_spine_join"))
    assert (len(got), got[0], got[2], got[-5], got[-1]) == (84, ("1995-01", 1, 0), ("1995-03", 0, 1), ("2001-08", 1, 0), ("2001-12", 0, 0))


def test_net_flow_runs_from_the_first_month(run):
    got = sorted(run("cumulative_net_flow"))
    assert (len(got), got[0], got[2], got[-5], got[-1]) == (84, ("1995-01", -1, -1), ("1995-03", 1, 0), ("2001-08", -1, -1), ("2001-12", 0, -1))


def test_cycle_of_every_month(run):
    got = sorted(run("monthly_cycle"))
    assert len(got) == 84 and [r for r in got if r[1]] == [("1995-03", 61.0, 61.0)]


def test_throughput_from_the_fourth_month(spark):
    rows = [("s", f"2001-{k:02d}", 10 * k, k) for k in range(1, 6)]
    got = M.throughput_features(spark.createDataFrame(rows, "series string, month string, completed long, created long")).orderBy("month").collect()
    assert [(r["month"], r["lag1"], r["lag3"], r["high"], r["rolling_mean"]) for r in got] == [("2001-04", 30.0, 10.0, 40.0, 20.0), ("2001-05", 40.0, 20.0, 50.0, 30.0)]


def test_model_error_counts_every_month_with_lags(spark, monkeypatch):
    from worklens.plans import ml_queries

    rows = spark.createDataFrame([("s", f"2001-{k:02d}", k * k, 0) for k in range(1, 6)], "series string, month string, completed long, created long")
    monkeypatch.setattr(ml_queries, "series", lambda t: rows)
    assert [tuple(r) for r in registry.QUERIES["model_error"](spark, "").collect()] == [(8.0, 65.0)]


def test_features_are_written_once_for_all_fits(spark):
    """A fold's rows come from a stored table, not from the joins and numbering before it."""
    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    seen = []
    pipeline = SimpleNamespace(fit=lambda train: seen.append(train) or SimpleNamespace(transform=lambda test: test.select("label", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))).alias("probability"))))
    assert M.out_of_fold(rows, pipeline).count() == 40
    assert len(seen) == 3 and all(train.inputFiles() and "Window" not in train._jdf.queryExecution().optimizedPlan().toString() for train in seen)


def test_tables_of_fits_have_files_by_their_rows(spark, monkeypatch):
    """A file is a task, and after the windows of a numbering there was one file however many rows it had."""
    monkeypatch.setattr(M, "FILE_ROWS", 10, raising=False)
    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), (F.col("id") % 4 == 0).cast("double").alias("label"))
    seen = []
    pipeline = SimpleNamespace(fit=lambda train: seen.append(train) or SimpleNamespace(transform=lambda test: test.select("label", array_to_vector(F.array(F.lit(0.5), F.lit(0.5))).alias("probability"))))
    assert M.out_of_fold(rows, pipeline).count() == 40
    assert all(len(train.inputFiles()) == 4 for train in seen)


def test_active_days_are_added_in_order(spark):
    """No aggregate adds doubles, whose order it doesn't keep where it spills; the window's order is that of seq."""
    from worklens.operators import flow

    start = D(2001, 1, 1)
    log = spark.createDataFrame([("A", "Done" if k == 5 else "In Progress", start.replace(day=1 + k, hour=(7 * k) % 24), k) for k in range(6)], "key string, to_status string, changed_at timestamp_ntz, seq int")
    out = flow.lead_cycle(spark.createDataFrame([("A", start)], "key string, created timestamp_ntz"), log)
    assert [r["cycle"] for r in out.collect()] == [5]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("sum(" in x for x in plan if "Aggregate [" in x)


def test_raw_records_hold_their_log_without_numbering(spark):
    """The log of a record has the transitions in the order of seq, but no window over all transitions; what reads no changelog doesn't build it."""
    from worklens.plans import ingest_queries as Q
    from worklens.sources import ingest as I
    from worklens.sources.bind import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    raw = Q.raw_issues(t)
    assert "Window" not in raw._jdf.queryExecution().optimizedPlan().toString()
    assert Q.records(t).columns == ["key", "id", "fields"]
    log = I.parse(raw.filter("again = 0"), I.ISSUE).select("key", F.expr("transform(changelog.histories, h -> h.items[0].toString)").alias("log")).filter("log is not null")
    wanted = t.transitions.join(t.issues.select("key"), "key").groupBy("key").agg(F.expr("transform(sort_array(collect_list(struct(seq, to_status))), x -> x.to_status)").alias("log"))
    assert log.count() == wanted.count() > 1000 and log.exceptAll(wanted).isEmpty()


def test_newest_rows_stay_dealt_out_by_key(spark):
    """Counting by key what newest has chosen by key takes no second exchange, and neither does an array that is laid open in between."""
    from worklens.sources.keyed import newest

    rows = spark.createDataFrame([("a", 1, [1]), ("a", 2, [1, 2]), ("b", 1, [5]), (None, 3, [6]), (None, 2, [7, 8])], "k string, t int, x array<int>")
    got = newest(rows, "k", F.col("t")).select("k", F.explode("x").alias("x")).groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("x"))
    assert sorted(((r["k"] or "", r["n"], r["x"]) for r in got.collect())) == [("", 1, 6), ("a", 2, 2), ("b", 1, 5)]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
