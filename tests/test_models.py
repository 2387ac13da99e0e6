"""Models on little data: defined empty results, the calibration's gate, folds by class; training detail by hand."""

from datetime import datetime as D
from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from worklens.operators import ml as M
from worklens.plans import ml_queries as Q

ISSUE = (
    "key string, id long, issuetype string, status string, status_category string, priority_name string, assignee_name string, business_lead string,"
    " created timestamp_ntz, updated timestamp_ntz, resolved timestamp_ntz, target_end_date timestamp_ntz"
)


def issues(spark, n, late=lambda k: k % 4 == 0):
    """n Done issues of the team in the last year; every fourth is late."""
    start, rows = D(2001, 1, 1), []
    for k in range(n):
        created = start + timedelta(days=3 * k % 200)
        updated = created + timedelta(days=10 + k % 7)
        rows.append((f"OPS-{k}", k, "Story", "Done", "done", ("High", "Low")[k % 2], f"Engineer {k % 3}", "lead", created, updated, None, updated + timedelta(days=-3 if late(k) else 4)))
    return spark.createDataFrame(rows, ISSUE)


@pytest.mark.parametrize("n", [0, 20, 40])
def test_calibration_asks_for_thirty_rows(spark, n):
    got = Q.calibration(SimpleNamespace(spark=spark, issues=issues(spark, n))).collect()
    assert len(got) == int(n >= 30)
    assert all(r["n"] == n and r["brier_after"] <= 0.3 for r in got)


def test_calibration_asks_for_both_classes(spark):
    assert Q.calibration(SimpleNamespace(spark=spark, issues=issues(spark, 40, lambda k: False))).collect() == []


def test_folds_hold_equal_parts_of_each_class(spark):
    rows = spark.range(95).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).cast("double").alias("label"))
    got = M.folded(rows).groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in got if r["label"] == label]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in got) == 95


@pytest.mark.parametrize("name", ["throughput_model", "model_comparison", "recursive_forecast", "ensemble_forecast", "forecast_band", "forecast_concat", "on_time_model", "score_probability", "probability_curve"])
def test_models_of_few_months_are_empty(spark, name, monkeypatch):
    from worklens.plans import registry

    few = issues(spark, 12).filter("created < '2001-03-01'").withColumn("updated", F.least("updated", F.lit(D(2001, 3, 1))))
    monkeypatch.setattr(registry, "Tables", lambda spark, sf_dir: SimpleNamespace(spark=spark, issues=few))
    got = registry.QUERIES[name](spark, "")
    assert got.columns and got.collect() == []


def test_training_detail(spark):
    """All Done issues with a deadline; the offset is the trimmed mean of the delays; the adjusted day decides."""
    rows = [("a", D(2001, 1, 12, 6), D(2001, 1, 10)), ("b", D(2001, 1, 9), D(2001, 1, 10)), ("c", D(2001, 1, 20), D(2001, 1, 10)), ("d", D(2001, 1, 10, 20), D(2001, 1, 10)), ("e", None, D(2001, 1, 1)), ("f", D(2001, 1, 1), None)]
    df = spark.createDataFrame([(k, " done ", None, None, u, t) for k, u, t in rows] + [("g", "To Do", None, None, D(2001, 1, 1), D(2001, 1, 1))], "key string, status string, assignee_name string, priority_name string, updated timestamp_ntz, target_end_date timestamp_ntz")
    got = {r["key"]: (r["past_due"], r["on_time"], round(r["offset"], 6)) for r in M.training_detail(df).collect()}
    # delays 2.25, 0, 10 and 0.8333 days: under five rows the median, 1.541667
    assert got == {"a": (2, "Yes", 1.541667), "b": (-1, "Yes", 1.541667), "c": (10, "No", 1.541667), "d": (0, "Yes", 1.541667)}


def test_different_requests_are_scored_once(spark, monkeypatch):
    """Requests that agree in priority, assignee and date have one score; each keeps its row, and a null is a value like others."""
    done = issues(spark, 20)
    rows = M.on_time_label(M.training_rows(done, Q.P, 720).withColumn("budget_days", F.col("budget")))
    fitted = M.OnTime(None, None, M.history(rows, M.open_pairs(done, Q.P)), M.validation_delays(rows), {})
    seen = []
    monkeypatch.setattr(M, "probabilities", lambda fitted, features: seen.append(features) or features.withColumns({"probability": F.col("budget_days") / 100, "band": F.lit("some")}))
    asked = [("a", "High", "Engineer 0", D(2001, 10, 1)), ("b", "High", "Engineer 0", D(2001, 10, 1)), ("c", None, None, D(2001, 10, 1)), ("d", None, None, D(2001, 10, 1)), ("e", "High", "Engineer 0", None)]
    requests = spark.createDataFrame(asked, "key string, priority string, assignee string, date timestamp_ntz").withColumn("date", F.to_date("date"))
    got = {r["key"]: r for r in M.score_requests(fitted, requests, Q.P).collect()}
    assert [x.count() for x in seen] == [3] and sorted(got) == list("abcde")
    assert got["a"][1:] == got["b"][1:] and got["c"][1:] == got["d"][1:] and got["e"]["probability"] is None
    delay = M.with_delay(requests.filter("key = 'a'"), fitted.delays).first()["delay"]
    assert got["a"]["budget_days"] == int(16 - delay) and got["a"]["probability"] == got["a"]["budget_days"] / 100
    assert list(got["a"].asDict()) == ["key", "priority", "assignee", "date", *M.NUMERIC, "probability", "band"]


def test_rows_are_prepared_once_for_all_fits(spark, monkeypatch):
    """What stands before the models is fitted and made once for both candidates, and the usual delay is found once for labels and requests."""
    from pyspark.ml.feature import StringIndexer

    indexed, means = [], []
    fit, mean = StringIndexer._fit, M.trimmed_mean
    monkeypatch.setattr(StringIndexer, "_fit", lambda self, rows: indexed.append(1) or fit(self, rows))
    monkeypatch.setattr(M, "trimmed_mean", lambda *of: means.append(1) or mean(*of))
    monkeypatch.setattr(Q, "TREES", 2)
    monkeypatch.setattr(Q, "ROUNDS", 2)
    found = Q.fitted(SimpleNamespace(spark=spark, issues=issues(spark, 40)))
    assert found.report["probability_calibrated"] and found.report["training_rows"] == 40
    # candidates, the best one on all rows, three folds
    assert len(indexed) == 5 and len(means) == 1


def test_rows_prepared_once_give_the_same_models(spark):
    rows = M.training_rows(issues(spark, 60), Q.P, 720).withColumn("budget_days", F.col("budget"))
    labelled = M.on_time_label(rows)
    train = M.written(M.weighted(M.with_features(labelled, M.history(labelled, M.open_pairs(issues(spark, 60), Q.P)), leave_out=True)).coalesce(1))
    grown = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]
    alone = {name: grown(Pipeline(stages=p.getStages()).fit(train)) for name, p in M.classifiers(3, 3).items()}
    assert {name: grown(m) for name, m in M.fit_all(M.classifiers(3, 3), train).items()} == alone
    assert {name: grown(p.fit(train)) for name, p in M.classifiers(3, 3).items()} == alone


def test_on_time_models_are_of_the_reports_size(spark, monkeypatch):
    """1,500 trees and 100 rounds, for the model, its scores and its calibration; a fit of few thousand rows isn't a single task."""
    asked, made = [], M.classifiers
    monkeypatch.setattr(M, "classifiers", lambda *a, **k: asked.append(made(*a, **k)) or made(2, 2))
    assert Q.fitted(SimpleNamespace(spark=spark, issues=issues(spark, 40))) is not None
    assert Q.calibration(SimpleNamespace(spark=spark, issues=issues(spark, 40))).count() == 1
    assert {(p["forest"].getStages()[-1].getNumTrees(), p["boosted"].getStages()[-1].getMaxIter()) for p in asked} == {(1500, 100)}
    assert M.dealt(spark.range(3000).select(F.col("id").alias("key")), 3000).rdd.getNumPartitions() == 3
