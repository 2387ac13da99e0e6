"""Quantiles by counted intervals against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from worklens.operators import ranks

AT = {"low": 0.0, "a": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 1.0}


def plain(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


@pytest.mark.parametrize("bins,small", [(64, 10), (4096, 50_000)])
def test_quantiles_of_groups(spark, bins, small):
    """Even, skewed and repeated values, one far away, single rows, a null group; null and NaN take no part."""
    rng = random.Random(bins)
    groups = {
        "even": [rng.random() for _ in range(700)], "ties": [rng.choice([1.0, 1.0, 2.0, 5.0]) for _ in range(400)], "one": [3.25], "two": [1.0, 4.0], "far": [rng.random() for _ in range(200)] + [1e15],
        "steep": [math.exp(rng.uniform(-60, 60)) for _ in range(300)], "same": [7.0] * 100, None: [rng.uniform(-5, 5) for _ in range(150)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("ties", float("nan")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], F.col("v"), AT, bins=bins, small=small).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, q in AT.items():
            assert math.isclose(got[g][name], plain(values, q), rel_tol=1e-12), (g, name)


def test_quantiles_of_all_rows(spark):
    df = spark.range(1001).select((F.col("id") * 37 % 1001).alias("v"))
    assert tuple(ranks.quantiles(df, [], F.col("v"), {"p": 0.5, "q": 0.901}, bins=40, small=40).first()) == (1001, 500.0, 901.0)
    assert tuple(ranks.quantiles(df.limit(0), [], F.col("v"), {"p": 0.5}).first()) == (0, None)
    assert ranks.quantiles(df.limit(0), ["v"], F.col("v"), {"p": 0.5}).collect() == []


def test_no_percentile_over_rows(spark):
    """The plan has neither Spark's percentile buffers nor a window over rows: both only see counts."""
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = ranks.quantiles(df, ["g"], F.col("v"), {"p": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and plan.count("Window") == 1


def test_aggregates_of_the_first_pass(spark):
    """They are over all rows of a group, null values and groups without values included."""
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), ("none", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in ranks.quantiles(df, ["g"], F.col("v"), {"p": 0.5}, F.count("*").alias("rows")).collect()}
    assert got == {"a": (2, 1.5, 3), None: (1, 5.0, 1), "none": (0, None, 1)}
    assert ranks.quantiles(df, [], F.col("v"), {"p": 0.5}, F.count("*").alias("rows")).collect() == [(3, 2.0, 5)]
