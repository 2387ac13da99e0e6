"""Hand-computed cases of the semantics that decide correctness."""

from datetime import datetime as D
from math import exp, factorial

from pyspark.sql import functions as F

from worklens.functions import scalars as S
from worklens.functions.params import DEFAULT
from worklens.operators import flow, reports, skills, text
from worklens.plans.scalar_queries import attention, sla_scope

ISSUE = "key string, created timestamp_ntz"
LOG = "key string, to_status string, changed_at timestamp_ntz, seq int"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lead_cycle(spark, created, log):
    issues = spark.createDataFrame([("A", created)], ISSUE)
    rows = spark.createDataFrame([("A", s, at, i) for i, (s, at) in enumerate(log)], LOG)
    return [(r["cycle"], r["lead"]) for r in flow.lead_cycle(issues, rows).collect()]


def test_lead_and_cycle(spark):
    d = lambda n, h=0: D(2001, 1, 1 + n, h)
    assert lead_cycle(spark, d(0), [("In Progress", d(1)), ("Done", d(3, 12))]) == [(2, 4)]
    assert lead_cycle(spark, d(0), [("Done", d(0, 6))]) == [(1, 0)]
    assert lead_cycle(spark, d(0), [("In Progress", d(1)), ("Done", d(3)), ("In Progress", d(5)), ("Done", d(6))]) == [(3, 6)]
    assert lead_cycle(spark, d(0), [("In Progress", d(1))]) == []


def test_scalars(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, S.floor_days(ts("2001-01-02 12:00:00"), ts("2001-01-01 00:00:00"))) == -2
    assert one(spark, S.business_month(ts("2024-07-01 03:00:00"), DEFAULT)) == "2024-06"
    assert one(spark, S.risk_score(F.lit(0.82), F.lit(1.0), F.lit(False))) == 0.5
    assert one(spark, S.schedule_adherence(F.lit(3.5))) == 0.5
    assert one(spark, F.round(S.harmonic_estimate(F.lit(6.0), F.lit(3)), 9)) == 11
    summed, expanded = (sum(1 / i for i in range(1, n + 1)) for n in (200, 201))
    assert abs(one(spark, S.harmonic_estimate(F.lit(1.0), F.lit(200))) - summed) < 1e-9
    assert abs(one(spark, S.harmonic_estimate(F.lit(1.0), F.lit(201))) - expanded) < 1e-9


def test_burndown(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 3, 0.0), ("c", 0, 0.0)], "key string, remaining long, rate double")
    got = {r["key"]: (r["p50"], r["p85"], r["p95"]) for r in flow.burndown(rows, {"p50": 0.5, "p85": 0.85, "p95": 0.95}).collect()}
    assert got == {"a": (1, 2, 3), "b": (260, 260, 260), "c": (0, 0, 0)}


def test_percentile_flavours(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v long")
    assert flow.nearest_rank(rows, ["g"], "v", {"p": 0.5}).first()["p"] == 3
    assert flow.half_up_median(rows.filter("v < 3"), ["g"], ["v"]).first()["median_v"] == 2


def test_velocity_forecast(spark):
    monthly = spark.createDataFrame([("x", m, n) for m, n in (("2001-06", 4), ("2001-07", 7), ("2001-08", 5))], "name string, month string, n long")
    current = spark.createDataFrame([("x", 3)], "name string, done long")
    r = flow.velocity_forecast(monthly, current, F.lit(0.5)).first()
    assert (r["value"], r["low"], r["high"], r["baseline"]) == (6, 5, 7, 6)


def test_smoothing_and_leave_one_out(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("b", 0.0), ("b", 0.0)], "g string, x double")
    got = {r["g"]: r["smoothed"] for r in reports.smoothed_mean(rows, "g", F.col("x")).collect()}
    assert got["a"] == 6.0
    single = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "g string, x double")
    assert {r["loo"] for r in reports.leave_one_out(single, "g", "x").collect()} == {0.5}


def test_tokens(spark):
    stop = spark.createDataFrame([("fix",)], "word string")
    got = text.tokens(spark.createDataFrame([(1, "Don't fix it-now x9")], "id long, text string"), stop)
    assert sorted(r["word"] for r in got.collect()) == ["don't", "now"]


def test_crosstab_keeps_zero_cells(spark):
    rows = spark.createDataFrame([("s1", "p1"), ("s2", "p2")], "a string, b string")
    assert sorted(map(tuple, reports.crosstab(rows, "a", "b").collect())) == [("s1", "p1", 1), ("s1", "p2", 0), ("s2", "p1", 0), ("s2", "p2", 1)]


def test_priority_spellings(spark):
    """Each spelling in the three families; what none of them knows is None."""
    expected = {
        "Highest": ("Urgent", "Urgent", "Urgent"), "critical": ("Urgent", "Urgent", "None"), " URGENT ": ("Urgent", "Urgent", "Urgent"), "Blocker": ("Urgent", "None", "None"), "P1": ("Urgent", "None", "None"),
        "prio 1": ("Urgent", "None", "None"), "High": ("High", "High", "High"), "p2": ("High", "None", "None"), "Prio2": ("High", "None", "None"), "medium": ("Medium", "Medium", "Medium"), "P 3": ("Medium", "None", "None"),
        "prio3": ("Medium", "None", "None"), "Low": ("Low", "Low", "Low"), "p4": ("Low", "None", "None"), "prio4": ("Low", "None", "None"), "lowest": ("None",) * 3, "normal": ("None",) * 3, "No Priority": ("None",) * 3, "": ("None",) * 3, None: ("None",) * 3,
    }
    rows = spark.createDataFrame([(x,) for x in expected], "raw string")
    got = {r["raw"]: (r["sla"], r["velocity"], r["executive"]) for r in rows.select("raw", *[S.canonical_priority(F.col("raw"), p).alias(p) for p in ("sla", "velocity", "executive")]).collect()}
    assert got == expected


def test_attention_rules(spark):
    """The first rule that fits, in order; days are counted from 2001-09-15."""
    late, soon, far = D(2001, 9, 1), D(2001, 9, 22), D(2001, 12, 1)
    cases = [
        ("Blocked", "Low", late, "Blocked", 0), ("on_hold", "Low", late, "On Hold", 1), ("Validating", "Low", late, "Validating", 2), ("In Progress", "Low", late, "Overdue", 3), ("In Progress", "Low", soon, "Due Soon", 4),
        ("To Do", "Critical", None, "Missing Target", 5), ("To Do", "critical", far, "High Priority", 6), ("To Do", "Urgent", far, "High Priority", 6), ("In Progress", "Medium", far, "In Progress", 7), ("Done", "Urgent", late, "Done", 9), ("Triage", "Low", far, "Triage", 8),
    ]
    rows = [(str(k), s, p, t, D(2001, 1, 1)) for k, (s, p, t, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "key string, status string, priority_name string, target_end_date timestamp_ntz, created timestamp_ntz")
    got = {r["key"]: (r["attention"], r["attention_rank"]) for r in attention(df).collect()}
    assert got == {str(k): (a, n) for k, (*_, a, n) in enumerate(cases)}


def test_scopes(spark):
    """SLA scope by status and window, from the start of the day; open by status as spelled."""
    rows = [("OPS-1", "To Do", D(2001, 6, 17), None), ("OPS-2", "To Do", D(2001, 6, 16, 23), None), ("OPS-3", "Backlog", D(2001, 9, 1), None), ("CAR-4", "To Do", D(2001, 9, 1), None), ("OPS-5", "blocked", D(1999, 1, 1), D(2001, 8, 1)), ("OPS-6", "Tech Discovery Required", D(2001, 9, 1), None)]
    df = spark.createDataFrame(rows, "key string, status string, created timestamp_ntz, resolved timestamp_ntz")
    assert sorted(r["key"] for r in sla_scope(df).collect()) == ["OPS-1", "OPS-5", "OPS-6"]
    states = spark.createDataFrame([("Backlog",), ("backlog",), ("Plan Release",), ("Blocked",), (None,)], "status string")
    assert [r["status"] for r in states.filter(reports.is_open()).collect()] == ["backlog", "Blocked", None]
    assert one(spark, S.sla_target(F.lit(None).cast("double"), F.lit("Urgent"))) == 90 and one(spark, S.sla_target(F.lit(5.0), F.lit("Low"))) == 5


def test_scope_counts(spark):
    """Will Not Do is neither done nor left; recent counts every child whose last Done is recent."""
    states = ["Done", "Will Not Do", "To Do", "Triage", "In Progress", "Blocked", "On Hold", "Backlog", "Reviewing"]
    children = spark.createDataFrame([(f"c{k}", "p", s, D(2001, 1, 1 + k)) for k, s in enumerate(states)], "key string, parent_key string, status string, created timestamp_ntz")
    log = spark.createDataFrame([("c0", "Done", D(2001, 9, 1), 0), ("c1", "Done", D(2001, 9, 1), 0), ("c4", "Done", D(2001, 1, 1), 0)], LOG)
    r = flow.child_counts(children, log, DEFAULT).first()
    assert tuple(r[x] for x in flow.SCOPE) == (1, 7, 2, 1, 1, 1, 2) and r["first_created"] == D(2001, 1, 1)


def test_burndown_by_bisection(spark):
    cases = [(r, x / 4) for r in (1, 2, 5, 17, 60) for x in (1, 3, 8, 40)]
    rows = spark.createDataFrame([(str(k), r, x) for k, (r, x) in enumerate(cases)], "key string, remaining long, rate double")
    got = {r["key"]: (r["p50"], r["p85"], r["p95"]) for r in flow.burndown(rows, {"p50": 0.5, "p85": 0.85, "p95": 0.95}).collect()}
    done = lambda r, m: 1 - sum(exp(-m) * m**k / factorial(k) for k in range(r))
    assert got == {str(k): tuple(next((w for w in range(1, 260) if done(r, x * w) > q), 260) for q in (0.5, 0.85, 0.95)) for k, (r, x) in enumerate(cases)}


def test_numbers_over_days(spark):
    rows = spark.createDataFrame([(k, (k * 7) % 5, k % 2) for k in range(40)], "id long, day long, x long")
    got = reports.numbered(rows, [F.col("day")], [F.desc("id")]).collect()
    expected = {k: n for n, k in enumerate(sorted(range(40), key=lambda k: ((k * 7) % 5, -k)), 1)}
    assert {r["id"]: r["place"] for r in got} == expected
    near = {r["id"]: r["rolling"] for r in reports.centred_mean(reports.numbered(rows, [F.col("day")], ["id"]), "place", "x").collect()}
    order = sorted(range(40), key=lambda k: ((k * 7) % 5, k))
    for n, k in enumerate(order):
        part = [j % 2 for j in order[max(0, n - 3) : n + 4]]
        assert abs(near[k] - 100 * sum(part) / len(part)) < 1e-9


def test_gamma_quantiles(spark):
    """Against bisection of the exact law, for small and large remaining work."""

    def probability(r, m):
        term = total = exp(-m)
        for k in range(1, r):
            term *= m / k
            total += term
        return 1 - total

    cases = [(r, q) for r in (1, 2, 3, 7, 25, 90, 400) for q in (0.05, 0.5, 0.85, 0.95)]
    rows = spark.createDataFrame([(r,) for r in sorted({r for r, _ in cases})], "r long")
    got = {r["r"]: r for r in rows.select("r", *[flow.gamma_quantile(F.col("r"), q).alias(str(q)) for q in (0.05, 0.5, 0.85, 0.95)]).collect()}
    for r, q in cases:
        low, high = 0.0, 3.0 * r + 10
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if probability(r, middle) < q else (low, middle)
        assert abs(got[r][str(q)] - low) < 1e-7 * max(1, low), (r, q)
    assert abs(one(spark, flow.gamma_quantile(F.lit(100_000), 0.5)) - (100_000 - 1 / 3)) < 1e-3


def test_domain_tags_without_a_nested_loop(spark):
    texts = spark.createDataFrame([("modules/vpc/main.tf",), ("clusters/a/helmrelease.yaml",), ("plain",), (None,), ("modules/vpc/main.tf",)], "line string")
    found = skills.regex_join(texts, "line", skills.patterns((("Plain", "^plain$"),)))
    assert sorted(map(tuple, found.collect())) == [("clusters/a/helmrelease.yaml", "Kubernetes/GitOps"), ("modules/vpc/main.tf", "Networking"), ("modules/vpc/main.tf", "Terraform/Terragrunt"), ("plain", "Plain")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ticket_routing(spark):
    """Skill first, spare capacity second; a ticket without a domain goes by spare capacity alone; its first matching rule is its domain."""
    rules = (("A", "alpha"), ("B", "beta"))
    matrix = spark.createDataFrame([("x", "A", 3.0), ("y", "A", 3.0), ("z", "A", 9.0), ("w", "A", 1.0), ("y", "B", 1.0)], "engineer string, domain string, score double")
    spare = spark.createDataFrame([("x", 1), ("y", 2), ("z", -4), ("v", 7)], "engineer string, spare long")
    ranking = skills.domain_ranking(matrix, spare)
    tickets = spark.createDataFrame([("1", "beta and ALPHA"), ("2", "beta"), ("3", "none"), ("4", None)], "key string, summary string")
    got = {r["key"]: tuple(r)[1:] for r in skills.ticket_to_skill(tickets, ranking, spare, rules).collect()}
    assert got == {"1": ("A", "z", "y", "x"), "2": ("B", "y", None, None), "3": (None, "v", "y", "x"), "4": (None, "v", "y", "x")}


def test_grains_in_one_pass(spark):
    rows = spark.createDataFrame([("a", "p", 1), ("a", None, 2), ("b", "p", 3)], "x string, y string, n long")
    got = {(r["grain"], r["x"], r["y"]): r["s"] for r in reports.grains(rows, {"cell": ["x", "y"], "x": ["x"], "all": []}, F.sum("n").alias("s")).collect()}
    assert got == {("cell", "a", "p"): 1, ("cell", "a", None): 2, ("cell", "b", "p"): 3, ("x", "a", None): 3, ("x", "b", None): 3, ("all", None, None): 6}
