"""Queries of the ticket reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import AGE_EXCLUDED, AGE_EXCLUDED_BY_STATUS, DEFAULT as P, PRIORITIES, QUEUE, SIZES, TREND_DONE
from worklens.operators import flow, reports as R
from worklens.operators.ranks import quantiles
from worklens.plans.registry import NOW, days, floor_days, query
from worklens.plans.scalar_queries import ATTENTION, CUT, IN_SCOPE, OPEN, SLA, attention, month_range, sla_rows, sla_scope

c = F.col
AGE = f"greatest(0, {floor_days('created', NOW)})"
LEFT = f"CAST(CAST(target_end_date AS DATE) - CAST({NOW} AS DATE) AS INT)"
VEL = "CASE lower(trim(priority_name)) WHEN 'urgent' THEN 'Urgent' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'None' END"
TEAM = ", ".join(f"'{x}'" for x in P.team)
age = lambda: S.age_days(c("created"), P)
left = lambda: S.days_left(c("target_end_date"), P)

BOARD = ("Triage", "Reviewing", "Backlog", "To Do", "In Progress", "Blocked", "On Hold", "Validating", "Staged CAR")
query(
    "status_counts",
    lambda t: t.issues.filter(~c("status").isin("Done", "Will Not Do")).groupBy("status").agg(F.count("*").alias("n")).withColumn("place", S.rank_in(c("status"), BOARD)),
    "SELECT status, count(*) AS n, CAST(coalesce(list_position([" + ", ".join(f"'{b}'" for b in BOARD) + "], status), 10) AS INT) AS place FROM w_issues WHERE status NOT IN ('Done', 'Will Not Do') GROUP BY 1",
)
OPEN_ON_BOARD = ("Triage", "Tech Discovery Required", "To Do", "Blocked", "On Hold", "In Progress", "Validating")
_one = lambda s: s.lower().replace(" ", "_")
query(
    "overview_kpis",
    lambda t: t.issues.agg(F.count_if(c("status").isin(*OPEN_ON_BOARD)).alias("total_open"), *[F.count_if(c("status") == s).alias(_one(s)) for s in ("In Progress", "Blocked", "Validating")]),
    "SELECT count(*) FILTER (status IN (" + ", ".join(f"'{s}'" for s in OPEN_ON_BOARD) + ")) AS total_open, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {_one(s)}" for s in ("In Progress", "Blocked", "Validating")) + " FROM w_issues",
)
query(
    "exec_kpis",
    lambda t: t.issues.filter(R.is_open()).agg(F.count("*").alias("n"), F.round(F.avg(age()), 6).alias("mean_age"), F.count_if(age() >= 90).alias("old"), F.count_if(left() < 0).alias("overdue")),
    f"SELECT count(*) AS n, round(avg({AGE}), 6) AS mean_age, count(*) FILTER ({AGE} >= 90) AS old, count(*) FILTER ({LEFT} < 0) AS overdue FROM w_issues WHERE {OPEN}",
)
for name, col, missing, n in (("mean_age_by_lead", "business_lead", "Unknown", 12), ("mean_age_by_assignee", "assignee_name", "Unassigned", 15)):
    query(
        name,
        lambda t, col=col, missing=missing, n=n: t.issues.filter(R.is_open()).groupBy(F.coalesce(col, F.lit(missing)).alias(col)).agg(F.round(F.avg(age()), 6).alias("mean_age"), F.count("*").alias("n")).orderBy("mean_age", col).limit(n),
        f"SELECT coalesce({col}, '{missing}') AS {col}, round(avg({AGE}), 6) AS mean_age, count(*) AS n FROM w_issues WHERE {OPEN} GROUP BY 1 ORDER BY 2, 1 LIMIT {n}",
    )
_sla = lambda t: sla_scope(sla_rows(t))
SLA_COUNTS = (("Breached", "breached"), ("At Risk", "at_risk"), ("On Track", "on_track"), ("Unknown", "unknown"))
_sla_counts = lambda: [F.count_if(c("sla_status") == s).alias(a) for s, a in SLA_COUNTS]
sla_counts = ", ".join(f"count(*) FILTER (sla_status = '{s}') AS {a}" for s, a in SLA_COUNTS)
_pct = lambda s: f"round(avg(CASE WHEN sla_status = '{s}' THEN 1.0 ELSE 0.0 END) * 100, 6)"


def sla_kpis(t):
    counts = [*_sla_counts(), R.share(c("sla_status") == "Breached").alias("breach_pct"), R.share(c("sla_status") == "At Risk").alias("at_risk_pct")]
    rows = quantiles(_sla(t), [], c("elapsed"), {"median_elapsed": 0.5}, *counts).withColumn("median_elapsed", F.round("median_elapsed", 6))
    return rows.crossJoin(F.broadcast(quantiles(_sla(t), [], c("target"), {"x": 0.5}).select(F.round("x", 6).alias("median_target"))))


query(
    "sla_kpis",
    sla_kpis,
    f"SELECT count(*) AS n, {sla_counts}, {_pct('Breached')} AS breach_pct, {_pct('At Risk')} AS at_risk_pct, round(quantile_cont(elapsed, 0.5), 6) AS median_elapsed, round(quantile_cont(target, 0.5), 6) AS median_target FROM sla WHERE {IN_SCOPE}",
    sla=SLA,
)


def sla_by_priority(t):
    """Counts of every status, rates and quartiles of the elapsed days, by priority."""
    counts = [*_sla_counts(), R.share(c("sla_status") == "Breached").alias("breach_pct"), R.share(c("sla_status") == "At Risk").alias("at_risk_pct")]
    return quantiles(_sla(t), ["priority"], c("elapsed"), {"median": 0.5, "p75": 0.75}, *counts).withColumns({x: F.round(x, 6) for x in ("median", "p75")})


query(
    "sla_by_priority",
    sla_by_priority,
    f"SELECT priority, count(*) AS n, {sla_counts}, round(quantile_cont(elapsed, 0.5), 6) AS median, round(quantile_cont(elapsed, 0.75), 6) AS p75, {_pct('Breached')} AS breach_pct, {_pct('At Risk')} AS at_risk_pct FROM sla WHERE {IN_SCOPE} GROUP BY 1",
    sla=SLA,
)
TOP15 = "(SELECT assignee_name FROM {x} WHERE assignee_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n})"
SC = f"SELECT * FROM sla WHERE {IN_SCOPE}"
_labelled = lambda t: _sla(t).withColumn("assignee_name", F.coalesce("assignee_name", F.lit("Unassigned")))
query(
    "sla_breach_heatmap",
    lambda t: R.top_semi(_labelled(t), "assignee_name", 15).groupBy("assignee_name", "priority").agg(F.count("*").alias("total"), F.count_if(c("sla_status") == "Breached").alias("breached"), R.share(c("sla_status") == "Breached").alias("rate")),
    f"SELECT assignee_name, priority, count(*) AS total, count(*) FILTER (sla_status = 'Breached') AS breached, round(avg(CASE WHEN sla_status = 'Breached' THEN 1.0 ELSE 0.0 END) * 100, 6) AS rate FROM sl WHERE assignee_name IN {TOP15.format(x='sl', n=15)} GROUP BY 1, 2",
    sla=SLA, sc=SC, sl="SELECT * REPLACE (coalesce(assignee_name, 'Unassigned') AS assignee_name) FROM sc",
)
query(
    "sla_weekly",
    lambda t: _sla(t).groupBy(F.to_date(F.date_trunc("week", "created")).alias("week")).agg(F.count("*").alias("created"), *_sla_counts()[:3], R.share(c("sla_status") == "Breached").alias("breach_pct")),
    f"SELECT CAST(date_trunc('week', created) AS DATE) AS week, count(*) AS created, count(*) FILTER (sla_status = 'Breached') AS breached, count(*) FILTER (sla_status = 'At Risk') AS at_risk, count(*) FILTER (sla_status = 'On Track') AS on_track, {_pct('Breached')} AS breach_pct FROM sc GROUP BY 1",
    sla=SLA, sc=SC,
)
query(
    "sla_breached_by_owner",
    lambda t: _sla(t).filter("sla_status = 'Breached'").groupBy("assignee_name", "business_lead").agg(F.count("*").alias("n"), F.round(F.avg("elapsed"), 6).alias("elapsed"), F.round(F.avg("risk"), 6).alias("risk"), F.round(F.avg("target"), 6).alias("target")),
    "SELECT assignee_name, business_lead, count(*) AS n, round(avg(elapsed), 6) AS elapsed, round(avg(risk), 6) AS risk, round(avg(target), 6) AS target FROM sc WHERE sla_status = 'Breached' GROUP BY 1, 2",
    sla=SLA, sc=SC,
)
query(
    "sla_detail",
    lambda t: R.numbered(_sla(t).filter("sla_status in ('Breached', 'At Risk')"), [S.rank_in(c("sla_status"), ("Breached", "At Risk")), -F.floor(F.round("risk", 9) * 1000)], [F.desc(F.round("risk", 9)), F.desc("elapsed"), c("key")]).select("key", "sla_status", "place"),
    "SELECT key, sla_status, CAST(row_number() OVER (ORDER BY CASE sla_status WHEN 'Breached' THEN 1 ELSE 2 END, round(risk, 9) DESC, elapsed DESC, key) AS INT) AS place FROM sc WHERE sla_status IN ('Breached', 'At Risk')",
    sla=SLA, sc=SC,
)
query(
    "box_stats",
    lambda t: R.five_numbers(_sla(t), "priority", c("elapsed")),
    "SELECT priority, " + ", ".join(f"round(quantile_cont(elapsed, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))) + " FROM sc GROUP BY 1",
    sla=SLA, sc=SC,
)
#: Months of later years are reported; a parameter of the operators, 0 for all.
FROM_YEAR = 0
CV = """SELECT coalesce(a.month, b.month) AS month, coalesce(created, 0) AS created, coalesce(completed, 0) AS completed FROM (SELECT strftime(created, '%Y-%m') AS month, count(*) AS created FROM w_issues GROUP BY 1) a
 FULL JOIN (SELECT strftime(coalesce(resolved, updated), '%Y-%m') AS month, count(*) AS completed FROM w_issues WHERE status IN ('Done', 'Released Successfully to Production') GROUP BY 1) b ON a.month = b.month"""
query("created_vs_completed", lambda t: R.created_vs_completed(t.issues, FROM_YEAR), f"SELECT * FROM cv WHERE CAST(left(month, 4) AS INT) > {FROM_YEAR}", cv=CV)
query("monthly_created", lambda t: R.created_vs_completed(t.issues, 0).filter("created > 0").select("month", "created"), "SELECT month, created FROM cv WHERE created > 0", cv=CV)
query("monthly_completed", lambda t: R.created_vs_completed(t.issues, 0).filter("completed > 0").select("month", "completed"), "SELECT month, completed FROM cv WHERE completed > 0", cv=CV)
query(
    "capacity_kpis",
    lambda t: R.created_vs_completed(t.issues, FROM_YEAR).agg(F.round(F.avg("created"), 6).alias("mean_created"), F.round(F.avg("completed"), 6).alias("mean_completed"), F.max_by("created", "month").alias("last_created"), F.max_by("completed", "month").alias("last_completed")),
    "SELECT round(avg(created), 6) AS mean_created, round(avg(completed), 6) AS mean_completed, max_by(created, month) AS last_created, max_by(completed, month) AS last_completed FROM cv",
    cv=CV,
)
query("melt_capacity", lambda t: R.created_vs_completed(t.issues, FROM_YEAR).unpivot("month", ["created", "completed"], "kind", "n"), "SELECT month, 'created' AS kind, created AS n FROM cv UNION ALL SELECT month, 'completed', completed FROM cv", cv=CV)
query("yearly_total", lambda t: t.issues.groupBy(F.year("updated").alias("year")).agg(F.count("*").alias("n")), "SELECT CAST(year(updated) AS INT) AS year, count(*) AS n FROM w_issues GROUP BY 1")
_spine = lambda t: flow.spine_of(t.issues, P)
SP = f"SELECT strftime(unnest(range(date_trunc('month', low), date_trunc('month', high) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM (SELECT min(created) AS low, least(max(greatest(created, coalesce(resolved, updated))), {NOW}) AS high FROM w_issues)"
MF = "SELECT sp.month, coalesce(created, 0) AS created, coalesce(completed, 0) AS completed, coalesce(completed, 0) - coalesce(created, 0) AS net FROM sp LEFT JOIN cv ON cv.month = sp.month"
_flow = lambda t: R.monthly_flow(t.issues, _spine(t))
TS = "SELECT strftime(unnest(range(m - INTERVAL 8 MONTH, m + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM (SELECT date_trunc('month', max(coalesce(resolved, updated))) AS m FROM w_issues)"
TD = f"SELECT *, strftime(coalesce(resolved, updated), '%Y-%m') AS month FROM w_issues WHERE status IN ({', '.join(f"'{x}'" for x in TREND_DONE)}) AND strftime(coalesce(resolved, updated), '%Y-%m') IN (SELECT month FROM tsp)"
TF = "SELECT tsp.month, coalesce(created, 0) AS created, coalesce(completed, 0) AS completed, coalesce(completed, 0) - coalesce(created, 0) AS net FROM tsp LEFT JOIN (SELECT strftime(created, '%Y-%m') AS month, count(*) AS created FROM w_issues GROUP BY 1) a ON a.month = tsp.month LEFT JOIN (SELECT month, count(*) AS completed FROM td GROUP BY 1) b ON b.month = tsp.month"
TC = f"SELECT tsp.month, coalesce(a, 0.0) AS median, coalesce(b, 0.0) AS p75 FROM tsp LEFT JOIN (SELECT month, quantile_cont({floor_days('created', 'updated')}, 0.5) AS a, quantile_cont({floor_days('created', 'updated')}, 0.75) AS b FROM td GROUP BY 1) q ON q.month = tsp.month"
TREND = {"tsp": TS, "td": TD, "tf": TF, "tc": TC}
#: The same over all months, from the first created or done issue to the last.
TS_ALL = "SELECT strftime(unnest(range(date_trunc('month', low), date_trunc('month', high) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM (SELECT min(least(created, coalesce(resolved, updated))) AS low, max(greatest(created, coalesce(resolved, updated))) AS high FROM w_issues)"
TREND_ALL = TREND | {"tsp": TS_ALL}
_whole_flow = lambda t: R.monthly_flow(t.issues, R.whole_spine(t.issues), TREND_DONE)
_trend = lambda t: R.trend_spine(t.issues)
_trend_flow = lambda t: R.monthly_flow(t.issues, _trend(t), TREND_DONE)
query("month_spine_join", lambda t: _whole_flow(t).select("month", "created", "completed"), "SELECT month, created, completed FROM tf", **TREND_ALL)
query("cumulative_net_flow", lambda t: _whole_flow(t).select("month", "net", "cumulative"), "SELECT month, net, CAST(sum(net) OVER (ORDER BY month) AS BIGINT) AS cumulative FROM tf", **TREND_ALL)
EX = days("created", "updated")
query("monthly_cycle", lambda t: R.monthly_cycle(t.issues, R.whole_spine(t.issues)), "SELECT * FROM tc", **TREND_ALL)
query(
    "status_mix",
    lambda t: R.top_semi(t.issues, "status", 6).withColumn("month", F.date_format(F.coalesce("resolved", "updated"), "yyyy-MM")).join(F.broadcast(_trend(t)), "month").groupBy("month", "status").agg(F.count("*").alias("n")),
    "SELECT strftime(coalesce(resolved, updated), '%Y-%m') AS month, status, count(*) AS n FROM w_issues WHERE strftime(coalesce(resolved, updated), '%Y-%m') IN (SELECT month FROM tsp) AND status IN (SELECT status FROM w_issues GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) GROUP BY 1, 2",
    **TREND,
)
query("top_n_semi", lambda t: R.top_semi(t.issues, "assignee_name", 5).select("key", "assignee_name"), f"SELECT key, assignee_name FROM w_issues WHERE assignee_name IN {TOP15.format(x='w_issues', n=5)}")
query(
    "team_monthly_done",
    lambda t: R.trend_done(t.issues, _trend(t)).filter((F.lower(F.trim("issuetype")) != "feature") & c("assignee_name").isin(*P.team)).groupBy("month", "assignee_name").agg(F.count("*").alias("n")),
    f"SELECT month, assignee_name, count(*) AS n FROM td WHERE lower(trim(issuetype)) <> 'feature' AND assignee_name IN ({TEAM}) GROUP BY 1, 2",
    **TREND,
)
query(
    "trend_kpis",
    lambda t: R.trend_kpis(_trend_flow(t), R.monthly_cycle(t.issues, _trend(t))),
    "SELECT * FROM (SELECT CAST(sum(created) AS BIGINT) AS created, CAST(sum(completed) AS BIGINT) AS completed, coalesce(round(CAST(sum(completed) AS DOUBLE) / nullif(sum(created), 0) * 100, 6), 0.0) AS rate FROM tf), (SELECT coalesce(round(avg(nullif(median, 0)), 6), 0.0) AS median_cycle, coalesce(round(avg(nullif(p75, 0)), 6), 0.0) AS p75_cycle FROM tc)",
    **TREND,
)
VU = f"""SELECT key, assignee_name AS assignee, {VEL} AS priority, 'backlog' AS kind, {floor_days('created', 'planned_start_date')} AS days FROM w_issues WHERE assignee_name IN ({TEAM}) AND created >= {NOW} - INTERVAL 720 DAY AND status = 'Done' AND {floor_days('created', 'planned_start_date')} > 0
 UNION ALL SELECT key, assignee_name, {VEL}, 'execution', {floor_days('created', 'coalesce(resolved, updated)')} FROM w_issues WHERE assignee_name IN ({TEAM}) AND created >= {NOW} - INTERVAL 720 DAY AND status = 'Done' AND {floor_days('created', 'updated')} > 0"""
_vu = lambda t: R.velocity_union(t.issues, P)
query("velocity_union", _vu, "SELECT * FROM vu", vu=VU)
query(
    "velocity_by_priority",
    lambda t: R.grains(R.top_semi(_vu(t), "assignee", 25), {"priority": ["assignee", "kind", "priority"], "assignee": ["assignee", "kind"], "kind": ["kind"]}, F.round(F.avg("days"), 6).alias("mean"), F.count("*").alias("n")),
    "SELECT CASE WHEN grouping(assignee) = 1 THEN 'kind' WHEN grouping(priority) = 1 THEN 'assignee' ELSE 'priority' END AS grain, assignee, kind, priority, round(avg(days), 6) AS mean, count(*) AS n FROM vu GROUP BY GROUPING SETS ((assignee, kind, priority), (assignee, kind), (kind))",
    vu=VU,
)
VP = "SELECT coalesce(a.assignee, b.assignee) AS assignee, backlog, execution FROM (SELECT assignee, round(avg(days), 6) AS backlog FROM vu WHERE kind = 'backlog' GROUP BY 1) a FULL JOIN (SELECT assignee, round(avg(days), 6) AS execution FROM vu WHERE kind = 'execution' GROUP BY 1) b ON a.assignee = b.assignee"
query("velocity_pair_outer", lambda t: R.velocity_pair(_vu(t)), "SELECT * FROM vp", vu=VU, vp=VP)
query(
    "complete_grid",
    lambda t: R.complete_grid(_vu(t)),
    "SELECT a.assignee, k.kind, p.priority, round(coalesce(m.mean, (SELECT avg(days) FROM vu)), 6) AS mean FROM (SELECT DISTINCT assignee FROM vu) a CROSS JOIN (VALUES ('backlog'), ('execution')) k(kind) CROSS JOIN (SELECT DISTINCT priority FROM vu) p LEFT JOIN (SELECT assignee, kind, priority, avg(days) AS mean FROM vu GROUP BY 1, 2, 3) m ON m.assignee = a.assignee AND m.kind = k.kind AND m.priority = p.priority",
    vu=VU,
)
_days = days("planned_start_date", "updated")
EP = f"SELECT coalesce(assignee_name, 'Unassigned') AS assignee, {_days} AS x, 1 / (1 + greatest(0.0, {days('updated', NOW)}) / 30.0) AS w FROM w_issues WHERE status = 'Done' AND coalesce(resolved, updated) >= {CUT} AND lower(coalesce(assignee_name, '')) <> 'engineer 10' AND {_days} > 0"
_recent_done = lambda t: R.done_window(t.issues, P)
query(
    "execution_profile",
    lambda t: R.execution_profile(_recent_done(t), P),
    "SELECT * FROM (SELECT assignee, round(quantile_cont(x, 0.5), 6) AS median, round(sum(x * w) / sum(w), 6) AS weighted, count(*) AS n FROM ep GROUP BY 1), (SELECT round(quantile_cont(x, 0.5), 6) AS median_all, round(sum(x * w) / sum(w), 6) AS weighted_all, count(*) AS n_all FROM ep)",
    ep=EP,
)
BUSY = "status = 'In Progress' AND issuetype <> 'Feature' AND lower(coalesce(assignee_name, '')) <> 'engineer 10'"
IL = f"""SELECT *, round(open * velocity, 6) AS estimated_days FROM (SELECT assignee, open, coalesce(m, (SELECT coalesce(round(quantile_cont(x, 0.5), 6), 0.0) FROM ep)) AS velocity FROM (SELECT coalesce(assignee_name, 'Unassigned') AS assignee, count(*) AS open FROM w_issues WHERE {BUSY} GROUP BY 1)
 LEFT JOIN (SELECT assignee AS a, round(quantile_cont(x, 0.5), 6) AS m FROM ep GROUP BY 1) ON a = assignee)"""
LB = "CASE WHEN {x} > 90 THEN 'Critical' WHEN {x} > 60 THEN 'High' WHEN {x} > 30 THEN 'Medium' WHEN {x} > 0 THEN 'Low' ELSE 'None' END"
_load = lambda t: R.in_progress_load(t.issues, _recent_done(t), P)
query("in_progress_load", _load, f"SELECT *, {LB.format(x='estimated_days')} AS bucket FROM il", ep=EP, il=IL)
TOTALS = "SELECT CAST(sum(open) AS BIGINT) AS open, round(sum({e}), 4) AS estimated_days, round(avg({v}), 4) AS mean_velocity, count(*) FILTER ({e} > 90) AS critical FROM {x}"


def in_progress_totals(t):
    missing = R.in_progress(t.issues, P).agg(F.count_if(c("target_end_date").isNull()).alias("missing_targets"))
    return R.load_totals(_load(t), "velocity", "estimated_days").crossJoin(F.broadcast(missing))


query(
    "in_progress_totals",
    in_progress_totals,
    f"SELECT * FROM ({TOTALS.format(e='estimated_days', v='velocity', x='il')}), (SELECT count(*) FILTER (target_end_date IS NULL) AS missing_targets FROM w_issues WHERE {BUSY})",
    ep=EP, il=IL,
)
query("counts_left_velocity", lambda t: _load(t).select("assignee", "estimated_days"), "SELECT assignee, estimated_days FROM il", ep=EP, il=IL)
query(
    "bucket_mix",
    lambda t: R.on_spine(_load(t).groupBy("bucket").agg(F.count("*").alias("n")), ("Critical", "High", "Medium", "Low", "None"), "bucket"),
    f"SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low'), ('None')) b(bucket) LEFT JOIN (SELECT {LB.format(x='estimated_days')} AS bucket, count(*) AS n FROM il GROUP BY 1) x ON x.bucket = b.bucket",
    ep=EP, il=IL,
)
BC = f"""WITH h AS (SELECT i AS k, sum(1.0 / i) OVER (ORDER BY i) AS h FROM range(1, 100001) r(i)), x AS (SELECT coalesce(assignee_name, 'Unassigned') AS assignee, count(*) AS open FROM w_issues WHERE status IN ('Backlog', 'To Do') GROUP BY 1),
 d AS (SELECT coalesce(assignee_name, 'Unassigned') AS assignee, coalesce(priority_name, 'Unknown') AS priority, {floor_days('created', 'planned_start_date')} AS b, {floor_days('created', 'updated')} AS e FROM w_issues
  WHERE status = 'Done' AND coalesce(resolved, updated) >= {CUT} AND lower(coalesce(assignee_name, '')) <> 'engineer 10'),
 u AS (SELECT assignee, priority, 'backlog' AS kind, b AS days FROM d WHERE b > 0 UNION ALL SELECT assignee, priority, 'execution', e FROM d WHERE e > 0),
 g AS (SELECT a.assignee, k.kind, coalesce(m.mean, (SELECT avg(days) FROM u)) AS mean FROM (SELECT DISTINCT assignee FROM u) a CROSS JOIN (VALUES ('backlog'), ('execution')) k(kind) CROSS JOIN (SELECT DISTINCT priority FROM u) p
  LEFT JOIN (SELECT assignee, kind, priority, avg(days) AS mean FROM u GROUP BY 1, 2, 3) m ON m.assignee = a.assignee AND m.kind = k.kind AND m.priority = p.priority),
 q AS (SELECT assignee, avg(mean) FILTER (kind = 'backlog') AS bl, avg(mean) FILTER (kind = 'execution') AS av FROM g GROUP BY 1),
 y AS (SELECT x.assignee, open, coalesce(av, (SELECT coalesce(avg(av), 0) FROM q)) AS av, coalesce(bl, (SELECT coalesce(avg(bl), 0) FROM q)) AS bl FROM x LEFT JOIN q ON q.assignee = x.assignee),
 z AS (SELECT *, round(abs(av - bl), 6) AS complexity FROM y)
 SELECT assignee, open, complexity, round(av * h, 6) AS estimate, {LB.format(x='complexity')} AS bucket FROM z JOIN h ON h.k = z.open"""
_complexity = lambda t: R.backlog_complexity(t.issues, R.done_window_union(t.issues, P))
query("backlog_complexity", _complexity, BC)
query("backlog_totals", lambda t: R.load_totals(_complexity(t), "complexity", "estimate"), TOTALS.format(e="estimate", v="complexity", x="bc"), bc=BC)
RISK = f"SELECT business_lead AS lead, assignee_name AS assignee, status, priority_name, CASE WHEN {LEFT} IS NULL THEN 'No Target Date' WHEN {LEFT} < 0 THEN 'Overdue' WHEN {LEFT} <= 7 THEN 'Due in 7 Days' ELSE 'On Track' END AS risk FROM w_issues"
for _n, _s, _urgent in (("blocked", "Blocked", ("High", "Critical", "Urgent")), ("validating", "Validating", ("Urgent",))):
    query(
        f"{_n}_report",
        lambda t, s=_s, u=_urgent: R.risk_report(t.issues.filter(c("status") == s), P, u),
        f"""SELECT CASE WHEN grouping(lead) = 0 THEN 'lead' WHEN grouping(assignee) = 0 THEN 'assignee' ELSE 'all' END AS grain, lead, assignee, count(*) AS n, count(*) FILTER (risk = 'Overdue') AS overdue, count(*) FILTER (risk = 'Due in 7 Days') AS due_soon,
 count(*) FILTER (priority_name IN ({', '.join(f"'{x}'" for x in _urgent)})) AS urgent FROM rk WHERE status = '{_s}' GROUP BY GROUPING SETS ((), (lead), (assignee))""",
        rk=RISK,
    )
    query(
        f"{_n}_risk_mix",
        lambda t, s=_s: R.risk_mix(t.issues.filter(c("status") == s), P),
        f"SELECT v.risk, count(rk.risk) AS n FROM (VALUES {', '.join(f"('{x}')" for x in R.RISKS)}) v(risk) LEFT JOIN rk ON rk.risk = v.risk AND status = '{_s}' GROUP BY 1",
        rk=RISK,
    )
STALE = f"SELECT *, {AGE} AS age, coalesce(priority_name, 'Unknown') AS priority FROM w_issues WHERE {OPEN} AND {AGE} >= 90"
query(
    "stale_summary",
    lambda t: R.grains(t.issues.filter(R.is_open() & (age() >= 90)).select(F.coalesce("priority_name", F.lit("Unknown")).alias("priority"), age().alias("age")), {"all": [], "priority": ["priority"]}, F.count("*").alias("n"), F.floor(F.avg("age")).alias("mean_age")),
    "SELECT CASE WHEN grouping(priority) = 1 THEN 'all' ELSE 'priority' END AS grain, priority, count(*) AS n, CAST(floor(avg(age)) AS BIGINT) AS mean_age FROM st GROUP BY GROUPING SETS ((), (priority))",
    st=STALE,
)
_in = lambda values: ", ".join(f"'{x}'" for x in values)
query(
    "age_by_status",
    lambda t: R.age_by_status(t.issues, P),
    f"""SELECT *, CASE WHEN median >= 90 THEN 'Critical' WHEN median >= 60 THEN 'Aging' WHEN median >= 30 THEN 'Watch' ELSE 'Healthy' END AS band FROM (SELECT CASE WHEN g = 0 THEN 'status' ELSE 'all' END AS grain, status, n, mean, max, CASE WHEN g = 1 THEN floor(median) ELSE median END AS median, CASE WHEN g = 1 THEN floor(p75) ELSE p75 END AS p75
 FROM (SELECT grouping(status) AS g, status, count(*) AS n, round(avg({AGE}), 6) AS mean, max({AGE}) AS max, quantile_cont(CAST({AGE} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({AGE} AS DOUBLE), 0.75) AS p75 FROM w_issues WHERE status NOT IN ({_in(AGE_EXCLUDED)}) GROUP BY GROUPING SETS ((status), ())) WHERE g = 1 OR status NOT IN ({_in(AGE_EXCLUDED_BY_STATUS)}))""",
)
query("oldest_n", lambda t: t.issues.filter(R.is_open()).select("key", age().alias("age")).orderBy(F.desc_nulls_last("age"), "key").limit(30), f"SELECT key, {AGE} AS age FROM w_issues WHERE {OPEN} ORDER BY 2 DESC, 1 LIMIT 30")
LM = "SELECT CASE WHEN contains(key, 'CAR-') THEN 'Release Lead' ELSE trim(coalesce(business_lead, 'Unassigned')) END AS business_lead, strftime(created, '%Y-%m') AS month, coalesce(priority_name, 'Unknown') AS priority FROM w_issues"
LR = "SELECT lm.* FROM lm, (SELECT max(month) AS top, min(month) AS bottom FROM lm) WHERE month <= top AND month >= greatest(bottom, strftime(CAST(top || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m'))"
_leads = lambda t: month_range(R.lead_months(t.issues, P))
query(
    "lead_month_priority",
    lambda t: R.grains(_leads(t), {"cell": ["business_lead", "month", "priority"], "lead": ["business_lead"], "month": ["month"], "priority": ["priority"]}, F.count("*").alias("n")),
    "SELECT CASE grouping(business_lead, month, priority) WHEN 0 THEN 'cell' WHEN 3 THEN 'lead' WHEN 5 THEN 'month' ELSE 'priority' END AS grain, business_lead, month, priority, count(*) AS n FROM lr GROUP BY GROUPING SETS ((business_lead, month, priority), (business_lead), (month), (priority))",
    lm=LM, lr=LR,
)
_pivot = ", ".join(f"count(*) FILTER (priority = '{x}') AS \"{x}\"" for x in PRIORITIES)
query(
    "pivot_lead_priority",
    lambda t: R.pivot_counts(t.issues.select("business_lead", F.date_format("created", "yyyy-MM").alias("month"), S.canonical_priority(c("priority_name"), "velocity").alias("priority")), ["business_lead", "month"], "priority", PRIORITIES),
    f"SELECT business_lead, month, {_pivot} FROM (SELECT business_lead, strftime(created, '%Y-%m') AS month, {VEL} AS priority FROM w_issues) GROUP BY 1, 2",
)
SZ = f"SELECT key, CASE WHEN status = 'In Progress' THEN 'In Progress' ELSE 'Backlog' END AS \"group\", {VEL} AS priority, CASE WHEN estimated_size_name IN ('Small', 'Medium', 'Large', 'XL') THEN estimated_size_name ELSE 'Unestimated' END AS size FROM w_issues WHERE status IN ('In Progress', 'To Do', 'Tech Discovery Required') AND issuetype <> 'Feature'"
query("group_union", lambda t: R.size_groups(t.issues).select("key", "group"), 'SELECT key, "group" FROM sz', sz=SZ)
query("size_by_group", lambda t: R.size_groups(t.issues).groupBy("group", "size").agg(F.count("*").alias("n")), 'SELECT "group", size, count(*) AS n FROM sz GROUP BY 1, 2', sz=SZ)
query("pivot_size", lambda t: R.pivot_counts(R.size_groups(t.issues), ["group"], "size", SIZES), 'SELECT "group", ' + ", ".join(f"count(*) FILTER (size = '{x}') AS \"{x}\"" for x in SIZES) + " FROM sz GROUP BY 1", sz=SZ)
query(
    "priority_size_matrix",
    lambda t: R.size_matrix(R.size_groups(t.issues)),
    f"SELECT p.priority, s.size, count(sz.key) AS n, p.priority IN ('Urgent', 'High') AND s.size IN ('Large', 'XL') AS at_risk FROM (VALUES {', '.join(f"('{x}')" for x in PRIORITIES)}) p(priority) CROSS JOIN (VALUES ('Small'), ('Medium'), ('Large'), ('XL')) s(size) LEFT JOIN sz ON sz.priority = p.priority AND sz.size = s.size GROUP BY 1, 2",
    sz=SZ,
)
query(
    "crosstab_long",
    lambda t: R.crosstab(t.issues.filter(R.is_open()).select("status", S.canonical_priority(c("priority_name"), "executive").alias("priority")), "status", "priority"),
    f"WITH x AS (SELECT status, {VEL} AS priority FROM w_issues WHERE {OPEN}) SELECT a.status, b.priority, count(x.status) AS n FROM (SELECT DISTINCT status FROM x) a CROSS JOIN (SELECT DISTINCT priority FROM x) b LEFT JOIN x ON x.status = a.status AND x.priority = b.priority GROUP BY 1, 2",
)
query("option_lists", lambda t: t.issues.select(F.lit("priority").alias("list"), c("priority_name").alias("value")).union(t.issues.filter("assignee_name is not null").select(F.lit("assignee"), "assignee_name")).distinct(), "SELECT DISTINCT 'priority' AS list, priority_name AS value FROM w_issues UNION SELECT DISTINCT 'assignee', assignee_name FROM w_issues WHERE assignee_name IS NOT NULL")
NORM = "lower(trim(translate({x}, '_-', '  ')))"
query(
    "personal_kpis",
    lambda t: R.personal_kpis(t.issues, P),
    f"""SELECT assignee_name, count(*) AS total, count(*) FILTER (s <> 'done') AS open, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'in progress') AS in_progress, count(*) FILTER (s = 'on hold') AS on_hold, count(*) FILTER (s = 'blocked') AS blocked,
 count(*) FILTER (s = 'validating') AS validating, count(*) FILTER (s <> 'done' AND {LEFT} < 0) AS overdue, count(*) FILTER (s <> 'done' AND {LEFT} BETWEEN 0 AND 7) AS due_soon, count(*) FILTER (s <> 'done' AND target_end_date IS NULL) AS missing_target,
 count(*) FILTER (s <> 'done' AND p IN ('critical', 'urgent', 'high')) AS high_priority, count(*) FILTER (s = 'triage') AS triage, count(*) FILTER (s = 'tech discovery required') AS tech_discovery, round(avg({AGE}), 6) AS mean_age, max({AGE}) AS max_age
 FROM (SELECT *, {NORM.format(x='status')} AS s, {NORM.format(x='priority_name')} AS p FROM w_issues) WHERE assignee_name IS NOT NULL GROUP BY 1""",
)
query(
    "attention_list",
    lambda t: attention(t.issues).filter("issuetype <> 'Feature' and assignee_name is not null and status <> 'Done'").withColumn("place", F.row_number().over(Window.partitionBy("assignee_name").orderBy("attention_rank", F.asc_nulls_last("days_left"), "priority_rank", F.desc("age"), "key"))).filter("place <= 15").select("assignee_name", "place", "key", "attention"),
    "SELECT assignee_name, CAST(place AS INT) AS place, key, attention FROM (SELECT *, row_number() OVER (PARTITION BY assignee_name ORDER BY attention_rank, days_left NULLS LAST, priority_rank, age DESC, key) AS place FROM att WHERE issuetype <> 'Feature' AND assignee_name IS NOT NULL AND sn <> 'done') WHERE place <= 15",
    att=ATTENTION,
)
query(
    "attention_features",
    lambda t: attention(t.issues).filter((S.normalize_text(c("issuetype")) == "feature") & c("assignee_name").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("assignee_name").orderBy("attention_rank", F.asc_nulls_last("days_left"), "priority_rank", F.desc("age"), "key"))).select("assignee_name", "place", "key", "attention"),
    f"SELECT assignee_name, CAST(row_number() OVER (PARTITION BY assignee_name ORDER BY attention_rank, days_left NULLS LAST, priority_rank, age DESC, key) AS INT) AS place, key, attention FROM att WHERE {NORM.format(x='issuetype')} = 'feature' AND assignee_name IS NOT NULL",
    att=ATTENTION,
)
query(
    "queue_oldest_first",
    lambda t: R.numbered(t.issues.filter(c("status").isin(*QUEUE) & ~c("issuetype").isin("Feature", "Initiative", "Epic")), [F.to_date("created")], ["created", "key"]).select("key", "created", "place"),
    "SELECT key, created, CAST(row_number() OVER (ORDER BY created, key) AS INT) AS place FROM w_issues WHERE status IN ('Triage', 'Reviewing') AND issuetype NOT IN ('Feature', 'Initiative', 'Epic')",
)
query(
    "ticket_detail_lists",
    lambda t: t.issues.filter(c("status").isin("In Progress", "Backlog", "Validating", "Blocked")).select("status", "key", F.substring("summary", 1, 120).alias("summary"), "assignee_name", "priority_name", age().alias("age"), left().alias("days_left")).orderBy("status", F.desc("age"), "key"),
    f"SELECT status, key, left(summary, 120) AS summary, assignee_name, priority_name, {AGE} AS age, {LEFT} AS days_left FROM w_issues WHERE status IN ('In Progress', 'Backlog', 'Validating', 'Blocked')",
)
TR = f"""SELECT key, assignee_name AS assignee, coalesce(priority_name, 'No Priority') AS priority, updated, {floor_days('created', 'updated')} AS cycle, CAST(updated <= target_end_date AS DOUBLE) AS on_time, {floor_days('created', 'target_end_date')} AS budget
 FROM w_issues WHERE lower(trim(status)) = 'done' AND assignee_name IN ({TEAM}) AND target_end_date IS NOT NULL AND updated >= CAST({NOW} AS DATE) - INTERVAL 720 DAY AND {floor_days('created', 'updated')} >= 0 AND {floor_days('created', 'target_end_date')} >= 1"""


def training(t):
    from worklens.operators.ml import training_rows

    return training_rows(t.issues, P, 720)


query("training_rows", lambda t: training(t).select("key", "cycle", "on_time"), "SELECT key, cycle, on_time FROM tr", tr=TR)
query(
    "trimmed_mean",
    lambda t: R.trimmed_mean(training(t), "assignee", "cycle"),
    "SELECT assignee, round(CASE WHEN any_value(n) < 5 THEN any_value(mid) ELSE coalesce(avg(cycle) FILTER (cycle BETWEEN lo AND hi), any_value(mid)) END, 6) AS trimmed FROM (SELECT tr.*, q.* EXCLUDE (a) FROM tr JOIN (SELECT assignee AS a, quantile_cont(cycle, 0.05) AS lo, quantile_cont(cycle, 0.95) AS hi, quantile_cont(cycle, 0.5) AS mid, count(*) AS n FROM tr WHERE assignee IS NOT NULL GROUP BY 1) q ON q.a = tr.assignee) GROUP BY 1",
    tr=TR,
)
SM = "SELECT {by}, round((sum({x}) + {prior} * 8.0) / (count({x}) + 8.0), 6) AS smoothed FROM {tr} WHERE {by} IS NOT NULL GROUP BY 1"
TRIMMED = "(SELECT round(CASE WHEN any_value(n) < 5 THEN any_value(mid) ELSE coalesce(avg({x}) FILTER ({x} BETWEEN lo AND hi), any_value(mid)) END, 6) FROM {tr}, (SELECT quantile_cont({x}, 0.05) AS lo, quantile_cont({x}, 0.95) AS hi, quantile_cont({x}, 0.5) AS mid, count({x}) AS n FROM {tr}))"
_smoothed = lambda rows, by: R.smoothed_mean(rows, by, "cycle", R.trimmed_mean(rows, None, "cycle"))
query("smoothed_group_mean", lambda t: _smoothed(training(t), "assignee"), SM.format(by="assignee", x="cycle", tr="tr", prior=TRIMMED.format(x="cycle", tr="tr")), tr=TR)
query("smoothed_rate", lambda t: R.smoothed_mean(training(t), "priority", "on_time"), SM.format(by="priority", x="on_time", tr="tr", prior="(SELECT avg(on_time) FROM tr)"), tr=TR)
query(
    "leave_one_out",
    lambda t: R.leave_one_out(training(t), "assignee", "on_time").select("key", "loo"),
    "SELECT key, round((sum(on_time) OVER w - on_time + (SELECT avg(on_time) FROM tr) * 8.0) / (greatest(count(on_time) OVER w - 1, 0) + 8.0), 6) AS loo FROM tr WINDOW w AS (PARTITION BY assignee)",
    tr=TR,
)
query("open_backlog_counts", lambda t: t.issues.filter(R.is_open()).groupBy("assignee_name", S.canonical_priority(c("priority_name"), "velocity").alias("priority")).agg(F.count("*").alias("n")), f"SELECT assignee_name, {VEL} AS priority, count(*) AS n FROM w_issues WHERE {OPEN} GROUP BY 1, 2")
query(
    "group_medians",
    lambda t: R.grains(training(t).select("assignee", "priority", "cycle"), {"assignee": ["assignee"], "priority": ["priority"], "all": []}, F.round(F.percentile("cycle", 0.5), 6).alias("median"), F.count("*").alias("n")),
    "SELECT CASE WHEN grouping(assignee) = 0 THEN 'assignee' WHEN grouping(priority) = 0 THEN 'priority' ELSE 'all' END AS grain, assignee, priority, round(quantile_cont(cycle, 0.5), 6) AS median, count(*) AS n FROM tr GROUP BY GROUPING SETS ((assignee), (priority), ())",
    tr=TR,
)
query(
    "group_map_fallback",
    lambda t: training(t).select("key", "assignee", "priority").join(_smoothed(training(t).filter("assignee <> 'Engineer 3'"), "assignee").withColumnRenamed("smoothed", "a"), "assignee", "left").join(_smoothed(training(t), "priority").withColumnRenamed("smoothed", "b"), "priority", "left").select("key", F.coalesce("a", "b").alias("value")),
    "SELECT key, coalesce(a.smoothed, b.smoothed) AS value FROM tr LEFT JOIN (" + SM.format(by="assignee", x="cycle", tr="t3", prior=TRIMMED.format(x="cycle", tr="t3")) + ") a ON a.assignee = tr.assignee LEFT JOIN (" + SM.format(by="priority", x="cycle", tr="tr", prior=TRIMMED.format(x="cycle", tr="tr")) + ") b ON b.priority = tr.priority",
    tr=TR, t3="SELECT * FROM tr WHERE assignee <> 'Engineer 3'",
)
query("on_time_mix", lambda t: R.on_spine(training(t).groupBy(F.when(c("on_time") == 1, "Yes").otherwise("No").alias("on_time")).agg(F.count("*").alias("n")), ("Yes", "No"), "on_time"), "SELECT v.on_time, count(tr.key) AS n FROM (VALUES ('Yes', 1.0), ('No', 0.0)) v(on_time, x) LEFT JOIN tr ON tr.on_time = v.x GROUP BY 1", tr=TR)
_newest = lambda rows, *order: R.numbered(rows, [-F.datediff(c("updated"), F.lit("1970-01-01").cast("date"))], order)
query(
    "rolling_on_time",
    lambda t: R.centred_mean(R.numbered(training(t).select("key", "updated", "on_time"), [F.to_date("updated")], ["updated", "key"]), "place", "on_time").select("key", F.round("rolling", 6).alias("rolling")),
    "SELECT key, round(avg(on_time) OVER (ORDER BY updated, key ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) * 100, 6) AS rolling FROM tr",
    tr=TR,
)
query(
    "time_holdout",
    lambda t: _newest(training(t), F.desc("updated"), F.desc("key")).crossJoin(F.broadcast(training(t).agg(F.count("*").alias("n")))).select("key", (c("place") <= F.least(F.greatest(F.lit(1), F.floor(c("n") * 0.2)), F.greatest(F.lit(0), c("n") - 10))).alias("held_out")),
    "SELECT key, row_number() OVER (ORDER BY updated DESC, key DESC) <= least(greatest(1, floor(n * 0.2)), greatest(0, n - 10)) AS held_out FROM tr, (SELECT count(*) AS n FROM tr)",
    tr=TR,
)
DT = f"SELECT key, coalesce(assignee_name, 'Unassigned') AS assignee, coalesce(priority_name, 'No Priority') AS priority, updated, target_end_date, greatest(0.0, {days('target_end_date', 'updated')}) AS late FROM w_issues WHERE lower(trim(status)) = 'done' AND target_end_date IS NOT NULL AND updated IS NOT NULL"


def training_detail(t):
    from worklens.operators.ml import training_detail as detail

    return _newest(detail(t.issues), c("key")).select("key", "assignee", "priority", "past_due", F.round("offset", 1).alias("offset"), "on_time", "place")


query(
    "training_detail",
    training_detail,
    f"""SELECT key, assignee, priority, CAST(CAST(updated AS DATE) - CAST(target_end_date AS DATE) AS INT) AS past_due, round(o, 1) AS "offset", CASE WHEN CAST(make_timestamp(CAST(epoch_us(updated) - round(o * 86400000000) AS BIGINT)) AS DATE) <= CAST(target_end_date AS DATE) THEN 'Yes' ELSE 'No' END AS on_time,
 CAST(row_number() OVER (ORDER BY CAST(updated AS DATE) DESC, key) AS INT) AS place FROM dt, (SELECT {TRIMMED.format(x='late', tr='dt')} AS o)""",
    dt=DT,
)
_mw = lambda: Window.orderBy("month")
_guard = lambda f, lo, hi: F.when(F.count("*").over(_mw().rowsBetween(lo, hi)) == hi - lo + 1, F.round(f("completed").over(_mw().rowsBetween(lo, hi)).cast("double"), 6))
query("lag_features", lambda t: _flow(t).select("month", *[F.lag("completed", k).over(_mw()).alias(f"lag{k}") for k in (1, 2, 3)]).filter("lag3 is not null"), "SELECT * FROM (SELECT month, lag(completed, 1) OVER w AS lag1, lag(completed, 2) OVER w AS lag2, lag(completed, 3) OVER w AS lag3 FROM mf WINDOW w AS (ORDER BY month)) WHERE lag3 IS NOT NULL", cv=CV, sp=SP, mf=MF)
_g = lambda f, lo, hi, n: f"CASE WHEN count(*) OVER (ORDER BY month ROWS BETWEEN {lo} PRECEDING AND {hi}) = 3 THEN round(CAST({f}(completed) OVER (ORDER BY month ROWS BETWEEN {lo} PRECEDING AND {hi}) AS DOUBLE), 6) END AS {n}"
query("rolling_minmax", lambda t: _flow(t).select("month", _guard(F.max, -2, 0).alias("high"), _guard(F.min, -2, 0).alias("low")), f"SELECT month, {_g('max', 2, 'CURRENT ROW', 'high')}, {_g('min', 2, 'CURRENT ROW', 'low')} FROM mf", cv=CV, sp=SP, mf=MF)
query("rolling_mean_std_shifted", lambda t: _flow(t).select("month", _guard(F.avg, -3, -1).alias("mean"), _guard(F.stddev_samp, -3, -1).alias("sd")), f"SELECT month, {_g('avg', 3, '1 PRECEDING', 'mean')}, {_g('stddev_samp', 3, '1 PRECEDING', 'sd')} FROM mf", cv=CV, sp=SP, mf=MF)
query("seasonal_features", lambda t: _flow(t).select("month", *[(F.round(f(F.lit(2 * 3.141592653589793) * F.substring("month", 6, 2).cast("int") / 12), 6) + 0.0).alias(n) for n, f in (("sine", F.sin), ("cosine", F.cos))], (F.row_number().over(_mw()) - 1).alias("trend")), "SELECT month, round(sin(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS sine, round(cos(2 * pi() * CAST(substr(month, 6, 2) AS INT) / 12), 6) + 0.0 AS cosine, CAST(row_number() OVER (ORDER BY month) - 1 AS INT) AS trend FROM mf", cv=CV, sp=SP, mf=MF)
