"""Projections, predicates and CASE classifications, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens.functions import scalars as S
from worklens.functions import params
from worklens.functions.params import DEFAULT as P, EXCLUDED_STATUSES, PRIORITY_MAP, SIZES
from worklens.plans.registry import NOW, days, floor_days, query

c = F.col
# Fixed values of the reports, stated again for the SQL.
EXCLUDED_SQL = "'Technical Debt', 'Done', 'Backlog', 'Plan Release', 'Prepare Release', 'Will Not Do', 'Blocked For Development', 'Resource Constrained', 'Released Successfully to Production', '❌ Rolled Back'"
SLA_SQL = "'in progress', 'on hold', 'blocked', 'to do', 'validating', 'tech discovery required'"
size_sql = ", ".join(f"'{s}'" for s in SIZES[:4])

query(
    "local_time",
    lambda t: t.issues.select("key", *[S.to_zone(c(x), P.local_offset).alias(x + "_local") for x in ("created", "updated", "resolved")]),
    "SELECT key, created - INTERVAL 6 HOUR AS created_local, updated - INTERVAL 6 HOUR AS updated_local, resolved - INTERVAL 6 HOUR AS resolved_local FROM w_issues",
)
query("effective_updated", lambda t: t.issues.select("key", F.coalesce("resolved", "updated").alias("effective_updated")), "SELECT key, coalesce(resolved, updated) AS effective_updated FROM w_issues")
query(
    "age_days",
    lambda t: t.issues.select("key", S.age_days(c("created"), P).alias("days_old"), S.age_days(c("updated"), P).alias("last_updated_days")),
    f"SELECT key, greatest(0, {floor_days('created', NOW)}) AS days_old, greatest(0, {floor_days('updated', NOW)}) AS last_updated_days FROM w_issues",
)
query("due_gap_days", lambda t: t.issues.select("key", S.floor_days(c("updated"), c("target_end_date")).alias("due_gap_days")), f"SELECT key, {floor_days('updated', 'target_end_date')} AS due_gap_days FROM w_issues")
query(
    "execution_velocity",
    lambda t: t.issues.select("key", S.floor_days(c("created"), c("updated")).alias("velocity"), F.round(S.days_between(c("created"), c("updated")) * 24, 6).alias("velocity_hours")),
    f"SELECT key, {floor_days('created', 'updated')} AS velocity, round({days('created', 'updated')} * 24, 6) AS velocity_hours FROM w_issues",
)
query(
    "backlog_velocity",
    lambda t: t.issues.select("key", F.when(c("planned_start_date").isNotNull(), F.greatest(F.lit(0).cast("long"), S.floor_days(c("created"), c("planned_start_date")))).alias("velocity_backlog_days")),
    f"SELECT key, CASE WHEN planned_start_date IS NOT NULL THEN greatest(0, {floor_days('created', 'planned_start_date')}) END AS velocity_backlog_days FROM w_issues",
)
query(
    "calendar_parts",
    lambda t: t.issues.select("key", *[f(x).alias(f"{n}_{x}") for x in ("created", "updated", "resolved") for n, f in (("year", F.year), ("month", F.month))]),
    "SELECT key, " + ", ".join(f"CAST({n}({x}) AS INT) AS {n}_{x}" for x in ("created", "updated", "resolved") for n in ("year", "month")) + " FROM w_issues",
)
query(
    "size_ordinal",
    lambda t: t.issues.select("key", S.size_ordinal(c("estimated_size_name")).alias("size_number")),
    "SELECT key, CAST(CASE estimated_size_name WHEN 'Small' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Large' THEN 3 WHEN 'XL' THEN 4 ELSE 0 END AS INT) AS size_number FROM w_issues",
)
query(
    "default_labels",
    lambda t: t.issues.select(
        "key", F.coalesce("assignee_name", F.lit("Unassigned")).alias("assignee"), F.coalesce("creator_name", F.lit("Unknown")).alias("creator"),
        F.coalesce(F.nullif("priority_name", F.lit("No Priority")), F.lit("None")).alias("priority"), F.replace(F.coalesce("business_lead", F.lit("No Lead")), F.lit("."), F.lit(" ")).alias("lead"),
    ),
    "SELECT key, coalesce(assignee_name, 'Unassigned') AS assignee, coalesce(creator_name, 'Unknown') AS creator, coalesce(nullif(priority_name, 'No Priority'), 'None') AS priority, replace(coalesce(business_lead, 'No Lead'), '.', ' ') AS lead FROM w_issues",
)
_values = ", ".join(f"('{p}', '{r}', '{x}')" for p, r, x in PRIORITY_MAP)
query(
    "canonical_priority",
    lambda t: t.issues.select("key", *[S.canonical_priority(c("priority_name"), p).alias(p) for p in ("sla", "velocity", "executive")]),
    f"WITH m(profile, raw, canonical) AS (VALUES {_values}) SELECT key, "
    + ", ".join(f"coalesce((SELECT max(canonical) FROM m WHERE profile = '{p}' AND raw = lower(trim(priority_name))), 'None') AS {p}" for p in ("sla", "velocity", "executive"))
    + " FROM w_issues",
)
_spelled = ("Highest", " critical ", "URGENT", "Blocker", "P1", "prio 1", "High", "p2", "Prio2", "medium", "P 3", "prio3", "Low", "p4", "PRIO4", "lowest", "Normal", "No Priority", "")
_spelling = "CASE " + " ".join(f"WHEN id % {len(_spelled) + 1} = {k} THEN '{x}'" for k, x in enumerate(_spelled)) + " END"
query(
    "canonical_priority_spellings",
    lambda t: t.issues.select("key", F.expr(_spelling).alias("raw")).select("key", "raw", *[S.canonical_priority(c("raw"), p).alias(p) for p in ("sla", "velocity", "executive")]),
    f"""SELECT key, raw,
 CASE WHEN replace(x, ' ', '') IN ('highest', 'critical', 'urgent', 'blocker', 'p1', 'prio1') THEN 'Urgent' WHEN replace(x, ' ', '') IN ('high', 'p2', 'prio2') THEN 'High' WHEN replace(x, ' ', '') IN ('medium', 'p3', 'prio3') THEN 'Medium'
  WHEN replace(x, ' ', '') IN ('low', 'p4', 'prio4') THEN 'Low' ELSE 'None' END AS sla,
 CASE WHEN x IN ('urgent', 'highest', 'critical') THEN 'Urgent' WHEN x = 'high' THEN 'High' WHEN x = 'medium' THEN 'Medium' WHEN x = 'low' THEN 'Low' ELSE 'None' END AS velocity,
 CASE WHEN x IN ('urgent', 'highest') THEN 'Urgent' WHEN x = 'high' THEN 'High' WHEN x = 'medium' THEN 'Medium' WHEN x = 'low' THEN 'Low' ELSE 'None' END AS executive
 FROM (SELECT *, lower(trim(raw)) AS x FROM (SELECT key, {_spelling} AS raw FROM w_issues))""",
)
query(
    "normalize_size",
    lambda t: t.issues.select("key", S.normalize_size(c("estimated_size_name")).alias("size")),
    f"SELECT key, CASE WHEN trim(estimated_size_name) IN ({size_sql}) THEN trim(estimated_size_name) ELSE 'Unestimated' END AS size FROM w_issues",
)
query("normalize_text", lambda t: t.issues.select("key", S.normalize_text(c("issuetype")).alias("text")), "SELECT key, lower(trim(translate(issuetype, '_-', '  '))) AS text FROM w_issues")
query("normalize_label", lambda t: t.issues.select("key", S.normalize_label(c("assignee_name"), "Unassigned").alias("label")), "SELECT key, coalesce(nullif(trim(assignee_name), ''), 'Unassigned') AS label FROM w_issues")
query(
    "resolve_column",
    lambda t: t.issues.select("key", c(S.resolve_column(t.issues, ["Target End", "target_end"])).alias("target")),
    "SELECT key, target_end_date AS target FROM w_issues",
)
query(
    "month_label",
    lambda t: t.issues.select("key", S.month_label(F.lit(None).cast("string"), F.year("resolved"), F.month("resolved"), c("created")).alias("month")),
    "SELECT key, strftime(coalesce(resolved, created), '%Y-%m') AS month FROM w_issues",
)
query(
    "business_month",
    lambda t: t.issues.select("key", S.business_month(c("created"), P).alias("month")),
    f"SELECT key, strftime((created AT TIME ZONE 'UTC') AT TIME ZONE '{P.business_tz}', '%Y-%m') AS month FROM w_issues",
)
query("days_left", lambda t: t.issues.select("key", S.days_left(c("target_end_date"), P).alias("days_left")), f"SELECT key, CAST(CAST(target_end_date AS DATE) - CAST({NOW} AS DATE) AS INT) AS days_left FROM w_issues")
query(
    "ticket_link",
    lambda t: t.issues.select("key", F.concat(F.lit(P.base_url), "key").alias("link"), *[F.substring("summary", 1, n).alias(f"summary_{n}") for n in (120, 160, 180)]),
    f"SELECT key, '{P.base_url}' || key AS link, left(summary, 120) AS summary_120, left(summary, 160) AS summary_160, left(summary, 180) AS summary_180 FROM w_issues",
)


def sla_rows(t):
    """Elapsed days, target days and risk of every issue."""
    priority = S.canonical_priority(c("priority_name"), "sla")
    elapsed = S.days_between(c("created"), F.coalesce(c("resolved"), P.now()))
    rows = t.issues.select("*", priority.alias("priority"), elapsed.alias("elapsed"), S.days_between(c("created"), c("target_end_date")).alias("own_target"))
    closed = S.is_closed(c("status"), c("resolved"))
    rows = rows.withColumn("target", S.sla_target(c("own_target"), c("priority"))).withColumn("risk", S.risk_score(c("elapsed"), c("target"), closed))
    return rows.withColumn("sla_status", S.sla_status(c("elapsed"), c("target"), closed))


_pri = "CASE lower(trim(priority_name)) WHEN 'urgent' THEN 'Urgent' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'None' END"
_own = days("created", "target_end_date")
_closed = "(resolved IS NOT NULL OR lower(status) IN (" + ", ".join(f"'{x}'" for x in params.CLOSED_STATUSES) + "))"
SLA = f"""
SELECT *, CASE WHEN {_closed} THEN CASE WHEN elapsed > target THEN 1.0 ELSE 0.0 END ELSE 1 / (1 + exp(-(elapsed / target - 0.82) * 10)) END AS risk,
 CASE WHEN elapsed > target THEN 'Breached' WHEN NOT {_closed} AND elapsed >= 0.8 * target THEN 'At Risk' ELSE 'On Track' END AS sla_status
FROM (SELECT *, {_pri} AS priority, {days('created', f'coalesce(resolved, {NOW})')} AS elapsed,
 CASE WHEN {_own} > 0 THEN {_own} ELSE CASE {_pri} WHEN 'Urgent' THEN 90.0 WHEN 'High' THEN 90.0 WHEN 'Medium' THEN 90.0 WHEN 'Low' THEN 90.0 ELSE 90.0 END END AS target FROM w_issues)"""
query(
    "elapsed_target_days",
    lambda t: sla_rows(t).select("key", F.round("elapsed", 6).alias("elapsed"), F.round("target", 6).alias("target")),
    "SELECT key, round(elapsed, 6) AS elapsed, round(target, 6) AS target FROM sla",
    sla=SLA,
)
query("risk_score", lambda t: sla_rows(t).select("key", F.round("risk", 6).alias("risk")), "SELECT key, round(risk, 6) AS risk FROM sla", sla=SLA)
query("sla_status", lambda t: sla_rows(t).select("key", "sla_status"), "SELECT key, sla_status FROM sla", sla=SLA)
_late = days("target_end_date", "updated")
query(
    "schedule_adherence",
    lambda t: t.issues.select("key", F.round(S.schedule_adherence(S.days_between(c("target_end_date"), c("updated"))), 6).alias("adherence")),
    f"SELECT key, CASE WHEN target_end_date IS NULL THEN NULL WHEN {_late} <= 0 THEN 1.0 ELSE round(greatest(0.0, 1 - {_late} / 7), 6) END AS adherence FROM w_issues",
)
query(
    "recency_weight",
    lambda t: t.issues.select("key", F.round(S.recency_weight(S.days_between(c("updated"), P.now())), 6).alias("weight")),
    f"SELECT key, round(1 / (1 + {days('updated', NOW)} / 30.0), 6) AS weight FROM w_issues",
)
query(
    "harmonic_estimate",
    lambda t: t.issues.select("key", F.round(S.harmonic_estimate(F.lit(6.0), c("id") % 400), 6).alias("estimate")),
    "WITH h AS (SELECT i AS n, sum(1.0 / i) OVER (ORDER BY i) AS h FROM range(1, 401) r(i)) SELECT key, round(6.0 * coalesce(h, 0), 6) AS estimate FROM w_issues LEFT JOIN h ON h.n = id % 400",
)
query(
    "business_days_elapsed",
    lambda t: t.issues.select("key", F.round(S.business_days_elapsed(F.to_date("created")), 6).alias("share")),
    """WITH d AS (SELECT CAST(d AS DATE) AS day FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) r(d)),
 w AS (SELECT day, sum(CASE WHEN isodow(day) < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS upto,
  sum(CASE WHEN isodow(day) < 6 THEN 1 ELSE 0 END) OVER (PARTITION BY date_trunc('month', day)) AS total FROM d)
 SELECT key, round(CAST(upto AS DOUBLE) / total, 6) AS share FROM w_issues JOIN w ON w.day = CAST(created AS DATE)""",
)
query(
    "roster_key",
    lambda t: t.issues.select("key", F.when(c("assignee_name").isin(*P.team), F.lower("assignee_name")).otherwise(F.concat(F.lit("ext:"), F.lower("assignee_name"))).alias("owner")),
    "SELECT key, CASE WHEN assignee_name IN (" + ", ".join(f"'{x}'" for x in P.team) + ") THEN lower(assignee_name) ELSE 'ext:' || lower(assignee_name) END AS owner FROM w_issues",
)
query(
    "date_features",
    lambda t: t.issues.select("key", F.month("created").alias("month"), F.weekday("created").alias("day_of_week"), F.when(F.weekday("created") >= 5, 1).otherwise(0).alias("is_weekend")),
    "SELECT key, CAST(month(created) AS INT) AS month, CAST(isodow(created) - 1 AS INT) AS day_of_week, CAST(CASE WHEN isodow(created) >= 6 THEN 1 ELSE 0 END AS INT) AS is_weekend FROM w_issues",
)
_gap = "CAST(CAST(target_end_date AS DATE) - CAST(updated AS DATE) AS INT)"
query(
    "clip_display",
    lambda t: t.issues.select("key", F.greatest(F.lit(-60), F.least(F.lit(60), F.datediff("target_end_date", "updated"))).alias("shown"), (F.abs(F.datediff("target_end_date", "updated")) > 60).alias("clamped")).filter("shown is not null and clamped is not null"),
    f"SELECT key, greatest(-60, least(60, {_gap})) AS shown, abs({_gap}) > 60 AS clamped FROM w_issues WHERE target_end_date IS NOT NULL",
)

_open = lambda: ~F.coalesce(c("status").isin(*EXCLUDED_STATUSES), F.lit(False))
OPEN = f"coalesce(status NOT IN ({EXCLUDED_SQL}), true)"
query("open_filter", lambda t: t.issues.filter(_open()).select("key", "status"), f"SELECT key, status FROM w_issues WHERE {OPEN}")
_age = f"greatest(0, {floor_days('created', NOW)})"
query(
    "stale_tickets",
    lambda t: t.issues.filter(_open()).select("key", S.age_days(c("created"), P).alias("age")).filter(c("age") >= P.window_days),
    f"SELECT key, {_age} AS age FROM w_issues WHERE {OPEN} AND {_age} >= 90",
)


def in_window(col_name: str):
    return c(col_name) >= P.cutoff()


CUT = f"(CAST({NOW} AS DATE) - INTERVAL 90 DAY)"
IN_SCOPE = f"""NOT starts_with(key, 'CAR-') AND lower(status) IN ({SLA_SQL})
 AND (created >= {CUT} OR resolved >= {CUT})"""


def sla_scope(rows):
    keep = ~c("key").startswith(P.change_project + "-") & F.lower("status").isin(*params.SLA_STATUSES)
    return rows.filter(keep & (in_window("created") | F.coalesce(in_window("resolved"), F.lit(False))))


query("sla_scope", lambda t: sla_scope(t.issues).select("key", "status", "created"), f"SELECT key, status, created FROM w_issues WHERE {IN_SCOPE}")
query(
    "done_window",
    lambda t: t.issues.filter("status = 'Done'").select("key", F.coalesce(in_window("resolved"), F.lit(True)).alias("kept_nulls"), F.coalesce(in_window("resolved"), F.lit(False)).alias("dropped_nulls")),
    f"SELECT key, coalesce(resolved >= {CUT}, true) AS kept_nulls, coalesce(resolved >= {CUT}, false) AS dropped_nulls FROM w_issues WHERE status = 'Done'",
)


def month_range(rows, first=None, last=None, months: int = 3):
    """Rows whose ``month`` lies in the range; by default the last months that exist. Bounds swap if reversed."""
    bounds = rows.filter(c("month").rlike(r"^\d{4}-\d{2}$")).agg(F.max("month").alias("top"), F.min("month").alias("bottom"))
    top = F.lit(last) if last else c("top")
    low = F.lit(first) if first else F.greatest(c("bottom"), F.date_format(F.add_months(F.to_date(F.concat("top", F.lit("-01"))), 1 - months), "yyyy-MM"))
    limits = bounds.select(F.least(low, top).alias("low"), F.greatest(low, top).alias("high"))
    return rows.crossJoin(F.broadcast(limits)).filter(c("month").between(c("low"), c("high"))).drop("low", "high")


query(
    "month_range",
    lambda t: month_range(t.texts).select("doc_id", "month"),
    """WITH b AS (SELECT max(month) AS top, min(month) AS bottom FROM w_texts)
 SELECT doc_id, month FROM w_texts, b WHERE month <= top AND month >= greatest(bottom, strftime(CAST(top || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m'))""",
)
query(
    "team_filter",
    lambda t: t.issues.filter(F.lower("assignee_name").isin(*[x.lower() for x in P.team])).select("key", "assignee_name"),
    "SELECT key, assignee_name FROM w_issues WHERE lower(assignee_name) IN (" + ", ".join(f"'{x.lower()}'" for x in P.team) + ")",
)
query(
    "exclude_assignees",
    lambda t: t.issues.filter(~F.lower(F.coalesce("assignee_name", F.lit(""))).isin(*[x.lower() for x in P.excluded])).select("key", "assignee_name"),
    "SELECT key, assignee_name FROM w_issues WHERE lower(coalesce(assignee_name, '')) <> 'engineer 10'",
)
for _name, _fn, _cases in (
    ("due_risk_bucket", S.due_risk_bucket, "WHEN x IS NULL THEN 'No Target Date' WHEN x < 0 THEN 'Overdue' WHEN x <= 7 THEN 'Due in 7 Days' ELSE 'On Track'"),
    ("target_timeline_bucket", S.target_timeline_bucket, "WHEN x IS NULL THEN 'No Target Date' WHEN x < 0 THEN 'Overdue' WHEN x <= 14 THEN 'Due in 14 Days' WHEN x <= 30 THEN 'Due in 30 Days' ELSE 'Due Later'"),
):
    query(_name, lambda t, f=_fn: t.issues.select("key", f(S.days_left(c("target_end_date"), P)).alias("bucket")), f"SELECT key, CASE {_cases} END AS bucket FROM (SELECT key, CAST(CAST(target_end_date AS DATE) - CAST({NOW} AS DATE) AS INT) AS x FROM w_issues)")
for _name, _fn, _cases in (
    ("load_bucket", S.load_bucket, "WHEN x > 90 THEN 'Critical' WHEN x > 60 THEN 'High' WHEN x > 30 THEN 'Medium' WHEN x > 0 THEN 'Low' ELSE 'None'"),
    ("age_risk_band", S.age_risk_band, "WHEN x >= 90 THEN 'Critical' WHEN x >= 60 THEN 'Aging' WHEN x >= 30 THEN 'Watch' ELSE 'Healthy'"),
    ("lead_bucket", S.lead_bucket, "WHEN x <= 3 THEN '0-3' WHEN x <= 7 THEN '4-7' WHEN x <= 14 THEN '8-14' WHEN x <= 30 THEN '15-30' WHEN x <= 60 THEN '31-60' WHEN x <= 90 THEN '61-90' ELSE '91+'"),
):
    query(_name, lambda t, f=_fn: t.issues.select("key", f(S.floor_days(c("created"), c("updated"))).alias("bucket")), f"SELECT key, CASE {_cases} END AS bucket FROM (SELECT key, {floor_days('created', 'updated')} AS x FROM w_issues)")
query(
    "past_due_tolerance",
    lambda t: t.issues.filter("status = 'Done' and target_end_date is not null").groupBy(F.when(F.datediff("updated", "target_end_date") <= 3, "On Time").otherwise("Late").alias("bucket")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN CAST(CAST(updated AS DATE) - CAST(target_end_date AS DATE) AS INT) <= 3 THEN 'On Time' ELSE 'Late' END AS bucket, count(*) AS n FROM w_issues WHERE status = 'Done' AND target_end_date IS NOT NULL GROUP BY 1",
)


def age_histogram(t, bins: int = 20):
    """Open issues in ``bins`` parts of equal width from the least to the greatest age; the greatest is in the last."""
    ages = t.issues.filter(_open()).select(S.age_days(c("created"), P).alias("age"))
    ends = ages.agg(F.min("age").alias("low"), F.max("age").alias("high"))
    bin_ = F.when(c("low") == c("high"), 1).otherwise(F.least(F.lit(bins).cast("long"), F.floor((c("age") - c("low")) * bins / (c("high") - c("low"))) + 1)).cast("long")
    return ages.crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


query(
    "age_histogram",
    age_histogram,
    f"SELECT CASE WHEN lo = hi THEN 1 ELSE least(20, CAST(floor((a - lo) * 20 / CAST(hi - lo AS DOUBLE)) AS BIGINT) + 1) END AS bin, count(*) AS n FROM (SELECT {_age} AS a, min({_age}) OVER () AS lo, max({_age}) OVER () AS hi FROM w_issues WHERE {OPEN}) GROUP BY 1",
)
query(
    "override_group_fix",
    lambda t: t.issues.select("key", F.when(c("key").contains(P.change_project + "-"), P.change_lead).otherwise(c("business_lead")).alias("lead")),
    "SELECT key, CASE WHEN contains(key, 'CAR-') THEN 'Release Lead' ELSE business_lead END AS lead FROM w_issues",
)


def attention(rows):
    """First matching rule, and its rank, of every issue; an issue that no rule fits shows its status."""
    left, status, priority = S.days_left(c("target_end_date"), P), S.normalize_text(c("status")), S.normalize_text(c("priority_name"))
    is_open = status != "done"
    fits = {
        "Blocked": status == "blocked", "On Hold": status == "on hold", "Validating": status == "validating", "Overdue": is_open & (left < 0), "Due Soon": is_open & left.between(0, 7),
        "Missing Target": is_open & c("target_end_date").isNull(), "High Priority": is_open & priority.isin("critical", "urgent", "high"), "In Progress": status == "in progress", "Done": status == "done",
    }
    label, rank = c("status"), F.lit(params.ATTENTION_OTHER)
    for name, n in reversed(params.ATTENTION):
        label, rank = F.when(fits[name], name).otherwise(label), F.when(fits[name], n).otherwise(rank)
    order = S.rank_in(priority, params.ATTENTION_PRIORITIES)
    return rows.select("*", left.alias("days_left"), S.age_days(c("created"), P).alias("age"), order.alias("priority_rank"), label.alias("attention"), rank.alias("attention_rank"))


ATTENTION = f"""
SELECT *, CASE attention WHEN 'Blocked' THEN 0 WHEN 'On Hold' THEN 1 WHEN 'Validating' THEN 2 WHEN 'Overdue' THEN 3 WHEN 'Due Soon' THEN 4 WHEN 'Missing Target' THEN 5 WHEN 'High Priority' THEN 6 WHEN 'In Progress' THEN 7 WHEN 'Done' THEN 9 ELSE 8 END AS attention_rank,
 CASE pn WHEN 'critical' THEN 1 WHEN 'urgent' THEN 2 WHEN 'high' THEN 3 WHEN 'medium' THEN 4 WHEN 'low' THEN 5 WHEN 'no priority' THEN 6 ELSE 7 END AS priority_rank
FROM (SELECT *, CASE WHEN sn = 'blocked' THEN 'Blocked' WHEN sn = 'on hold' THEN 'On Hold' WHEN sn = 'validating' THEN 'Validating' WHEN sn <> 'done' AND days_left < 0 THEN 'Overdue' WHEN sn <> 'done' AND days_left BETWEEN 0 AND 7 THEN 'Due Soon'
 WHEN sn <> 'done' AND target_end_date IS NULL THEN 'Missing Target' WHEN sn <> 'done' AND pn IN ('critical', 'urgent', 'high') THEN 'High Priority' WHEN sn = 'in progress' THEN 'In Progress' WHEN sn = 'done' THEN 'Done' ELSE status END AS attention
 FROM (SELECT *, CAST(CAST(target_end_date AS DATE) - CAST({NOW} AS DATE) AS INT) AS days_left, {_age} AS age, lower(trim(translate(status, '_-', '  '))) AS sn, lower(trim(translate(priority_name, '_-', '  '))) AS pn FROM w_issues))"""
query(
    "attention_label",
    lambda t: attention(t.issues).select("key", "attention", c("attention_rank").cast("int").alias("attention_rank")),
    "SELECT key, attention, CAST(attention_rank AS INT) AS attention_rank FROM att",
    att=ATTENTION,
)
