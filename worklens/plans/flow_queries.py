"""Queries on the status-change log and the issue hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import ACTIVE, DEFAULT as P, DELIVERY_TYPES, WIP
from worklens.operators import flow, reports as R
from worklens.plans.registry import NOW, days, query

c = F.col
active_sql, types_sql, wip_sql = (", ".join(f"'{s}'" for s in x) for x in (ACTIVE, DELIVERY_TYPES, WIP))
closed = lambda: c("status_category") == "done"
TYPES = "issuetype IN ('Story', 'Task', 'Bug', 'Hotfix', 'Sub-task')"
ROSTER = "SELECT 'Engineer ' || i AS name FROM range(0, 10) r(i)"
DONE = "SELECT i.key, i.assignee_name AS assignee, min(t.changed_at) AS done_at FROM w_issues i JOIN w_transitions t ON t.key = i.key AND t.to_status = 'Done' WHERE i.issuetype IN ('Story', 'Task', 'Bug', 'Hotfix', 'Sub-task') GROUP BY 1, 2"
LC = f"""
SELECT key, greatest(1, CAST(round_even(active, 0) AS BIGINT)) AS cycle, CAST(round_even(greatest(0.0, {days('created', 'done_at')}), 0) AS BIGINT) AS lead, done_at FROM (
 SELECT key, any_value(created) AS created, sum(CASE WHEN before IN ({active_sql}) THEN greatest(0.0, {days('since', 'changed_at')}) ELSE 0 END) AS active, max(changed_at) FILTER (to_status = 'Done') AS done_at FROM (
  SELECT t.key, i.created, t.to_status, t.changed_at, lag(to_status, 1, 'To Do') OVER w AS before, coalesce(lag(changed_at) OVER w, i.created) AS since
  FROM w_transitions t JOIN w_issues i ON i.key = t.key WINDOW w AS (PARTITION BY t.key ORDER BY t.seq)) GROUP BY key) WHERE done_at IS NOT NULL"""
BM = f"strftime((done_at AT TIME ZONE 'UTC') AT TIME ZONE '{P.business_tz}', '%Y-%m')"
LT = f"SELECT s.key, s.parent_key, f.summary AS feature, cycle, lead, done_at, {BM} AS month FROM lc JOIN w_issues s ON s.key = lc.key JOIN w_issues f ON f.key = s.parent_key AND f.issuetype = 'Feature' WHERE s.{TYPES} AND {BM} BETWEEN '2001-03' AND '2001-08'"


def report(t):
    return flow.lead_time_report(t.issues, t.transitions, P)


query("completions", lambda t: flow.completions(t.issues, t.transitions), "SELECT * FROM dn", dn=DONE)
query(
    "stories_of_features",
    lambda t: flow.stories_of_features(t.issues).select("key", "parent_key", "feature"),
    f"SELECT s.key, s.parent_key, f.summary AS feature FROM w_issues s JOIN w_issues f ON f.key = s.parent_key AND f.issuetype = 'Feature' WHERE s.{TYPES}",
)
query("has_done", lambda t: flow.has_done(t.issues, t.transitions).select("key"), "SELECT key FROM w_issues i WHERE EXISTS (SELECT 1 FROM w_transitions t WHERE t.key = i.key AND t.to_status = 'Done')")
query("lead_cycle_time", lambda t: flow.lead_cycle(t.issues, t.transitions), "SELECT * FROM lc", lc=LC)
query("lead_time_report", lambda t: report(t).select("key", "parent_key", "feature", "cycle", "lead", "month"), "SELECT key, parent_key, feature, cycle, lead, month FROM lt", lc=LC, lt=LT)
MEDIAN = "CASE WHEN count(*) % 2 = 1 THEN (list_sort(list({x})))[CAST(count(*) // 2 + 1 AS INT)] ELSE CAST(floor(((list_sort(list({x})))[CAST(count(*) // 2 AS INT)] + (list_sort(list({x})))[CAST(count(*) // 2 + 1 AS INT)]) / 2.0 + 0.5) AS BIGINT) END"
query(
    "lead_by_feature",
    lambda t: flow.lead_by_feature(report(t)),
    f"""WITH p AS (SELECT parent_key, feature, count(*) AS n, {MEDIAN.format(x='lead')} AS median_lead, {MEDIAN.format(x='cycle')} AS median_cycle FROM lt GROUP BY 1, 2)
 SELECT *, greatest(0, median_lead - median_cycle) AS queue, round(CAST(median_lead AS DOUBLE) / nullif(max(median_lead) OVER (), 0), 6) AS relative FROM p""",
    lc=LC,
    lt=LT,
)


def lead_summary(t):
    """Percentiles of both times in one pass, and the median flow efficiency."""
    rows = report(t)
    both = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("what"), c(x).alias("days")) for x in ("lead", "cycle")])).alias("x")).select("x.*")
    found = flow.nearest_rank(both, ["what"], "days", {"p50": 0.5, "p85": 0.85, "p95": 0.95})
    of = lambda what, x: F.max(F.when(c("what") == what, c(x)))
    shown = found.agg(*[of("lead", x).alias(x) for x in ("p50", "p85", "p95")], of("cycle", "p50").alias("cycle_p50"))
    return shown.crossJoin(rows.filter("lead > 0").agg(F.round(F.percentile(c("cycle") / c("lead"), 0.5), 6).alias("flow_efficiency")))


query(
    "lead_summary",
    lead_summary,
    """WITH r AS (SELECT lead, row_number() OVER (ORDER BY lead) - 1 AS k, count(*) OVER () AS n FROM lt), q AS (SELECT cycle, row_number() OVER (ORDER BY cycle) - 1 AS k, count(*) OVER () AS n FROM lt)
 SELECT (SELECT lead FROM r WHERE k = floor(n * 0.5)) AS p50, (SELECT lead FROM r WHERE k = floor(n * 0.85)) AS p85, (SELECT lead FROM r WHERE k = floor(n * 0.95)) AS p95,
 (SELECT cycle FROM q WHERE k = floor(n * 0.5)) AS cycle_p50, (SELECT round(quantile_cont(CAST(cycle AS DOUBLE) / lead, 0.5), 6) FROM lt WHERE lead > 0) AS flow_efficiency""",
    lc=LC,
    lt=LT,
)
BUCKET = "CASE WHEN lead <= 3 THEN '0-3' WHEN lead <= 7 THEN '4-7' WHEN lead <= 14 THEN '8-14' WHEN lead <= 30 THEN '15-30' WHEN lead <= 60 THEN '31-60' WHEN lead <= 90 THEN '61-90' ELSE '91+' END"


def lead_histogram(t):
    spine = t.spark.createDataFrame([(b,) for _, b in S.LEAD_BUCKETS], "bucket string")
    counts = report(t).groupBy(S.lead_bucket(c("lead")).alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bucket", "left").fillna(0, ["n"])


query(
    "lead_histogram",
    lead_histogram,
    f"WITH b(bucket) AS (VALUES ('0-3'), ('4-7'), ('8-14'), ('15-30'), ('31-60'), ('61-90'), ('91+')), h AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM lt GROUP BY 1) SELECT b.bucket, coalesce(n, 0) AS n FROM b LEFT JOIN h ON h.bucket = b.bucket",
    lc=LC,
    lt=LT,
)
query(
    "children_of",
    lambda t: t.issues.join(t.issues.filter("issuetype in ('Feature', 'Initiative')").select(c("key").alias("parent_key")), "parent_key", "left_semi").select("key", "parent_key"),
    "SELECT key, parent_key FROM w_issues WHERE parent_key IN (SELECT key FROM w_issues WHERE issuetype IN ('Feature', 'Initiative'))",
)
query(
    "transitions_of",
    lambda t: t.transitions.join(t.issues.filter("issuetype = 'Feature'").select("key"), "key", "left_semi").select("key", "seq", "to_status", "changed_at"),
    "SELECT key, seq, to_status, changed_at FROM w_transitions WHERE key IN (SELECT key FROM w_issues WHERE issuetype = 'Feature')",
)
OH = f"""SELECT * FROM w_issues WHERE issuetype = 'Initiative' AND status_category <> 'done'
 UNION ALL SELECT * FROM w_issues WHERE issuetype = 'Feature' AND (status_category <> 'done' OR parent_key IN (SELECT key FROM w_issues WHERE issuetype = 'Initiative' AND status_category <> 'done'))"""
query("open_hierarchy", lambda t: flow.open_hierarchy(t.issues, closed()).select("key", "issuetype", "parent_key"), "SELECT key, issuetype, parent_key FROM oh", oh=OH)
query("items_union", lambda t: flow.open_hierarchy(t.issues, closed()).groupBy("issuetype").agg(F.count("*").alias("n")), "SELECT issuetype, count(*) AS n FROM oh GROUP BY 1", oh=OH)
query(
    "rollup_map",
    lambda t: t.issues.filter("issuetype = 'Feature'").select(c("key").alias("feature"), c("parent_key").alias("key")).join(t.issues.filter((c("issuetype") == "Initiative") & ~closed()).select("key"), "key").select("feature", c("key").alias("initiative")),
    f"SELECT f.key AS feature, i.key AS initiative FROM w_issues f JOIN w_issues i ON i.key = f.parent_key WHERE f.issuetype = 'Feature' AND i.issuetype = 'Initiative' AND i.status_category <> 'done'",
)


def roster(t):
    return t.spark.range(10).select(F.concat(F.lit("Engineer "), c("id").cast("string")).alias("name"))


def monthly(t):
    return flow.monthly_velocity(flow.completions(t.issues, t.transitions), roster(t), flow.month_spine(t.spark, "2001-03", "2001-08"), P)


MV = f"SELECT ro.name, strftime(m, '%Y-%m') AS month, count(dn.key) AS n FROM ro CROSS JOIN range(DATE '2001-03-01', DATE '2001-09-01', INTERVAL 1 MONTH) r(m) LEFT JOIN dn ON dn.assignee = ro.name AND {BM} = strftime(m, '%Y-%m') GROUP BY 1, 2"
CUR = f"SELECT ro.name, count(dn.key) AS done FROM ro LEFT JOIN dn ON dn.assignee = ro.name AND {BM} = '2001-09' GROUP BY 1"


def current(t):
    done = flow.completions(t.issues, t.transitions).filter(S.business_month(c("done_at"), P) == flow.months_before(P, 0)[1])
    return roster(t).join(done.groupBy(c("assignee").alias("name")).agg(F.count("*").alias("done")), "name", "left").fillna(0, ["done"])


query("completions_month", current, "SELECT * FROM cur", ro=ROSTER, dn=DONE, cur=CUR)
query("monthly_velocity", monthly, "SELECT * FROM mv", ro=ROSTER, dn=DONE, mv=MV)
query("member_order", lambda t: monthly(t).groupBy("name").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "name").withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "name"))), "SELECT name, CAST(sum(n) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY sum(n) DESC, name) AS INT) AS place FROM mv GROUP BY 1", ro=ROSTER, dn=DONE, mv=MV)
ELAPSED = "(SELECT CAST(count(*) FILTER (d <= DATE '2001-09-15') AS DOUBLE) / count(*) FROM range(TIMESTAMP '2001-09-01', TIMESTAMP '2001-10-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6)"
VF = f"""SELECT name, CAST(round_even(x, 0) AS BIGINT) AS value, CAST(round_even(greatest(0.0, x - sd), 0) AS BIGINT) AS low, CAST(round_even(x + sd, 0) AS BIGINT) AS high, CAST(round_even(base, 0) AS BIGINT) AS baseline FROM (
 SELECT name, base, sd, base * (1 - e) + done / e * e AS x FROM (SELECT name, sum(n * (4 - r)) / 6.0 AS base, stddev_pop(n) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY month DESC) AS r FROM mv) WHERE r <= 3 GROUP BY 1) JOIN cur USING (name), (SELECT {ELAPSED} AS e))"""


def forecast(t):
    return flow.velocity_forecast(monthly(t), current(t), S.business_days_elapsed(F.to_date(S.to_zone(P.now(), P.business_tz))))


query("velocity_forecast", forecast, "SELECT * FROM vf", ro=ROSTER, dn=DONE, mv=MV, cur=CUR, vf=VF)


def team_stats(t):
    months = monthly(t).groupBy("month").agg(F.sum("n").alias("n"))
    last, prev = F.max_by("n", "month"), F.sum(F.when(c("month") == "2001-07", c("n")))
    totals = months.agg(F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("per_month"), S.percent_change(last.cast("double"), prev.cast("double")).alias("change"))
    return totals.crossJoin(forecast(t).agg(*[F.sum(x).alias(x) for x in ("low", "value", "high")]))


query(
    "team_stats",
    team_stats,
    """WITH m AS (SELECT month, CAST(sum(n) AS BIGINT) AS n FROM mv GROUP BY 1), x AS (SELECT (max_by(n, month) - sum(n) FILTER (month = '2001-07')) / CAST(nullif(sum(n) FILTER (month = '2001-07'), 0) AS DOUBLE) * 100 AS ch FROM m)
 SELECT CAST((SELECT sum(n) FROM m) AS BIGINT) AS total, (SELECT round(avg(n), 6) FROM m) AS per_month, CASE WHEN abs(ch) < 10 THEN round(ch, 1) ELSE round(ch, 0) END AS change,
 CAST((SELECT sum(low) FROM vf) AS BIGINT) AS low, CAST((SELECT sum(value) FROM vf) AS BIGINT) AS value, CAST((SELECT sum(high) FROM vf) AS BIGINT) AS high FROM x""",
    ro=ROSTER, dn=DONE, mv=MV, cur=CUR, vf=VF,
)
PCT = "CASE WHEN abs({x}) < 10 THEN round({x}, 1) ELSE round({x}, 0) END"
_mom = "(CAST(n AS DOUBLE) - prev) / nullif(CAST(prev AS DOUBLE), 0) * 100"
query(
    "month_over_month",
    lambda t: monthly(t).withColumn("prev", F.lag("n").over(Window.partitionBy("name").orderBy("month"))).select("name", "month", S.percent_change(c("n").cast("double"), c("prev").cast("double")).alias("change")),
    f"SELECT name, month, {PCT.format(x=_mom)} AS change FROM (SELECT *, lag(n) OVER (PARTITION BY name ORDER BY month) AS prev FROM mv)",
    ro=ROSTER, dn=DONE, mv=MV,
)
_hh = "(CAST(a.n AS DOUBLE) - b.n) / nullif(CAST(b.n AS DOUBLE), 0) * 100"
query(
    "head_to_head",
    lambda t: monthly(t).filter("name = 'Engineer 1'").select("month", c("n").alias("x")).join(monthly(t).filter("name = 'Engineer 2'").select("month", c("n").alias("y")), "month").select("month", S.percent_change(c("x").cast("double"), c("y").cast("double")).alias("difference")),
    f"SELECT a.month, {PCT.format(x=_hh)} AS difference FROM mv a JOIN mv b ON a.month = b.month WHERE a.name = 'Engineer 1' AND b.name = 'Engineer 2'",
    ro=ROSTER, dn=DONE, mv=MV,
)

CC = """SELECT {by} AS k, count(*) FILTER (status = 'Done') AS done, count(*) FILTER (status NOT IN ('Done', 'Will Not Do')) AS remaining, count(*) FILTER (status IN ('To Do', 'Tech Discovery Required', 'Triage')) AS todo,
 count(*) FILTER (status IN ('In Progress', 'Validating')) AS prog, count(*) FILTER (status = 'Blocked') AS blk, count(*) FILTER (status = 'On Hold') AS hold, count(rk.key) AS recent, min(created) AS first_created FROM {rows} LEFT JOIN rk ON rk.key = x.key GROUP BY 1"""
RK = f"SELECT key FROM w_transitions WHERE to_status = 'Done' GROUP BY key HAVING max(changed_at) >= {NOW} - INTERVAL 84 DAY"
query("recent_keys", lambda t: flow.recent_done(t.transitions, P), "SELECT key FROM rk", rk=RK)
F_ROWS = "(SELECT s.* FROM w_issues s WHERE s.parent_key IN (SELECT key FROM w_issues WHERE issuetype = 'Feature')) x"
I_ROWS = "(SELECT s.*, f.parent_key AS initiative FROM w_issues s JOIN {f} f ON f.key = s.parent_key AND f.issuetype = 'Feature' WHERE f.parent_key IS NOT NULL) x"
features_children = lambda t: t.issues.join(t.issues.filter("issuetype = 'Feature'").select(c("key").alias("parent_key")), "parent_key", "left_semi")
query("child_scope_counts", lambda t: flow.child_counts(features_children(t), t.transitions, P).withColumnRenamed("parent_key", "k"), CC.format(by="parent_key", rows=F_ROWS), rk=RK)
query(
    "initiative_rollup",
    lambda t: flow.initiative_counts(t.issues.filter("issuetype = 'Feature'"), flow.child_counts(t.issues, t.transitions, P)).withColumnRenamed("initiative", "k"),
    CC.format(by="initiative", rows=I_ROWS.format(f="w_issues")),
    rk=RK,
)
_weeks = f"greatest(0.0, {days('CAST(proxy_start AS TIMESTAMP)', NOW)} / 7)"
DI = f"""SELECT *, CASE WHEN done + remaining = 0 THEN 'unbroken' WHEN remaining = 0 THEN 'complete' WHEN recent = 0 THEN 'stalled' ELSE 'forecast' END AS class, recent / least(12.0, greatest(2.0, {_weeks})) AS rate,
 CASE WHEN recent >= 8 AND {_weeks} >= 4 THEN 'higher' WHEN recent >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM (
 SELECT oh.key, oh.issuetype, CAST(CASE WHEN oh.issuetype = 'Initiative' THEN coalesce(oh.created, first_created) ELSE coalesce(first_created, oh.created) END AS DATE) AS proxy_start, coalesce(done, 0) AS done, coalesce(remaining, 0) AS remaining, coalesce(recent, 0) AS recent, coalesce(todo, 0) AS todo, coalesce(prog, 0) AS prog, coalesce(blk, 0) AS blk, coalesce(hold, 0) AS hold
 FROM oh LEFT JOIN (SELECT 'Feature' AS ty, * FROM fc UNION ALL SELECT 'Initiative', * FROM ic) y ON y.k = oh.key AND y.ty = oh.issuetype)"""
ITEMS = {"rk": RK, "oh": OH, "fc": CC.format(by="parent_key", rows=F_ROWS), "ic": CC.format(by="initiative", rows=I_ROWS.format(f="oh")), "di": DI}


def items(t):
    return flow.delivery_items(t.issues, t.transitions, P)


query("proxy_start", lambda t: items(t).select("key", "proxy_start"), "SELECT key, proxy_start FROM di", **ITEMS)
query("item_class", lambda t: items(t).select("key", "class"), "SELECT key, class FROM di", **ITEMS)
query("forecast_confidence", lambda t: items(t).select("key", "confidence"), "SELECT key, confidence FROM di", **ITEMS)
query(
    "delivery_summary",
    lambda t: items(t).filter("issuetype = 'Feature'").agg(F.count("*").alias("n"), *[F.count_if(c("class") == k).alias(k) for k in ("forecast", "unbroken", "stalled", "complete")]),
    "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (class = '{k}') AS {k}" for k in ("forecast", "unbroken", "stalled", "complete")) + " FROM di WHERE issuetype = 'Feature'",
    **ITEMS,
)
query(
    "delivery_children",
    lambda t: flow.delivery_children(t.issues, t.transitions, flow.open_hierarchy(t.issues, closed())),
    "SELECT i.parent_key, i.key, coalesce(i.summary, '') AS summary, i.status, i.status_category, i.assignee_name, CAST(i.updated AS DATE) AS changed, CAST(i.target_end_date AS DATE) AS target, lc.cycle FROM w_issues i LEFT JOIN lc ON lc.key = i.key WHERE i.parent_key IN (SELECT key FROM oh)",
    oh=OH, lc=LC,
)
QS = {"p50": 0.5, "p85": 0.85, "p95": 0.95}


def with_weeks(t):
    """Delivery items with their percentiles in weeks, null where there is no forecast."""
    rows = items(t).filter("issuetype = 'Initiative' or class = 'forecast'")
    return rows.select("key", "remaining", "rate")


def forecast_weeks(t):
    """All delivery items in one pass; the percentiles are expressions over their own row."""
    rows = items(t)
    weeks = flow.burndown_columns(QS)
    shown = (c("issuetype") == "Initiative") | (c("class") == "forecast")
    return rows.select("*", *[F.when(shown, w).alias(n) for n, w in weeks.items()])


BD = """SELECT key, CAST(CASE WHEN remaining <= 0 THEN 0 ELSE coalesce(p50, 260) END AS INT) AS p50, CAST(CASE WHEN remaining <= 0 THEN 0 ELSE coalesce(p85, 260) END AS INT) AS p85, CAST(CASE WHEN remaining <= 0 THEN 0 ELSE coalesce(p95, 260) END AS INT) AS p95 FROM (
 SELECT key, any_value(remaining) AS remaining, min(w) FILTER (cdf > 0.5) AS p50, min(w) FILTER (cdf > 0.85) AS p85, min(w) FILTER (cdf > 0.95) AS p95 FROM (
  SELECT key, remaining, w, 1 - CASE WHEN rate > 0 AND remaining > 0 THEN (SELECT sum(exp(-rate * w + k * ln(rate * w) - lgamma(k + 1))) FROM range(0, CAST(remaining AS BIGINT)) r(k)) ELSE 1 END AS cdf
  FROM di, range(1, 261) g(w) WHERE issuetype = 'Initiative' OR class = 'forecast') GROUP BY key)"""
query("burndown_percentiles", lambda t: flow.burndown(with_weeks(t), QS), "SELECT * FROM bd", **ITEMS, bd=BD)
query(
    "delivery_forecast",
    lambda t: forecast_weeks(t).select("key", "issuetype", "done", "remaining", "todo", "prog", "blk", "hold", "recent", "class", "confidence", "p50", "p85", "p95", F.date_add(F.to_date(P.now()), c("p85") * 7).alias("p85_date")),
    "SELECT di.key, issuetype, done, remaining, todo, prog, blk, hold, recent, class, confidence, p50, p85, p95, DATE '2001-09-15' + p85 * 7 AS p85_date FROM di LEFT JOIN bd ON bd.key = di.key",
    **ITEMS,
    bd=BD,
)
query(
    "feature_order",
    lambda t: R.numbered(forecast_weeks(t).filter("issuetype = 'Feature'"), [S.rank_in(c("class"), ("forecast", "stalled", "unbroken", "complete")), F.coalesce("p85", F.lit(1 << 30))], ["key"]).select("key", "place"),
    "SELECT di.key, CAST(row_number() OVER (ORDER BY CASE class WHEN 'forecast' THEN 1 WHEN 'stalled' THEN 2 WHEN 'unbroken' THEN 3 ELSE 4 END, p85 NULLS LAST, di.key) AS INT) AS place FROM di LEFT JOIN bd ON bd.key = di.key WHERE issuetype = 'Feature'",
    **ITEMS,
    bd=BD,
)
query(
    "story_delta_vs_target",
    lambda t: features_children(t).join(t.transitions.groupBy("key").agg(F.max("changed_at").alias("last"), F.max(F.when(c("to_status") == "Done", c("changed_at"))).alias("done_at")), "key", "left").select(
        "key", F.when(c("status_category") == "done", F.datediff("done_at", "target_end_date")).alias("late"), F.when(c("status_category") == "indeterminate", F.datediff(P.now(), "last")).alias("quiet")
    ).withColumns({"stale_30": c("quiet") >= 30, "stale_60": c("quiet") >= 60}),
    f"""SELECT *, quiet >= 30 AS stale_30, quiet >= 60 AS stale_60 FROM (SELECT i.key, CASE WHEN status_category = 'done' THEN CAST(CAST(done_at AS DATE) - CAST(target_end_date AS DATE) AS INT) END AS late,
 CASE WHEN status_category = 'indeterminate' THEN CAST(CAST({NOW} AS DATE) - CAST(last AS DATE) AS INT) END AS quiet
 FROM w_issues i LEFT JOIN (SELECT key, max(changed_at) AS last, max(changed_at) FILTER (to_status = 'Done') AS done_at FROM w_transitions GROUP BY 1) l ON l.key = i.key WHERE parent_key IN (SELECT key FROM w_issues WHERE issuetype = 'Feature'))""",
)
query("wip_by_owner", lambda t: t.issues.filter(c("status").isin(*WIP) & c("issuetype").isin(*DELIVERY_TYPES) & c("assignee_name").isNotNull()).groupBy("assignee_name").agg(F.count("*").alias("wip")), f"SELECT assignee_name, count(*) AS wip FROM w_issues WHERE status IN ({wip_sql}) AND issuetype IN ({types_sql}) AND assignee_name IS NOT NULL GROUP BY 1")


def capacity(t):
    """name, velocity (the baseline), wip and done of every member of the roster."""
    wip = t.issues.filter(c("status").isin(*WIP) & c("issuetype").isin(*DELIVERY_TYPES)).groupBy(c("assignee_name").alias("name")).agg(F.count("*").alias("wip"))
    return forecast(t).select("name", c("baseline").alias("velocity")).join(current(t), "name").join(wip, "name", "left").fillna(0, ["wip"]).select("name", "velocity", "wip", "done")


def spare_capacity(t):
    return capacity(t).select("name", (F.greatest(F.lit(0).cast("long"), c("velocity") - c("done")) - c("wip")).alias("spare"))


CAPACITY_SQL = f"SELECT name, baseline AS velocity, coalesce(wip, 0) AS wip, done FROM vf JOIN cur USING (name) LEFT JOIN (SELECT assignee_name, count(*) AS wip FROM w_issues WHERE status IN ({wip_sql}) AND issuetype IN ({types_sql}) GROUP BY 1) w ON w.assignee_name = name"
SPARE = f"SELECT name, greatest(0, velocity - done) - wip AS spare FROM ({CAPACITY_SQL})"
query("spare_capacity", spare_capacity, SPARE, ro=ROSTER, dn=DONE, mv=MV, cur=CUR, vf=VF)
