"""Ingest and streaming queries. Raw records are made from the sample views by to_json, so their number follows the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.functions.params import DEFAULT as P
from worklens.plans.registry import NOW, days, floor_days, query
from worklens.sources import ingest as I
from worklens.sources.keyed import Store, Upsert, newest
from worklens.streaming import intake

c = F.col
iso = lambda x: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000+0000"))
named = lambda x, n="name": F.when(x.isNotNull(), F.struct(x.alias(n)))


def raw_issues(t):
    """One JSON object for each issue, with its changelog; every ninth comes twice, the second time newer."""
    items = lambda x: F.array(F.struct(F.lit("status").alias("field"), x["to_status"].alias("toString")), F.struct(F.lit("rank").alias("field"), F.lit("1").alias("toString")))
    history = F.transform("log", lambda x: F.struct(iso(x["changed_at"]).alias("created"), items(x).alias("items")))
    rows = t.issues.join(t.logs, "id", "left")
    rows = rows.withColumn("again", F.explode(F.when(c("id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("updated", c("updated") + F.make_interval(hours=c("again")))
    person = lambda x: F.when(c(x).isNotNull(), F.struct(c(x).alias("displayName"), F.concat(F.lit("acc-"), c(x)).alias("accountId")))
    known = lambda k, x: F.when(c("id") % k != 0, x)
    fields = F.struct(
        "summary", F.struct(c("status").alias("name"), F.struct(c("status_category").alias("key")).alias("statusCategory")).alias("status"), named(c("issuetype")).alias("issuetype"),
        known(10, F.struct(c("priority_name").alias("name"), (c("id") % 5).cast("string").alias("id"))).alias("priority"), person("assignee_name").alias("assignee"), person("creator_name").alias("creator"), known(4, person("creator_name")).alias("reporter"),
        F.struct(F.substring_index("key", "-", 1).alias("key"), c("project_name").alias("name"), (c("id") % 2).cast("string").alias("id")).alias("project"),
        named(c("parent_key"), "key").alias("parent"), iso(c("created")).alias("created"), iso(c("updated")).alias("updated"), iso(c("resolved")).alias("resolutiondate"), known(3, F.date_format("target_end_date", "yyyy-MM-dd")).alias("duedate"),
        F.date_format("target_end_date", "yyyy-MM-dd").alias("target_end"), F.date_format("planned_start_date", "yyyy-MM-dd").alias("planned_start"), known(8, person("business_lead")).alias("lead"), named(c("estimated_size_name"), "value").alias("size"),
        known(2, F.array(F.lit("team-a"), F.concat(F.lit("lead-"), "business_lead"))).alias("labels"), known(7, (c("id") % 100).cast("string")).alias("planning_rank"), known(6, (c("id") % 50).cast("string")).alias("portfolio_rank"),
        known(5, c("parent_key")).alias("legend"), known(9, c("project_name")).alias("parent_project"),
    )
    return I.once(rows.select("id", "again", F.to_json(F.struct("key", c("id").cast("string").alias("id"), fields.alias("fields"), F.struct(history.alias("histories")).alias("changelog"))).alias("value")), "value")


def raw_mrs(t):
    files = t.mr_files.groupBy(c("mr_id").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    rows = t.mrs.join(files, "id", "left")
    deleted = F.when(c("id") % 4 == 0, F.array(F.struct(F.lit("").alias("new_path"), F.lit("old/gone.py").alias("old_path")))).otherwise(F.array().cast("array<struct<new_path:string,old_path:string>>"))
    changes = F.concat(deleted, F.coalesce(F.transform("paths", lambda p: F.struct(p.alias("new_path"), p.alias("old_path"))), F.array().cast("array<struct<new_path:string,old_path:string>>")))
    full = F.when(c("id") % 5 != 0, F.concat("project_path", F.lit("!"), c("iid").cast("string")))
    return I.once(rows.select("id", F.to_json(F.struct("id", "iid", (c("id") % 7).alias("project_id"), F.struct(c("author").alias("username")).alias("author"), iso(c("merged_at")).alias("merged_at"), F.struct(full.alias("full")).alias("references"), changes.alias("changes"))).alias("value")), "value")


#: The records without their changelog, which their columns don't need.
records = lambda t: I.parse(raw_issues(t), I.ISSUE_HEAD)


def transitions_of(lines):
    """Transitions of raw lines, of the newest line of each key; which one that is, is told as by the intake."""
    change = intake.issue_changes(lines)["issues"]
    return newest(I.apart(change.rows), change.key, c(change.time)).select("key", F.inline("log")).select("key", "to_status", "changed_at", "seq")


parsed_mrs = lambda t: I.parse(raw_mrs(t), I.MERGE_REQUEST)
#: Raw records as rows: the repeated ones are an hour newer.
RR = "SELECT *, 0 AS again FROM w_issues UNION ALL SELECT * REPLACE (updated + INTERVAL 1 HOUR AS updated), 1 FROM w_issues WHERE id % 9 = 0"
_local = lambda x: f"({x} - INTERVAL 6 HOUR)"
_parts = ", ".join(f"CAST({n}({_local(x)}) AS INT) AS {n}_{a}" for a, x in (("created", "created"), ("updated", "coalesce(resolved, updated)"), ("resolved", "resolved")) for n in ("year", "month"))
_due = "CASE WHEN id % 3 <> 0 THEN CAST(CAST(target_end_date AS DATE) AS TIMESTAMP) END"
_plan = "CAST(CAST(planned_start_date AS DATE) AS TIMESTAMP)"
query(
    "issue_flatten_wide",
    lambda t: I.flatten_wide(records(t), P).withColumns({x: F.round(x, 6) for x in ("velocity_hours", "velocity_backlog")}),
    f"""SELECT key, CAST(id AS VARCHAR) AS id, summary, status, issuetype, creator_name, coalesce(assignee_name, 'Unassigned') AS assignee_name, {_local('created')} AS created, {_local('coalesce(resolved, updated)')} AS updated, {_local('resolved')} AS resolved,
 project_name, CAST(id % 2 AS VARCHAR) AS project_id, CASE WHEN id % 10 <> 0 THEN priority_name ELSE 'No Priority' END AS priority_name, CASE WHEN id % 10 <> 0 THEN CAST(id % 5 AS VARCHAR) ELSE 'No Priority' END AS priority_id,
 {_due} AS project_due_date, {NOW} AS today, greatest(0, {floor_days('created', NOW)}) AS days_old, {_parts}, greatest(0, {floor_days('updated', NOW)}) AS last_updated_days, {floor_days('updated', _due)} AS project_due_date_days,
 {floor_days('created', 'updated')} AS velocity, round({days('created', 'updated')} * 24, 6) AS velocity_hours, {floor_days('created', 'updated')} AS velocity_days, CAST(CAST(target_end_date AS DATE) AS TIMESTAMP) AS target_end_date, {_plan} AS planned_start_date,
 CASE WHEN id % 8 <> 0 THEN replace(business_lead, '.', ' ') ELSE 'Unknown' END AS business_lead, CASE WHEN id % 7 <> 0 THEN CAST(id % 100 AS VARCHAR) ELSE 'Unknown' END AS planning_rank, CASE WHEN id % 6 <> 0 THEN CAST(id % 50 AS VARCHAR) END AS portfolio_rank,
 CASE WHEN id % 5 <> 0 THEN parent_key END AS legend, CASE WHEN id % 9 <> 0 THEN project_name END AS parent_project, parent_key AS parent, estimated_size_name,
 CAST(CASE estimated_size_name WHEN 'Small' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Large' THEN 3 WHEN 'XL' THEN 4 ELSE 0 END AS INT) AS estimated_size_number, round({days('created', _plan)}, 6) AS velocity_backlog,
 CASE WHEN planned_start_date IS NOT NULL THEN greatest(0, {floor_days('created', _plan)}) END AS velocity_backlog_days FROM rr""",
    rr=RR,
)
SNAP = """SELECT key, id, left(key, 3) AS project, issuetype, status, status_category, CASE WHEN id % 10 <> 0 THEN priority_name ELSE 'No Priority' END AS priority, summary, assignee_name AS assignee, 'acc-' || assignee_name AS assignee_account_id,
 CASE WHEN id % 4 <> 0 THEN creator_name END AS reporter, CASE WHEN id % 8 <> 0 THEN business_lead END AS business_lead, parent_key, created, updated, resolved AS resolutiondate, CAST(planned_start_date AS DATE) AS planned_start, CAST(target_end_date AS DATE) AS target_end,
 CASE WHEN id % 2 <> 0 THEN 'team-a,lead-' || business_lead ELSE '' END AS labels, updated AS fetched_at FROM {rows}"""
NEWEST = "SELECT * FROM rr WHERE again = 1 OR id % 9 <> 0"
LOGGED = "SELECT * FROM w_transitions WHERE key IN (SELECT key FROM w_issues)"
shown = lambda rows: rows.withColumn("labels", F.array_join("labels", ","))
query("issue_flatten_snapshot", lambda t: shown(I.flatten_snapshot(records(t))), SNAP.format(rows="rr"), rr=RR)
query("changelog_transitions", lambda t: transitions_of(raw_issues(t)), "SELECT t.key, to_status, changed_at, seq FROM w_transitions t WHERE key IN (SELECT key FROM w_issues)")
query(
    "transition_seq",
    lambda t: transitions_of(raw_issues(t)).groupBy("key").agg(F.max("seq").alias("last"), F.count("*").alias("n")),
    "SELECT key, max(seq) AS last, count(*) AS n FROM w_transitions WHERE key IN (SELECT key FROM w_issues) GROUP BY 1",
)
MRF = "SELECT id, CASE WHEN id % 5 <> 0 THEN project_path ELSE CAST(id % 7 AS VARCHAR) END AS project_path, iid, author, merged_at FROM w_mrs"
PATHS = "SELECT id AS mr_id, 'old/gone.py' AS path FROM w_mrs WHERE id % 4 = 0 UNION ALL SELECT mr_id, path FROM w_mr_files JOIN w_mrs ON w_mrs.id = mr_id"
query("mr_flatten", lambda t: I.mr_flatten(parsed_mrs(t)), MRF)
query("mr_changed_paths", lambda t: I.mr_changed_paths(parsed_mrs(t)), PATHS)
query(
    "parse_ts_utc",
    lambda t: t.issues.select("key", I.parse_ts_utc(F.when(c("id") % 7 == 0, "not a time").otherwise(F.concat(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-06:00")))).alias("at")),
    "SELECT key, CASE WHEN id % 7 <> 0 THEN created + INTERVAL 6 HOUR END AS at FROM w_issues",
)
query("parse_date", lambda t: t.issues.select("key", I.parse_date(F.when(c("id") % 7 == 0, "soon").otherwise(F.date_format("created", "yyyy-MM-dd"))).alias("day")), "SELECT key, CASE WHEN id % 7 <> 0 THEN CAST(created AS DATE) END AS day FROM w_issues")
query(
    "dedupe_by_id",
    lambda t: I.latest(t.mrs.select("id", "author", F.lit(2).alias("scope")).unionByName(t.mrs.filter("id % 2 = 0").select("id", F.lit("first scope").alias("author"), F.lit(1).alias("scope"))), "id", [c("scope")]).drop("scope"),
    "SELECT id, CASE WHEN id % 2 = 0 THEN 'first scope' ELSE author END AS author FROM w_mrs",
)
_snap = lambda t: t.issues.select("key", "status", "updated")
query(
    "snapshot_upsert",
    lambda t: I.snapshot_upsert(_snap(t), t.issues.filter("id % 3 = 0").select("key", F.lit("Sent again").alias("status"), (c("updated") + F.make_interval(days=(c("id") % 2) * 2 - 1)).alias("updated")), time="updated"),
    "SELECT key, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN 'Sent again' ELSE status END AS status, CASE WHEN id % 3 = 0 AND id % 2 = 1 THEN updated + INTERVAL 1 DAY ELSE updated END AS updated FROM w_issues",
)
query(
    "replace_children",
    lambda t: I.replace_children(t.transitions.select("key", "to_status", "seq"), t.transitions.filter("key like '%7' and seq = 0").select("key", F.lit("Replaced").alias("to_status"), "seq")),
    "SELECT key, to_status, seq FROM w_transitions WHERE key NOT LIKE '%7' UNION ALL SELECT key, 'Replaced', seq FROM w_transitions WHERE key LIKE '%7' AND seq = 0",
)
query("mr_upsert", lambda t: I.snapshot_upsert(t.mrs.select("id", "author", "merged_at"), t.mrs.filter("id % 4 = 0").select("id", F.lit("new").alias("author"), "merged_at"), "id", "merged_at"), "SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE author END AS author, merged_at FROM w_mrs")
query("mr_files_replace", lambda t: I.replace_children(t.mr_files, t.mr_files.filter("mr_id % 4 = 0").select("mr_id", F.lit("new.py").alias("path")).distinct(), "mr_id"), "SELECT mr_id, path FROM w_mr_files WHERE mr_id % 4 <> 0 UNION ALL SELECT DISTINCT mr_id, 'new.py' FROM w_mr_files WHERE mr_id % 4 = 0")
query(
    "incremental_slice",
    lambda t: I.incremental_slice(t.issues.select("key", "updated"), t.issues.filter("id % 100 = 0").agg(F.max("updated").alias("at")), "updated", "'2' MINUTE"),
    "SELECT key, updated FROM w_issues WHERE updated >= (SELECT max(updated) FROM w_issues WHERE id % 100 = 0) - INTERVAL 2 MINUTE",
)


def sync_audit(t):
    """Two cycles: the first readings as a whole, then of all lines those from the watermark less the margin on."""
    store, lines = Store(t.spark, I.shared_dir(t.spark), 8), raw_issues(t)
    intake.sync_cycle(store, lines.filter("again = 0").select("value"), intake.issue_changes, "fields.updated", I.ISSUE)
    intake.sync_cycle(store, lines.select("value"), intake.issue_changes, "fields.updated", I.ISSUE)
    sizes = [c(x)[y].alias(f"{x}_{y}") for x in ("fetched", "total") for y in ("issues", "transitions")]
    return store.audit().select("number", "whole", *sizes, "watermark")


query(
    "sync_audit",
    sync_audit,
    """SELECT CAST(0 AS BIGINT) AS number, true AS whole, (SELECT count(*) FROM w_issues) AS fetched_issues, (SELECT count(*) FROM lg) AS fetched_transitions, (SELECT count(*) FROM w_issues) AS total_issues, (SELECT count(*) FROM lg) AS total_transitions,
 (SELECT max(updated) FROM w_issues) AS watermark UNION ALL SELECT 1, false, (SELECT count(*) FROM sl), (SELECT count(*) FROM lg WHERE key IN (SELECT key FROM sl)), (SELECT count(*) FROM w_issues), (SELECT count(*) FROM lg), (SELECT max(updated) FROM rr)""",
    rr=RR, lg=LOGGED, sl="SELECT DISTINCT key FROM rr WHERE updated >= (SELECT max(updated) FROM w_issues) - INTERVAL 2 MINUTE",
)
query("lookback_slice", lambda t: I.lookback_slice(t.issues, P).select("key", "created"), f"SELECT key, created FROM w_issues WHERE created >= {NOW} - INTERVAL 730 DAY")


def table_sink(t):
    path = I.shared_dir(t.spark)
    I.write_monthly(t.issues.select("key", "created"), path)
    return t.spark.read.parquet(path).groupBy(c("created_month").cast("string").alias("month")).agg(F.count("*").alias("n"))


def table_sink_by_key(t):
    """Issues with their transitions and merge requests with their files in buckets of their key, in one commit; then some keys from their buckets alone."""
    store = Store(t.spark, I.shared_dir(t.spark), 16)
    issues = Upsert(t.issues, "key", "updated", {"transitions": t.transitions.join(t.issues.select("key"), "key", "left_semi")})
    mrs = Upsert(t.mrs, "id", "merged_at", {"mr_files": t.mr_files.withColumnRenamed("mr_id", "id").join(t.mrs.select("id"), "id", "left_semi")})
    store.commit({"issues": issues, "merge_requests": mrs})
    some = [f"OPS-{k}" for k in (1, 3, 7, 32, 33, 96)]
    parts = [(n, store.table(n)) for n in ("issues", "transitions", "merge_requests", "mr_files")] + [("transitions of some", store.rows_of("transitions", "key", some))]
    return reduce(DataFrame.unionAll, [rows.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, rows in parts])


query(
    "table_sink_by_key",
    table_sink_by_key,
    "SELECT 'issues' AS name, count(*) AS n FROM w_issues UNION ALL SELECT 'transitions', count(*) FROM lg UNION ALL SELECT 'merge_requests', count(*) FROM w_mrs UNION ALL SELECT 'mr_files', count(*) FROM w_mr_files WHERE mr_id IN (SELECT id FROM w_mrs)"
    " UNION ALL SELECT 'transitions of some', count(*) FROM lg WHERE key IN ('OPS-1', 'OPS-3', 'OPS-7', 'OPS-32', 'OPS-33', 'OPS-96')",
    lg=LOGGED,
)
query("table_sink", table_sink, "SELECT strftime(created, '%Y-%m') AS month, count(*) AS n FROM w_issues GROUP BY 1")


#: Batches that a staged folder is read in.
BATCHES = 3


def _staged(t, raw) -> tuple[str, int]:
    """Raw lines as files, those of even ids twice, in a shared folder, and how many files make a batch. Files follow the rows, so that no task writes or reads them alone; batches don't grow in number."""
    path = I.shared_dir(t.spark)
    raw.select("value").write.option("compression", "lz4").text(path)
    again = t.spark.read.text(path).filter(F.get_json_object("value", "$.id").cast("long") % 2 == 0)
    again.write.mode("append").option("compression", "lz4").text(path)
    return path, -(-len(t.spark.read.text(path).inputFiles()) // BATCHES)


def _taken_in(t, run, raw) -> Store:
    """The store that a stream over the raw lines has filled."""
    target = I.shared_dir(t.spark)
    source, files = _staged(t, raw)
    run(t.spark, source, target, buckets=8, files_per_batch=files).awaitTermination()
    return Store(t.spark, target)


def both_tables(store: Store):
    """Snapshots with the transitions that the same commits brought."""
    log = store.table("transitions").groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("seq", "to_status")).alias("last"), F.max("changed_at").alias("last_at"))
    rows = store.table("issues").join(log, "key", "left")
    return rows.select("key", "status", "updated", F.coalesce("n", F.lit(0)).alias("n"), c("last.to_status").alias("last_status"), "last_at")


def stream_audit(t):
    """The audit after all commits: lines with an update are read at least once, totals are the tables' sizes, the watermark is the newest update."""
    audit = _taken_in(t, intake.run_issue_stream, raw_issues(t)).audit()
    last = audit.orderBy(F.desc("number")).limit(1)
    return last.select(c("total")["issues"].alias("issues"), c("total")["transitions"].alias("transitions")).join(F.broadcast(audit.agg(F.max("watermark").alias("watermark"), F.count_if("whole").alias("whole"))))


def stream_completions(t):
    """Rows come in order of time, in several batches; each batch updates the days that it touches."""
    path, target = I.shared_dir(t.spark), I.shared_dir(t.spark)
    rows = t.transitions.select("key", "to_status", c("changed_at").cast("timestamp").alias("changed_at"), "seq")
    rows.write.parquet(path)
    intake.run_completions(t.spark.readStream.schema(rows.schema).parquet(path), target).awaitTermination()
    return Store(t.spark, target).table("days").select(F.to_date("day").alias("day"), "n")


query("stream_issue_ingest", lambda t: shown(_taken_in(t, intake.run_issue_stream, raw_issues(t)).table("issues")), SNAP.format(rows="nw"), rr=RR, nw=NEWEST)
query(
    "stream_issue_and_transitions",
    lambda t: both_tables(_taken_in(t, intake.run_issue_stream, raw_issues(t))),
    "SELECT i.key, status, updated, coalesce(n, 0) AS n, last_status, last_at FROM nw i LEFT JOIN (SELECT key, count(*) AS n, arg_max(to_status, seq) AS last_status, max(changed_at) AS last_at FROM lg GROUP BY 1) x ON x.key = i.key",
    rr=RR, nw=NEWEST, lg=LOGGED,
)
query("stream_audit", stream_audit, "SELECT (SELECT count(*) FROM w_issues) AS issues, (SELECT count(*) FROM lg) AS transitions, (SELECT max(updated) FROM rr) AS watermark, CAST(1 AS BIGINT) AS whole", rr=RR, lg=LOGGED)


def stream_mr_ingest(t):
    store = _taken_in(t, intake.run_mr_stream, raw_mrs(t))
    files = store.table("mr_files").groupBy("id").agg(F.count("*").alias("n_paths"))
    return store.table("merge_requests").join(files, "id", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0).cast("long")))


query("stream_mr_ingest", stream_mr_ingest, f"SELECT m.*, coalesce(n, 0) AS n_paths FROM ({MRF}) m LEFT JOIN (SELECT mr_id, count(DISTINCT path) AS n FROM ({PATHS}) GROUP BY 1) x ON x.mr_id = m.id")
query(
    "stream_completions",
    stream_completions,
    "SELECT CAST(changed_at AS DATE) AS day, count(*) AS n FROM w_transitions WHERE to_status = 'Done' GROUP BY 1",
)


def reread(t):
    """Every transition is read twice, as an overlapping margin would; the second reading is another batch, and both are upserts by the transition's id."""
    target, source = I.shared_dir(t.spark), I.shared_dir(t.spark)
    rows = t.transitions.select(F.concat_ws("/", "key", "seq").alias("id"), "to_status", "changed_at")
    rows.write.parquet(source)
    first = t.spark.read.schema(rows.schema).parquet(source)
    files = len(first.inputFiles())
    first.write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    store = Store(t.spark, target, 8)
    intake.commit_stream(stream, store, lambda batch: {"log": Upsert(batch, "id", "changed_at")}, f"{target}/checkpoint").awaitTermination()
    return store.table("log").groupBy("to_status").agg(F.count("*").alias("n"))


query("overlap_safe_idempotence", reread, "SELECT to_status, count(*) AS n FROM w_transitions GROUP BY 1")
