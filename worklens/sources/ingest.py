"""Raw tracker records (JSON lines) to tables, and keyed upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.functions import scalars as S
from worklens.functions.params import Params

c = F.col
_NAMED, _PERSON = "struct<name:string>", "struct<displayName:string,accountId:string>"
ISSUE_HEAD = (
    "key string, id string, fields struct<summary:string, status:struct<name:string,statusCategory:struct<key:string>>, issuetype:" + _NAMED + ", priority:struct<name:string,id:string>"
    + ", assignee:" + _PERSON + ", creator:" + _PERSON + ", reporter:" + _PERSON + ", project:struct<key:string,name:string,id:string>, parent:struct<key:string>, created:string, updated:string, resolutiondate:string,"
    " duedate:string, target_end:string, planned_start:string, lead:" + _PERSON + ", size:struct<value:string>, labels:array<string>, planning_rank:string, portfolio_rank:string, legend:string, parent_project:string>"
)
_CHANGELOG = ", changelog struct<histories:array<struct<created:string,items:array<struct<field:string,toString:string>>>>>"
ISSUE = ISSUE_HEAD + _CHANGELOG
#: What flatten_snapshot and transition_log read of an issue; the parser makes no values of the rest.
SNAPSHOT = (
    "key string, id string, fields struct<summary:string, status:struct<name:string,statusCategory:struct<key:string>>, issuetype:" + _NAMED + ", priority:" + _NAMED + ", assignee:" + _PERSON
    + ", reporter:struct<displayName:string>, project:struct<key:string>, parent:struct<key:string>, created:string, updated:string, resolutiondate:string, target_end:string, planned_start:string,"
    " lead:struct<displayName:string>, labels:array<string>>" + _CHANGELOG
)
MERGE_REQUEST = "id long, iid long, project_id long, author struct<username:string>, merged_at string, title string, web_url string, references struct<full:string>, changes array<struct<new_path:string,old_path:string>>"
#: Changed files that are kept of one merge request.
FILES_KEPT = 60


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir. Where it is unset, one below the warehouse, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="worklens-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/worklens-steps"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{uuid.uuid4().hex}"


def parse_ts_utc(text: Column) -> Column:
    """ISO time with an offset -> naive UTC; null if it can't be read. The session's time zone must be UTC."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def parse_date(text: Column) -> Column:
    return F.try_to_date(text) if hasattr(F, "try_to_date") else text.try_cast("date")


def once(rows: DataFrame, name: str) -> DataFrame:
    """The rows, with the column as a value of its own. An expression that many columns read is otherwise written out, and computed, in each of them.

    It is computed in a projection before the one that sets it apart, as compiled code; what stands in a generator is interpreted.
    """
    return rows.select(*[F.explode(F.array(name)).alias(name) if x == name else x for x in rows.columns])


def apart(rows: DataFrame) -> DataFrame:
    """The rows, with every column computed once before what follows."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def parse(raw: DataFrame, schema: str) -> DataFrame:
    """value string -> columns; unreadable lines give rows of nulls and are dropped. A line is read once, however many columns are made of it."""
    return raw.select(F.inline(F.array(F.from_json("value", schema)))).filter("id is not null" if schema == MERGE_REQUEST else "key is not null")


def flatten_wide(parsed: DataFrame, p: Params) -> DataFrame:
    """The forty columns of the reports' table. ``updated`` is overwritten by ``resolved``; velocities and day counts use the raw update."""
    f = lambda x: c("fields." + x)
    local = lambda x: S.to_zone(x, p.local_offset)
    created, raw_updated, resolved = parse_ts_utc(f("created")), parse_ts_utc(f("updated")), parse_ts_utc(f("resolutiondate"))
    due, target, planned = (parse_ts_utc(f(x)) for x in ("duedate", "target_end", "planned_start"))
    times = {"created": local(created), "updated": local(F.coalesce(resolved, raw_updated)), "resolved": local(resolved)}
    parts = [part(times[x]).alias(f"{n}_{x}") for x in times for n, part in (("year", F.year), ("month", F.month))]
    size, backlog = f("size.value"), S.days_between(created, planned)
    return parsed.select(
        "key", "id", F.coalesce(f("summary"), F.lit("")).alias("summary"), F.coalesce(f("status.name"), F.lit("")).alias("status"), F.coalesce(f("issuetype.name"), F.lit("")).alias("issuetype"),
        F.coalesce(f("creator.displayName"), F.lit("Unknown")).alias("creator_name"), F.coalesce(f("assignee.displayName"), F.lit("Unassigned")).alias("assignee_name"), *[x.alias(n) for n, x in times.items()],
        F.coalesce(f("project.name"), F.lit("")).alias("project_name"), F.coalesce(f("project.id"), F.lit("")).alias("project_id"), F.coalesce(f("priority.name"), F.lit("No Priority")).alias("priority_name"),
        F.coalesce(f("priority.id"), F.lit("No Priority")).alias("priority_id"), due.alias("project_due_date"), p.now().alias("today"), S.age_days(created, p).alias("days_old"), *parts,
        S.age_days(raw_updated, p).alias("last_updated_days"), S.floor_days(raw_updated, due).alias("project_due_date_days"), S.floor_days(created, raw_updated).alias("velocity"),
        (S.days_between(created, raw_updated) * 24).alias("velocity_hours"), S.floor_days(created, raw_updated).alias("velocity_days"), target.alias("target_end_date"), planned.alias("planned_start_date"),
        F.replace(F.coalesce(f("lead.displayName"), F.lit("Unknown")), F.lit("."), F.lit(" ")).alias("business_lead"), F.coalesce(f("planning_rank"), F.lit("Unknown")).alias("planning_rank"), f("portfolio_rank").alias("portfolio_rank"),
        f("legend").alias("legend"), f("parent_project").alias("parent_project"), f("parent.key").alias("parent"), size.alias("estimated_size_name"), S.size_ordinal(size).alias("estimated_size_number"),
        backlog.alias("velocity_backlog"), F.greatest(F.lit(0).cast("long"), F.floor(backlog).cast("long")).alias("velocity_backlog_days"),
    ).withColumn("velocity_backlog_days", F.when(c("velocity_backlog").isNotNull(), c("velocity_backlog_days")))


def flatten_snapshot(parsed: DataFrame, fetched_at: Column | None = None, *also: Column) -> DataFrame:
    """The twenty columns of the store's issue table. fetched_at: by default the raw update. ``also``: further columns of the parsed record."""
    f = lambda x: c("fields." + x)
    text = lambda x, default="": F.coalesce(f(x), F.lit(default))
    updated = parse_ts_utc(f("updated"))
    return parsed.select(
        "key", c("id").cast("long").alias("id"), text("project.key").alias("project"), text("issuetype.name").alias("issuetype"), text("status.name").alias("status"), text("status.statusCategory.key").alias("status_category"),
        text("priority.name", "No Priority").alias("priority"), text("summary").alias("summary"), f("assignee.displayName").alias("assignee"), f("assignee.accountId").alias("assignee_account_id"), f("reporter.displayName").alias("reporter"),
        f("lead.displayName").alias("business_lead"), f("parent.key").alias("parent_key"), parse_ts_utc(f("created")).alias("created"), updated.alias("updated"), parse_ts_utc(f("resolutiondate")).alias("resolutiondate"),
        parse_date(f("planned_start")).alias("planned_start"), parse_date(f("target_end")).alias("target_end"), F.coalesce(f("labels"), F.array().cast("array<string>")).alias("labels"), (updated if fetched_at is None else fetched_at).alias("fetched_at"), *also,
    )


def changelog_transitions(parsed: DataFrame) -> DataFrame:
    """key, to_status (empty where missing), changed_at, seq from 0 in time order; ties by place in the history."""
    h = parsed.select("key", F.posexplode("changelog.histories").alias("hp", "h"))
    items = h.select("key", "hp", parse_ts_utc(c("h.created")).alias("changed_at"), F.posexplode("h.items").alias("ip", "i"))
    kept = items.filter("i.field = 'status' and changed_at is not null")
    w = Window.partitionBy("key").orderBy("changed_at", "hp", "ip")
    return kept.select("key", F.coalesce("i.toString", F.lit("")).alias("to_status"), "changed_at", (F.row_number().over(w) - 1).alias("seq"))


def transition_log() -> Column:
    """The transitions of one parsed record as an array of (to_status, changed_at, seq), numbered as by changelog_transitions."""
    of = lambda h, k: F.transform(F.filter(h["items"], lambda i: i["field"] == "status"), lambda i, n: F.struct(parse_ts_utc(h["created"]).alias("changed_at"), k.alias("hp"), n.alias("ip"), F.coalesce(i["toString"], F.lit("")).alias("to_status")))
    items = F.flatten(F.filter(F.transform("changelog.histories", of), lambda x: x.isNotNull()))
    kept = F.sort_array(F.filter(items, lambda x: x["changed_at"].isNotNull()))
    return F.transform(kept, lambda x, n: F.struct(x["to_status"].alias("to_status"), x["changed_at"].alias("changed_at"), n.alias("seq")))


def mr_flatten(parsed: DataFrame, *also: Column) -> DataFrame:
    path = F.coalesce(F.nullif(F.split("references.full", "!")[0], F.lit("")), c("project_id").cast("string"))
    return parsed.select("id", path.alias("project_path"), "iid", c("author.username").alias("author"), parse_ts_utc(c("merged_at")).alias("merged_at"), *also)


def mr_paths() -> Column:
    """The different changed files of one parsed record as an array of (path)."""
    paths = F.transform(F.slice("changes", 1, FILES_KEPT), lambda x: F.coalesce(F.nullif(x["new_path"], F.lit("")), x["old_path"]))
    return F.transform(F.array_distinct(F.filter(paths, lambda x: F.coalesce(x, F.lit("")) != "")), lambda x: F.struct(x.alias("path")))


def mr_changed_paths(parsed: DataFrame) -> DataFrame:
    files = parsed.select(c("id").alias("mr_id"), F.explode(F.slice("changes", 1, FILES_KEPT)).alias("x"))
    return files.select("mr_id", F.coalesce(F.nullif("x.new_path", F.lit("")), "x.old_path").alias("path")).filter("coalesce(path, '') <> ''")


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def snapshot_upsert(table: DataFrame, batch: DataFrame, key: str = "key", time: str = "fetched_at") -> DataFrame:
    """Last write wins; at equal times the batch."""
    both = table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.desc(time), F.desc("_new")]).drop("_new")


def replace_children(table: DataFrame, batch: DataFrame, key: str = "key") -> DataFrame:
    """All rows of the batch's keys are the batch's."""
    return table.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def incremental_slice(rows: DataFrame, watermark: DataFrame, time: str, margin: str) -> DataFrame:
    """Rows from the watermark less a margin on; all rows where there is none. watermark: one row, column ``at``."""
    return rows.crossJoin(F.broadcast(watermark)).filter(c("at").isNull() | (c(time) >= c("at") - F.expr(f"INTERVAL {margin}"))).drop("at")


def lookback_slice(rows: DataFrame, p: Params, days: int = 730) -> DataFrame:
    return rows.filter(c("created") >= p.now() - F.expr(f"INTERVAL '{days}' DAY"))


def write_monthly(rows: DataFrame, path: str, time: str = "created") -> None:
    """Table sink, partitioned by month."""
    rows.withColumn(f"{time}_month", F.date_format(time, "yyyy-MM")).repartition(f"{time}_month").write.partitionBy(f"{time}_month").parquet(path)
