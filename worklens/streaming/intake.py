"""Continuous intake with Structured Streaming into tables of ``sources.keyed``.

A micro-batch is one commit: snapshots, their transitions, merge requests with their files, and the audit row become visible
together. A batch that fails leaves tables, audit and watermark as they were and is read again from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worklens.sources import ingest as I
from worklens.sources.keyed import Store, Upsert


def _lines(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)


def issue_changes(lines: DataFrame) -> dict[str, Upsert]:
    """JSON lines of issues -> snapshots and the transitions of the same reading. Of a key that comes twice, the newer line; at equal times the greater by its columns, then its transitions."""
    return {"issues": Upsert(I.flatten_snapshot(I.parse(lines, I.SNAPSHOT), None, I.transition_log().alias("log")), "key", "updated", nested={"transitions": "log"})}


def mr_changes(lines: DataFrame) -> dict[str, Upsert]:
    """JSON lines of merge requests -> merge requests and their changed files, (id, path)."""
    return {"merge_requests": Upsert(I.mr_flatten(I.parse(lines, I.MERGE_REQUEST), I.mr_paths().alias("paths")), "id", "merged_at", nested={"mr_files": "paths"})}


def commit_stream(stream: DataFrame, store: Store, changes: Callable[[DataFrame], dict[str, Upsert]], checkpoint: str, trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    """Start a stream whose micro-batches are commits of a store. The query's id, kept in the checkpoint, tells a repeated batch from one of another stream.

    A commit reads a change's rows once, so a batch isn't kept; a change that makes several frames of it reads it as often.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        store.commit(changes(batch), stream=batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint, batch=epoch)

    writer = stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def sync_cycle(store: Store, lines: DataFrame, changes: Callable[[DataFrame], dict[str, Upsert]], time: str, schema: str, margin: str = "2 minutes") -> int | None:
    """One cycle without a stream: everything where nothing is committed yet, else the lines whose time is at or after the watermark less a margin. Returns the commit's number."""
    reach = store.watermark()
    if reach is not None:
        parsed = lines.select("value", F.from_json("value", schema).alias("r")).withColumn("at", I.parse_ts_utc(F.col(f"r.{time}")))
        lines = parsed.filter(F.col("at") >= F.lit(reach).cast("timestamp_ntz") - F.expr(f"INTERVAL {margin}")).select("value")
    return store.commit(changes(lines))


def run_issue_stream(spark: SparkSession, source: str, target: str, trigger: dict | None = None, files_per_batch: int = 2, buckets: int = 64) -> StreamingQuery:
    """JSON lines of issues -> tables issues and transitions. ``trigger`` as for DataStreamWriter.trigger; by default what is there now."""
    return commit_stream(_lines(spark, source, files_per_batch), Store(spark, target, buckets), issue_changes, f"{target}/checkpoint", trigger)


def run_mr_stream(spark: SparkSession, source: str, target: str, trigger: dict | None = None, files_per_batch: int = 2, buckets: int = 64) -> StreamingQuery:
    """JSON lines of merge requests -> tables merge_requests and mr_files."""
    return commit_stream(_lines(spark, source, files_per_batch), Store(spark, target, buckets), mr_changes, f"{target}/checkpoint", trigger)


def daily_completions(transitions: DataFrame, bound: str = "7 days") -> DataFrame:
    """day, n of Done transitions, with late rows up to the bound. In update mode state goes once its day is past the bound."""
    done = transitions.filter("to_status = 'Done'").withWatermark("changed_at", bound)
    return done.groupBy(F.window("changed_at", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


def run_completions(transitions: DataFrame, target: str, trigger: dict | None = None, bound: str = "7 days", buckets: int = 16) -> StreamingQuery:
    """A stream of transitions -> table days. Each batch brings the new counts of the days that it touches; days past the bound are final and leave the state."""
    store = Store(transitions.sparkSession, target, buckets)
    counted = lambda batch: {"days": Upsert(batch, "day", "day")}
    return commit_stream(daily_completions(transitions, bound), store, counted, f"{target}/checkpoint", trigger, "update")
