"""Tables in buckets of their key, which a batch changes together or not at all.

A commit rewrites the buckets that its keys fall into, each as a new version beside the old one, and then names all current versions
in one small file whose renaming is the commit. Readers follow the newest commit: they never see one table with a batch and another
without it, and what they read doesn't depend on the number of batches. A batch that failed before its commit is done again into
the same version; one that is committed already is not done again. Versions that only older commits than the last ``keep`` name are deleted.

Rules: of several rows of a key the one of greatest time stays (null is the smallest), at equal times that of the later batch, within a batch
the greater one by its columns in order. Children follow their parent: they are replaced where the parent's row is, and only there.
A table is written by one stream at a time.

Files of a version hold more columns than the table: ``_n`` and ``_later`` (rows given of the key, and whether the row is the batch's), and nested children as arrays.
What a commit counts is read from them, and a batch's rows are computed once: they go through one exchange, by bucket and part, which serves both the choice of the newest row and the files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass
class Upsert:
    """Rows of a table with one row a key, and rows of other tables that belong to them by the same key.

    ``nested``: tables whose rows stand in the rows themselves, in a column that is an array of structs; the column is no part of the table.
    """

    rows: DataFrame
    key: str
    time: str
    children: dict[str, DataFrame] = field(default_factory=dict)
    nested: dict[str, str] = field(default_factory=dict)


def newest(rows: DataFrame, key: str, *time: Column) -> DataFrame:
    """One row of each key, the greatest by ``time``, then by its columns in order. A partial aggregate, no window. The rows stay dealt out by key: the key is that of the groups."""
    order = F.struct(*[t.alias(f"_{i}") for i, t in enumerate(time)], F.struct(*rows.columns).alias("_row"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_top")).select(*[F.col("_key").alias(x) if x == key else F.col(f"_top._row.{x}") for x in rows.columns])


class Store:
    """Tables below one folder of the cluster's file system. The number of buckets is that of the first commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, keep: int = 2):
        self.spark, self.root, self.buckets, self.keep = spark, root.rstrip("/"), buckets, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if (n := self.last()) is not None:
            self.buckets = self._read(f"state-{n}")["buckets"]

    # small files

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{name}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> None:
        """Write a file under another name and rename it: it is there as a whole or not."""
        there, made = self._path(f"{self.root}/_commits/{name}.json"), self._path(f"{self.root}/_commits/_{name}.tmp")
        stream = self._fs.create(made, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        self._fs.delete(there, False)
        if not self._fs.rename(made, there):
            raise OSError(f"{there} could not be written")

    def last(self) -> int | None:
        """Number of the newest commit."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[7:-5]) for n in names if n.startswith("commit-")), default=None)

    # reading

    def _state(self, number: int | None = None) -> dict:
        number = self.last() if number is None else number
        return {"buckets": self.buckets, "tables": {}} if number is None else self._read(f"state-{number}")

    def _rows(self, state: dict, name: str, buckets: set[int] | None, schema: StructType | None = None) -> DataFrame:
        known = state["tables"].get(name)
        if known is not None:
            schema = StructType.fromJson(known["schema"])
            paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, (v, _) in known["versions"].items() if buckets is None or int(b) in buckets]
            if paths:
                return self.spark.read.schema(schema).parquet(*paths)
        if schema is None:
            raise ValueError(f"no commit has written {name}")
        return self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A table as of the newest commit."""
        return self._rows(self._state(), name, None)

    def rows_of(self, name: str, key: str, values: list) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        kind = self.table(name).schema[key].dataType
        wanted = self.spark.createDataFrame([(v,) for v in values], StructType([StructField(key, kind)]))
        hit = {r["bucket"] for r in wanted.select(self._bucket(key)).collect()}
        return self._rows(self._state(), name, hit).join(wanted.distinct(), key, "left_semi")

    def audit(self) -> DataFrame:
        """A row for each commit: what was fetched, what the tables hold, and how far the data reach."""
        if self.last() is None:
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(f"{self.root}/_commits/commit-*.json")

    def watermark(self):
        """Greatest time of all committed rows; None before the first commit, which asks for everything."""
        return self.audit().agg(F.max("watermark")).first()[0]

    # writing

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _newest(self, rows: DataFrame, key: str, time: str) -> DataFrame:
        """One row of each key with ``_n``, the number of its rows, and its bucket. A bucket's rows are dealt out to as many tasks as the shuffle has."""
        parts = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        part = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 24), F.lit(parts)).alias("_part")
        rest = [x for x in rows.columns if x not in (key, time, "_later")]
        dealt = rows.select("*", self._bucket(key), part).repartition("bucket", "_part")
        top = dealt.groupBy("bucket", "_part", key).agg(F.max(F.struct(time, "_later", *rest)).alias("_top"), F.count("*").alias("_n"))
        return top.select(*[F.col(x) if x == key else F.col(f"_top.{x}") for x in rows.columns], "_n", "bucket")

    def _path_of(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/v={number}"

    def _version(self, name: str, number: int, schema: StructType) -> DataFrame:
        """Columns of a version's files, and the bucket."""
        return self.spark.read.schema(StructType([*[f for f in schema.fields if f.name != "bucket"], StructField("bucket", IntegerType())])).parquet(self._path_of(name, number))

    def _write(self, name: str, rows: DataFrame, key: str, number: int) -> dict[int, int]:
        """Write a version of the touched buckets; bucket -> rows. Rows with their bucket are written as they are dealt out; others are dealt out, large buckets to several files, small ones to one."""
        rows = rows if "bucket" in rows.columns else rows.select("*", self._bucket(key)).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._path_of(name, number))
        return {r["bucket"]: r["count"] for r in self._version(name, number, rows.schema).groupBy("bucket").count().collect()}

    def commit(self, changes: dict[str, Upsert], stream: str = "", batch: int | None = None) -> int | None:
        """Bring all changes into the tables at once and return the commit's number, or None if this batch of the stream is in already."""
        before = self.last()
        if before is not None and batch is not None:
            done = self._read(f"commit-{before}")
            if done["stream"] == stream and done["batch"] >= batch:
                return None
        number = 0 if before is None else before + 1
        old = self._state(before)
        new = json.loads(json.dumps(old))
        fetched, reach = {}, []
        for name, change in changes.items():
            key, nested = change.key, change.nested
            schema = StructType([f for f in change.rows.schema.fields if f.name not in nested.values()])
            merged = self._newest(change.rows.select("*", F.lit(1).alias("_later")), key, change.time)
            files, given = merged.schema, name
            if old["tables"].get(name, {}).get("versions"):
                given = f"_batch/{name}"
                touched = set(self._write(given, merged, key, number))
                later = self._version(given, number, files).drop("_n", "bucket")
                none = {x: F.lit(None).cast(later.schema[x].dataType) for x in nested.values()}
                current = self._rows(old, name, touched, schema).withColumns({**none, "_later": F.lit(0)})
                merged = self._newest(current.unionByName(later), key, change.time)
            written = self._write(name, merged, key, number)
            touched = touched if given != name else set(written)
            held = self._version(given, number, files)
            sizes = [F.coalesce(F.sum(F.when(F.col(x).isNotNull(), F.size(x))), F.lit(0)).cast("long").alias(x) for x in nested.values()]
            top = held.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.max(change.time).cast("timestamp_ntz").cast("string").alias("_at"), *sizes).first()
            fetched |= {name: top["_n"]} | {child: top[x] for child, x in nested.items()}
            reach += [top["_at"]] * (top["_at"] is not None)
            self._keep_state(new, old, name, schema, touched, written, number)
            taken = self._version(name, number, files).filter("_later = 1")
            for child, x in nested.items():
                now = taken.select(key, F.inline(x), "bucket")
                self._replace(new, old, child, key, now, taken, touched, number)
            for child, own in change.children.items():
                path = self._path_of(f"_batch/{child}", number)
                own.write.mode("overwrite").parquet(path)
                own = self.spark.read.schema(own.schema).parquet(path)
                fetched[child] = own.count()
                self._replace(new, old, child, key, own.join(taken.select(key), key, "left_semi"), taken, touched, number)
        self._put(f"state-{number}", new)
        total = {name: sum(n for _, n in t["versions"].values()) for name, t in new["tables"].items()}
        self._put(f"commit-{number}", {"number": number, "stream": stream, "batch": -1 if batch is None else batch, "whole": before is None, "fetched": fetched, "total": total, "watermark": max(reach, default=None)})
        self._fs.delete(self._path(f"{self.root}/_batch"), True)
        self._forget(number)
        return number

    def _replace(self, new: dict, old: dict, child: str, key: str, now: DataFrame, taken: DataFrame, touched: set[int], number: int) -> None:
        """Write the touched buckets of a children's table: what was there, less all rows of the keys taken, and theirs of now."""
        schema = now.drop("bucket").schema
        if old["tables"].get(child, {}).get("versions"):
            kept = self._rows(old, child, touched, schema).join(taken.select(key), key, "left_anti")
            now = kept.unionByName(now.drop("bucket"))
        self._keep_state(new, old, child, schema, touched, self._write(child, now, key, number), number)

    def _keep_state(self, new: dict, old: dict, name: str, schema: StructType, touched: set[int], written: dict[int, int], number: int) -> None:
        versions = dict(old["tables"].get(name, {"versions": {}})["versions"])
        for b in touched:
            versions.pop(str(b), None)
            if b in written:
                versions[str(b)] = [number, written[b]]
        new["tables"][name] = {"schema": json.loads(schema.json()), "versions": versions}

    def _forget(self, number: int) -> None:
        """Delete what only the commit before the last ``keep`` named, and its list."""
        gone = number - self.keep
        if gone < 0 or not self._fs.exists(self._path(f"{self.root}/_commits/state-{gone}.json")):
            return
        older, later = self._read(f"state-{gone}"), self._read(f"state-{gone + 1}")
        for name, t in older["tables"].items():
            kept = later["tables"][name]["versions"]
            for b, (v, _) in t["versions"].items():
                if b not in kept or kept[b][0] != v:
                    self._fs.delete(self._path(f"{self.root}/{name}/v={v}/bucket={b}"), True)
        self._fs.delete(self._path(f"{self.root}/_commits/state-{gone}.json"), False)


AUDIT = "number long, stream string, batch long, whole boolean, fetched map<string,long>, total map<string,long>, watermark timestamp_ntz"
