"""What the training-data operators share: table access, written steps, the shared folder, bit filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a filter at most: as rows of 32 bits it is broadcast, about 20 MB.
MOST_BITS = 1 << 24


#: Bytes of rows that go to a Python worker at once. Texts may be long, and an executor holds a batch on both sides.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session send Arrow batches of BATCH_BYTES; Spark's default is 64 MB. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one below the warehouse, or in local mode a temporary one."""
    bound_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="worklens-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/worklens-steps"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a step as a table in the shared folder and read it again: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*steps: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """A-Z become a-z; all other characters stay."""
    return F.translate(col, UPPER, UPPER.lower())


class BitFilter:
    """A set of 64-bit hashes as bits: rows that it lets through may be in the set, others are not.

    Its size follows the number of hashes up to MOST_BITS; beyond, it lets more rows through, which the join behind it drops.
    """

    def __init__(self, wanted: DataFrame, key: str):
        n, bits = wanted.count(), 1 << 16
        while bits < min(MOST_BITS, 16 * n):
            bits *= 2
        self.mask = bits - 1
        self.words = wanted.groupBy(self._word(key).alias("filter_word")).agg(F.bit_or(self._bit(key)).alias("filter_bits"))

    def _word(self, key: str) -> Column:
        return F.shiftright(F.col(key).bitwiseAND(F.lit(self.mask)), 5)

    def _bit(self, key: str) -> Column:
        return F.expr(f"shiftleft(1L, cast({key} & 31 as int))")

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may be in the set, rows that are not)."""
        joined = rows.withColumn("filter_word", self._word(key)).join(F.broadcast(self.words), "filter_word", "left")
        inside = F.coalesce(F.col("filter_bits").bitwiseAND(self._bit(key)) != 0, F.lit(False))
        return joined.filter(inside).select(*rows.columns), joined.filter(~inside).select(*rows.columns)

    def maybe(self, rows: DataFrame, key: str) -> DataFrame:
        return self.split(rows, key)[0]
