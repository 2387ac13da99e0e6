"""A corpus from raw documents: low quality out, one of each near-duplicate group, no benchmark passages, mixed, sharded.

Every stage takes rows with nulls in any column, empty and very long texts, ties, repeated rows, more columns of any name and
empty tables; what it makes of them stands at each. Columns of documents pass through all stages; the last adds size,
text_crc32, shard and slot, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklens.llm.common import materialise, release, table
from worklens.llm.decontaminate import drop_contaminated
from worklens.llm.jaccard_join import near_duplicates_removed
from worklens.llm.mix_sources import mixed
from worklens.llm.quality_rules import drop_low_quality
from worklens.llm.shard import histogram_sort


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more. Null and empty texts are scored like any other; a null doc_id is no reason to go; without labels of both classes all stay."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.75 or more, the document of smallest doc_id (null last, ties by text); of repeated rows one. Documents without words, null ones too, stay."""
    return near_duplicates_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, wherever in the text they stand. Null and empty texts hold none; an empty benchmark lets all pass."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with their place in the mixture. A null source is a source of its own; null texts have size 1; columns named mix_* give way to its own."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard of 16 and their slot in it; slots follow the mixture, whose columns go. A null text has size 1 and checksum 0; a null doc_id is a value like any other."""
    return histogram_sort(docs, whole_rows=True, order=("mix_slot", "mix_offset")).drop("mix_size", "mix_block", "mix_slot", "mix_offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again, and goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's training has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
