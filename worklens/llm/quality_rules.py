"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts -> shallow trees on labelled rows -> every path from a root becomes a conjunctive rule ->
lasso logistic regression keeps few of the rules -> the rules kept are one Spark column expression.

Labels, language, source and doc_id are no statistics. The model is fitted on up to ``sample`` labelled rows (those of
smallest doc_id hash), which are kept apart from the held-out quarter; every row is scored.

Defined results: null text is empty; the empty text has all statistics 0 and is scored; labels that are null are ignored
and several labels of one doc_id count by their mean; without labels, or with one class, the score is the smoothed share of class 1 (``drop_low_quality`` keeps all then); repeated rows
are scored alike; an empty table gives an empty result; other columns are ignored (by ``drop_low_quality``: kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from worklens.llm import textkernel as K
from worklens.llm.common import materialise, table

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "space", "line_feed", "not_ascii", "stops", "bang", "bar", "marks", "distinct_words",
    "top_word", "distinct_pairs", "repeated_next", "log_line_length",
)
SAMPLE, TREES, DEPTH, LASSO, ACCEPTED = 20_000, 24, 3, 0.001, 0.7
#: Classes of bytes, a number for each statistic that is a share of the bytes.
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), range(128, 256), b".,;:?", b"!", b"|", b"#$%&*@^~<>{}[]_=+\\/"), 1):
    _CLASS[list(_chars)] = _k


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = K.utf8(column)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, j in K.groups(offsets):
        n = np.diff(offsets[i : j + 1])
        text = np.repeat(np.arange(j - i), n)
        counts = np.bincount(text * 10 + _CLASS[data[offsets[i] : offsets[j]]], minlength=10 * (j - i)).reshape(-1, 10)
        words, at = K.word_hashes(data, offsets[i : j + 1])
        many = np.diff(at)
        size = np.maximum(n, 1)
        rows = out[i:j]
        rows[:, 0], rows[:, 1] = np.log1p(n), np.log1p(many)
        rows[:, 2] = (n - counts[:, 3] - counts[:, 4]) / np.maximum(many, 1)
        for k in range(1, 10):
            rows[:, 2 + k] = counts[:, k] / size
        pairs = K.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b > a:
                _, times = np.unique(words[a:b], return_counts=True)
                rows[k, 12], rows[k, 13] = len(times) / (b - a), times.max() / (b - a)
            if b - a > 1:
                rows[k, 14] = len(np.unique(pairs[a : b - 1])) / (b - a - 1)
                rows[k, 15] = (words[a : b - 1] == words[a + 1 : b]).mean()
        rows[:, 16] = np.log1p(n / (counts[:, 4] + 1))
    return out


def with_statistics(docs: DataFrame, prefix: str) -> DataFrame:
    """docs with a double column ``prefix + name`` for each statistic of ``text``."""
    names = [prefix + s for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, k]) for k in range(len(names)))], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


#: A condition is (statistic, above, threshold); a rule is a sorted tuple of conditions that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def paths(tree) -> list[Rule]:
    """Every path from the root of a fitted tree to another node."""
    found: list[Rule] = []

    def walk(node, taken: tuple) -> None:
        if taken:
            found.append(tuple(sorted(set(taken))))
        if node.subtreeDepth() > 0:
            split = node.split()
            for side, above in ((node.leftChild(), False), (node.rightChild(), True)):
                walk(side, (*taken, (split.featureIndex(), above, split.threshold())))

    walk(tree._call_java("rootNode"), ())
    return found


def rule_column(rule: Rule, prefix: str) -> Column:
    return reduce(and_, [(F.col(prefix + STATISTICS[f]) > t) if above else (F.col(prefix + STATISTICS[f]) <= t) for f, above, t in rule])


class RuleModel:
    """Intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    def score(self, prefix: str = "") -> Column:
        total = reduce(add, [F.when(rule_column(r, prefix), F.lit(w)).otherwise(0.0) for w, r in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """docs: doc_id, text; labels: doc_id, quality. The labelled sample is chosen first, so statistics are only computed for its rows."""
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    marked = marked.filter(~held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = materialise(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled-ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))  # one row a doc_id: the sample's bound holds for rows
    rows = with_statistics(texts.select("label", "doc_id", "text"), "")
    rows = materialise(rows.select("label", "doc_id", *STATISTICS), "labelled").orderBy("doc_id", *STATISTICS).coalesce(1).drop("doc_id")
    rows = materialise(rows, "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    vector = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=max(2, n // 500), featureSubsetStrategy="onethird", seed=7).fit(vector)
    rules = sorted({r for t in forest.trees for r in paths(t)})
    if not rules:
        return RuleModel(float(np.log(ones / (n - ones))), [])
    truth = rows.select("label", array_to_vector(F.array(*[rule_column(r, "").cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(truth)
    kept = [(float(w), r) for w, r in zip(lasso.coefficients, rules, strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), kept)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = with_statistics(docs, "").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPTED).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, below: float = ACCEPTED) -> DataFrame:
    """The rows of documents scored ``below`` or higher, with all columns; a null doc_id is no reason to go."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    if not model.rules:  # nothing to judge by
        return docs
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return with_statistics(docs, prefix).filter(model.score(prefix) >= below).select(*(F.col(f"`{c}`") for c in docs.columns))
