"""Secret spans in texts, and how widely each candidate's value is owned.

Base kinds are found by fixed patterns; in addition every run of 20 or more token characters with a digit, a letter and
enough entropy is a candidate. The hash of each candidate's value is counted over the whole corpus by distinct
repositories of each owner, and these by value. Values of up to ``max_owners`` owners look live, in however many of their repositories;
so do values of more owners of which one has nine tenths of the repositories or more: others have copied from it. Values spread over
more owners are examples. Base spans always stay; of the additional candidates only live-looking ones are spans (kind ``owned``).

Defined results: null text is empty; a null owner is a value of its own; repeated rows keep a row each; an empty table
gives an empty result; other columns are ignored. Positions are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import materialise, table

KINDS = ("assign", "access", "hex", "owned")
# Fixed patterns of the contract. re.A keeps "either case" to ASCII letters.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
OTHER = re.compile(r"[A-Za-z0-9+/_-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ENTROPY = 3.0

_SCHEMA = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,kind:int,end:int,value:string>>"


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value), by start and kind: base spans, then further candidates that touch none of them."""
    found: list[tuple[int, int, int, str]] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    longest = max(map(len, text.split()), default=0)
    if longest >= 20:
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        if longest >= 24:
            found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        taken = sorted((s, e) for s, _, e, _ in found)
        starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for m in OTHER.finditer(text):
            value = m[0]
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= MIN_ENTROPY and not ((k := bisect_left(starts, m.end())) and furthest[k - 1] > m.start()):
                found.append((m.start(), 3, m.end(), value))
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    valued = pa.struct([*span, ("value", pa.string())])
    for batch in batches:
        n: list[list[int]] = [[], [], []]
        digest, base, found = [], [], []
        for text in batch.column("text").to_pylist():
            spans = candidates(text or "")
            for k in range(3):
                n[k].append(sum(s[1] == k for s in spans))
            own = [s for s in spans if s[1] < 3]
            digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in own).encode()).hexdigest())
            base.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in own])
            found.append([{"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()} for s, k, e, v in spans])
        cols = [batch.column("doc_id"), batch.column("owner"), batch.column("repository"), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(base, pa.list_(span)), pa.array(found, pa.list_(valued))], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def examples(found: DataFrame, max_owners: int) -> DataFrame:
    """(value, owner, repository) -> value, owners, repositories of the values that are widely copied. Distinct rows first, so no value's rows meet in one task unsummed."""
    own = found.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("held"))
    spread = own.groupBy("value").agg(F.count("*").alias("owners"), F.sum("held").alias("repositories"), F.max("held").alias("most"))
    return spread.filter((F.col("owners") > max_owners) & (10 * F.col("most") < 9 * F.col("repositories"))).drop("most")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = 2) -> DataFrame:
    """doc_id, base counts and digest, all spans as text, and how many spans look live or like examples."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    scanned = materialise(rows.mapInArrow(_scan, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    found = scanned.select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    judged = found.join(examples(found, max_owners), "value", "left").select("row", "start", "kind", "end", F.col("owners").isNull().alias("live"))
    more = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), F.struct("start", "kind", "end"))).alias("owned"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])
    spans = F.array_sort(F.concat("base", F.coalesce("owned", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return scanned.join(more, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(spans, name), ",").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
