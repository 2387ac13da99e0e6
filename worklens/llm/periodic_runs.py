"""Periodic runs of words in texts, found by seeds on diagonals.

A run has smallest period q and at least max(24, 3 q) words, so on lag q at least max(24 - q, 2 q) neighbouring words repeat.
Lags are taken in classes of q from 2^j to 2^(j+1) - 1. Each class has its own index of k-grams, k being the least such
overlap in the class, 16 words or more. As k is never under q, no k-gram of a run occurs again less than q words later (two
periods over so many words would have a common divisor as period), so *neighbouring* occurrences of a k-gram are all the
pairs that are needed: a text of n words gives fewer than n pairs a class, however often something is repeated in it. A pair
is a seed on its lag. It is extended both ways word by word, a table of the furthest covered word of every lag drops seeds
that an earlier extension has passed. Texts in which no 16 words occur twice, most of them, end after the first index.

A text is searched whole in one task; memory and time are in proportion to it, with a factor log(n) for texts with
repeats. Nothing is shuffled.

Defined results: null, empty and blank texts have no words, no runs, four nulls and the digests of nothing; a null doc_id
keeps its words as they are; repeated rows keep a row each; an empty table gives an empty result; other columns are ignored.
Hashes propose, words decide: an extension compares the words themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import table
from worklens.llm.textkernel import mix, powers

LEAST_WORDS, LEAST_PERIODS = 24, 3
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def folded(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's planted repetition: in a tenth of all documents words from a on repeat the first p from a."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]


def _grams(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place, alike wherever they stand."""
    n = len(prefix) - 1
    return (prefix[k:] - prefix[: n - k + 1]) * powers(n + 1, -1)[: n - k + 1]


def _seeds(grams: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of neighbouring occurrences of a k-gram at lags of the class, in that order, without those that follow one on the same lag."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    place = order[:-1][same]
    lag = order[1:][same] - place
    fits = (lag >= least) & (lag <= most)
    lag, place = lag[fits], place[fits]
    order = np.lexsort((place, lag))
    lag, place = lag[order], place[order]
    first = np.ones(len(lag), dtype=bool)
    first[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return lag[first], place[first]


def _extended(words: list[bytes], at: int, q: int) -> int:
    """The first place from ``at`` on where the word q later is another, or where the text ends."""
    end, step = len(words) - q, 64
    while at < end:
        to = min(end, at + step)
        if words[at:to] != words[at + q : to + q]:
            while words[at] == words[at + q]:
                at += 1
            return at
        at, step = to, 2 * step
    return end


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n, found = len(words), []
    if n < LEAST_WORDS:
        return found
    codes = mix(np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * powers(n + 1)[:n], out=prefix[1:])
    shortest = np.sort(_grams(prefix, 16))
    if not (shortest[1:] == shortest[:-1]).any():
        return found
    least = 1
    while LEAST_PERIODS * least <= n:
        most = 2 * least - 1
        k = max(LEAST_WORDS - most, 2 * least)
        covered: dict[int, int] = {}
        if n >= k + least:
            for q, i in zip(*(x.tolist() for x in _seeds(_grams(prefix, k), least, most)), strict=True):
                if i < covered.get(q, 0):
                    continue
                start, end = i, _extended(words, i, q)
                while start and words[start - 1] == words[start - 1 + q]:
                    start -= 1
                covered[q] = end
                if end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.append((start, end - start + q, q))
        least *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def described(doc_id: int | None, text: str | None, fold: bool) -> tuple:
    """A row of ``find_runs``."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white spaces, nothing else
    if fold:
        words = folded(words, doc_id)
    runs = runs_of(words)
    best: tuple = (None, None, None)
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:  # runs come by start, then period: ties keep the first
            best = r
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, q in runs:
            change[start + q] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, digest, hashlib.sha256(b" ".join(words)).hexdigest())


def find_runs(docs: DataFrame, fold: bool = False) -> DataFrame:
    """A row a document: its runs of words, the one of greatest exponent, and the digest of the text without repetitions. ``fold`` plants repetitions first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(d, t, fold) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _SCHEMA)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs in every document, with the planted repetitions."""
    return find_runs(table(spark, sf_dir, "documents"), fold=True)
