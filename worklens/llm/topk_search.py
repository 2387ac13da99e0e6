"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are written once in order of their length, so every task and batch holds a range of lengths, which is cut into
buckets. For a query with k-th best score t so far, a bucket whose longest vector has length L can only matter at cosine
t / (|q| L) or more, the bucket's local threshold. Above 1 the bucket is skipped. On each of the query's largest
coordinates a vector's own coordinate must lie in the interval that this cosine leaves. Where the narrowest of these
intervals holds few enough vectors of the bucket, by a count in its sorted coordinates, the query gets coordinate pruning
there; else length pruning: only vectors of length t / |q| or more. The choice is made for every bucket and query. What
remains is multiplied out in exact integers.

Queries come in blocks of bounded bytes, each broadcast to all vectors. Start values of t are scores against the longest
``n_start`` vectors.

Defined results: vectors null, or holding null or non-finite components, and rows with a null vec_id, take no part;
vectors of another number of components than the query's are no candidates; a repeated vec_id is a row of its own both as query and as
candidate; ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.llm.common import materialise, table

#: Bytes of queries in a block, vectors in a bucket, queries multiplied at once.
BLOCK_BYTES, BUCKET, AT_ONCE = 8 << 20, 2048, 512
#: A bucket holds lengths down to this part of its longest. From this threshold on intervals are counted, on this many coordinates;
#: multiplying out one query's candidates by themselves costs about four times as much a vector as in a block of queries.
RATIO, COUNTED_FROM, FOCUS, WORTH = 0.9, 0.4, 4, 0.25
_FOUND = "q long, row long, vec_id long, score long"


class Block:
    """Queries of one block and one number of components, with their best k so far (start values only)."""

    def __init__(self, q: np.ndarray, vectors: np.ndarray):
        self.q, self.v = q, vectors
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.start = np.full(len(q), np.iinfo(np.int64).min)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b^T exactly: in doubles where no sum can pass 2^53, else in integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """Best k of each query of a block, as far as seen."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.held = [np.zeros(0, dtype=np.int64)] * 4  # query number, score, vec_id, row
        self.least = block.start.copy()
        self.pairs = self.multiplied = self.by_coordinates = 0

    def add(self, number: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        cols = [np.concatenate(x) for x in zip(self.held, (number, score, vec_id, row), strict=True)]
        order = np.lexsort((cols[3], cols[2], -cols[1], cols[0]))
        cols = [c[order] for c in cols]
        first = np.searchsorted(cols[0], cols[0])
        rank = np.arange(len(first)) - first
        self.held = [c[rank < self.k] for c in cols]
        full = cols[0][rank == self.k - 1]
        self.least[full] = np.maximum(self.least[full], cols[1][rank == self.k - 1])


class Bucket:
    """Vectors of similar length, longest first, with their directions sorted by each coordinate that is asked for."""

    def __init__(self, vectors: np.ndarray, length: np.ndarray):
        self.vectors, self.length = vectors, length
        self.unit = vectors / np.maximum(length, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._sorted[f] = order, self.unit[order, f]
        return self._sorted[f]

    def narrowest(self, block: Block, numbers: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the focus coordinate (by its place) whose feasible interval holds the fewest vectors, and where these stand in its order."""
        best = np.full(len(numbers), len(self.vectors) + 1)
        which, first = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
        for j in range(block.focus.shape[1]):
            f = block.focus[numbers, j]
            low, high = interval(block.unit[numbers, f], local)
            for g in np.unique(f):
                k = np.flatnonzero(f == g)
                _, values = self.sorted(int(g))
                a, b = np.searchsorted(values, low[k], side="left"), np.searchsorted(values, high[k], side="right")
                better = b - a < best[k]
                best[k[better]], which[k[better]], first[k[better]] = (b - a)[better], j, a[better]
        return best, which, first


def interval(x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a direction's coordinate lies if it has cosine t or more with one whose coordinate is x; open to -1 or 1 beyond the cosine."""
    t = np.minimum(t, 1.0)
    spread = np.sqrt(np.maximum(0.0, (1 - x * x) * (1 - t * t))) + 1e-9
    return np.where(x > -t, x * t - spread, -2.0), np.where(x < t, x * t + spread, 2.0)


def retrieve(best: Best, vectors: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
    """Take the vectors of a batch into account."""
    block = best.block
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order):
        top = length[order[at]]
        end = min(len(order), at + BUCKET, at + max(1, int(np.searchsorted(-length[order[at:]], -RATIO * top, side="right"))))
        members = order[at:end]
        at = end
        bucket = Bucket(vectors[members], length[members])
        low = best.least.astype(np.float64)
        local = np.where(low > 0, low / np.maximum(block.length * top, 1e-300), -1.0)  # what a cosine must reach
        active = np.flatnonzero((local <= 1 + 1e-9) & (block.length > 0) | (low <= 0))
        best.pairs += len(block.q) * len(members)
        # length pruning: how many of the bucket are long enough for each query
        need = low[active] / np.maximum(block.length[active], 1e-300)
        reached = np.where(need > 0, np.searchsorted(-bucket.length, -need * (1 - 1e-12), side="right"), len(members))
        sharp = np.flatnonzero(local[active] >= COUNTED_FROM)
        alone = np.zeros(len(active), dtype=bool)
        if len(sharp):
            held, which, first = bucket.narrowest(block, active[sharp], local[active[sharp]])
            few = held <= WORTH * reached[sharp]
            alone[sharp[few]] = True
            _by_coordinates(best, bucket, active[sharp[few]], local[active[sharp[few]]], held[few], which[few], first[few], vec_id[members], row[members])
        rest = np.flatnonzero(~alone & (reached > 0))
        rest = rest[np.argsort(-reached[rest], kind="stable")]  # queries that reach as far are multiplied together
        for a in range(0, len(rest), AT_ONCE):
            numbers, used = active[rest[a : a + AT_ONCE]], int(reached[rest[a]])
            score = products(block.v[numbers], bucket.vectors[:used])
            best.multiplied += score.size
            i, j = np.nonzero((score >= best.least[numbers][:, None]) & (block.q[numbers][:, None] != row[members[:used]][None, :]))
            if len(i):
                best.add(numbers[i], score[i, j], vec_id[members[j]], row[members[j]])


def _by_coordinates(best: Best, bucket: Bucket, numbers, local, held, which, first, vec_id: np.ndarray, row: np.ndarray) -> None:
    """Coordinate pruning: each query meets the vectors of its narrowest interval that lie in its other intervals as well."""
    block, found = best.block, []
    for n, t, count, j, a in zip(numbers.tolist(), local.tolist(), held.tolist(), which.tolist(), first.tolist(), strict=True):
        near = bucket.sorted(int(block.focus[n, j]))[0][a : a + count]
        for f in np.delete(block.focus[n], j):
            low, high = interval(block.unit[n, f], np.float64(t))
            x = bucket.unit[near, f]
            near = near[(x >= low) & (x <= high)]
        if len(near):
            score = products(block.v[n : n + 1], bucket.vectors[near])[0]
            ok = (score >= best.least[n]) & (row[near] != block.q[n])
            found.append((np.full(int(ok.sum()), n), score[ok], vec_id[near[ok]], row[near[ok]]))
        best.by_coordinates += 1
        best.multiplied += len(near)
    if found:
        best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Number of components -> (places in the batch, matrix)."""
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, dtype=np.int64)
    values = np.asarray(column.flatten()).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    return {int(d): (w := np.flatnonzero(lengths == d), values[first[w][:, None] + np.arange(d)[None, :]]) for d in np.unique(lengths) if d}


def _search(blocks: dict[int, Block], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(b, k) for d, b in blocks.items()}
        for batch in batches:
            ids, rows = np.asarray(batch.column("vec_id")), np.asarray(batch.column("row"))
            for d, (where, matrix) in _matrix(batch.column("v")).items():
                if d in best:
                    retrieve(best[d], matrix, ids[where], rows[where])
        for b in best.values():
            number, score, vec_id, row = b.held
            yield pa.RecordBatch.from_arrays([pa.array(b.block.q[number]), pa.array(row), pa.array(vec_id), pa.array(score)], names=["q", "row", "vec_id", "score"])

    return run


def _local(frame: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A bounded table on the driver: number of components -> (row, vec_id, matrix)."""
    at = frame.select("row", "vec_id", "v").toArrow().combine_chunks()
    out: dict[int, tuple] = {}
    for batch in at.to_batches():
        for d, (where, matrix) in _matrix(batch.column("v")).items():
            new = (np.asarray(batch.column("row"))[where], np.asarray(batch.column("vec_id"))[where], matrix)
            out[d] = tuple(np.concatenate(x) for x in zip(out[d], new, strict=True)) if d in out else new
    return out


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, v array<long> (floor of 256 times each component), length."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = embeddings.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad)
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    out = ok.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return out.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def top_k(vectors: DataFrame, queries, k: int = 5, block: int = BLOCK_BYTES, n_start: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` as from integer_vectors; ``queries`` is a condition on them; ``block`` in bytes."""
    vectors = materialise(vectors, "vectors")
    vectors = materialise(vectors.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length")), "by-length")
    asked = vectors.filter(queries)
    n_blocks = -(-(asked.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0) // block)
    start = _local(vectors.orderBy(F.desc("length"), "row").limit(n_start)) if n_blocks else {}
    found = None
    for b in range(n_blocks):
        blocks = {}
        for d, (q, _, matrix) in _local(asked.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b)).items():
            blocks[d] = Block(q, matrix)
            if d in start:
                first = Best(blocks[d], k)
                retrieve(first, start[d][2], start[d][1], start[d][0])
                blocks[d].start = first.least
        shared = vectors.sparkSession.sparkContext.broadcast(blocks)

        def run(batches, shared=shared):
            return _search(shared.value, k)(batches)

        part = materialise(vectors.select("row", "vec_id", "v").mapInArrow(run, _FOUND), "found")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark, sf_dir: str) -> DataFrame:
    """The five best products for each row whose vec_id is divisible by 50, against all rows."""
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r,
   CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s) WHERE rank <= 5
"""
