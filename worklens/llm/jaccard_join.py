r"""Jaccard metric-space join on sets of word shingles: pivots, Voronoi regions, windows by the triangle inequality, recursion. Exact.

Equal sets are one node from the start. r = 1 - t is the radius within which two nodes link. Regions are made in levels:

1. *Part pivots.* Unrelated texts have distance 1, so document pivots tell them apart only once they have something in
   common. All shingles are put in one order, rare ones first. For a shingle s let L(s) be the shingles before it; then
   d_s(x, y) = |(x n L(s)) /\ (y n L(s))| is a pseudo-metric below the symmetric difference, which for linked x and y is at
   most |x| r / t. The pivot of s is {s}, with d_s(x, {s}) = |x n L(s)| for every x that holds s. A node's nearest pivot is the one
   of its first shingle (distance 0). A linked y has |x - y| <= r |x|, so its window of pivots is those of distance r |x| at most:
   floor(r |x|) + 1 regions. Nodes up to place r |x| / (1 + t) are owners of the region, the others visit it: of every
   linked pair one is an owner where its first common shingle is the pivot.
2. *Document pivots.* In every region the owner of smallest hash is a pivot. All members that can link to it are measured
   against it; members within r are its ball and need no links among themselves.
3. *Medians, recursively.* Regions in which more than ``small`` members of several components are left are put together
   where they share members (each node is in one such region), and get the median of their members' sets (the shingles of more than half of them) as pivot m.
   By the triangle inequality members with |x /\ m| + |y /\ m| within the allowed difference link for certain; one member,
   the nearest to m, stands for all of these. Any other linked pair has an element of x /\ m and y /\ m in common: these
   residual sets, in which what the region shares is gone, are joined again by their part pivots, and what is still too
   large gets medians of its own, up to ``deepest`` levels down.
4. In a small region owners meet members of other components: |d(x, p) - d(y, p)| <= r, sizes, places and the common
   part of both lists of first shingles decide which pairs are measured.

Distances are counted on whole sets, in integers (100 * intersection >= 75 * union). Frequencies are counted over all
documents in hash slots; they only choose the order, so the number of slots cannot change a result.

Defined results: a text without words, or null, has an empty set and no links; fewer words than a shingle make one
shingle; a null doc_id never is a component's id unless all are null; rows with repeated doc_id each keep a row; an
empty table gives an empty result; other columns are ignored (by ``near_duplicates_removed``: kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.llm import textkernel as K
from worklens.llm.common import BitFilter, materialise, release, table
from worklens.llm.components import components, more_links

#: Slots in which shingles are counted: about one for four shingles, up to 2^24 (16 MB as levels). They come in ranges of 2^RANGE_BITS.
LEAST_BITS, MOST_BITS, RANGE_BITS = 16, 24, 14
#: Open members of a region that meet without more pivots (16 times as many with every level, for residual sets rule out most), and levels at most.
SMALL, DEEPEST = 64, 4
_SIGNED = "doc_id long, th long, n long, node long, range int, slots binary"


def _node(s: np.ndarray) -> np.ndarray:
    """The hash of a set, as an array of one."""
    return K.mix(K.mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))


def _packed(slots: np.ndarray) -> bytes:
    """Sorted numbers as steps of one byte; 255 goes on without a number."""
    steps = np.diff(slots, prepend=0)
    more, rest = steps // 255, steps % 255
    out = np.full(int(more.sum()) + len(steps), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _signatures(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            n, node = [], []
            for s in K.shingle_sets(batch.column("text"), size):
                held.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                n_held += len(s)
                n.append(len(s))
                node.append(_node(s)[0] if len(s) else 0)
            node = pa.array(K.signed(np.array(node, dtype=np.uint64)), mask=np.array(n) == 0) if n else pa.array([], pa.int64())
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("th"), pa.array(n, pa.int64()), node, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield _signed_batch(columns)
            if n_held > 1 << 21:
                yield counted(held)
                held, n_held = [], 0
        if n_held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        slots = np.sort(np.concatenate(held))
        edges = np.arange((1 << max(0, bits - RANGE_BITS)) + 1)
        cuts = np.searchsorted(slots, edges << RANGE_BITS)
        parts = [(int(r), _packed(slots[a:b].astype(np.int64) - (int(r) << RANGE_BITS))) for r, a, b in zip(edges[:-1], cuts[:-1], cuts[1:], strict=True) if b > a]
        none = pa.nulls(len(parts), pa.int64())
        return _signed_batch([none, none, none, none, pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())])

    def _signed_batch(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "node", "range", "slots"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All parts of some ranges -> (range, a byte for each slot: eight times the binary logarithm of its count)."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, data in zip(batch.column("range").to_pylist(), batch.column("slots"), strict=True):
            found = np.bincount(_unpacked(data.as_buffer()), minlength=1 << RANGE_BITS)
            counts[r] = counts[r] + found if r in counts else found
    levels = [np.minimum(255, 8 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in counts.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(levels, pa.binary())], names=["range", "levels"])


def _order(signed: DataFrame, bits: int) -> np.ndarray:
    """The level of every slot; 2^24 bytes at most come to the driver."""
    parts = signed.filter("range is not null").select("range", "slots").repartition("range").mapInArrow(_levels, "range int, levels binary")
    out = np.zeros(max(1 << bits, 1 << RANGE_BITS), dtype=np.uint8)
    for r in parts.toLocalIterator(prefetchPartitions=True):
        out[r["range"] << RANGE_BITS : (r["range"] + 1) << RANGE_BITS] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def _once(batch: pa.RecordBatch) -> pa.Array:
    """Texts of a batch, each once."""
    first = np.unique(np.asarray(batch.column("th")), return_index=True)[1]
    return batch.column("text") if len(first) == batch.num_rows else batch.column("text").take(pa.array(first))


def _regions(size: int, level: np.ndarray, bits: int, percent: int):
    """(shingle, node, n, place) of the first regions of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for s in K.shingle_sets(_once(batch), size):
                if not len(s):
                    continue
                k = (100 - percent) * len(s) // 100 + 1
                key = (level[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = np.argpartition(key, k - 1)[:k]
                first = first[np.argsort(key[first], kind="stable")]
                parts.append((s[first], np.full(k, _node(s)[0]), np.full(k, len(s), dtype=np.int32), np.arange(k, dtype=np.int32)))
                if len(parts) >= 2000:
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    def _batch(parts: list[tuple]) -> pa.RecordBatch:
        shingle, node, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(K.signed(shingle)), pa.array(K.signed(node)), pa.array(n), pa.array(place)], names=["shingle", "node", "n", "place"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets, held = [], [], 0
            for s in K.shingle_sets(_once(batch), size):
                if len(s):
                    node.append(int(K.signed(_node(s))[0]))
                    sets.append(K.signed(s))
                    held += len(s)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
                    node, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


class Measure:
    """Exact intersections of pairs of nodes. Sets are computed again from the texts, once for each node that a pair names."""

    def __init__(self, docs: DataFrame, signed: DataFrame, first: DataFrame, size: int, percent: int):
        self.texts = docs.select(F.xxhash64("text").alias("th"), "text")
        self.of_node = signed.filter("node is not null").groupBy("node").agg(F.min("th").alias("th"))
        self.first, self.size, self.percent, self.sets = first, size, percent, None

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets can still share enough, given how many of their first shingles they share.

        All shared shingles up to the nearer end of the two lists are in both lists, so besides those only the rest of
        the set whose list ends there can be shared.
        """
        a, b = (self.first.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("list").alias("l" + c)) for c in "ab")
        rest = lambda n: n - F.floor((100 - self.percent) * n / 100) - 1
        most = F.size(F.array_intersect("la", "lb")) + F.greatest(rest(F.col("na")), rest(F.col("nb")))
        kept = pairs.join(a, "a").join(b, "b").filter((100 + self.percent) * most >= self.percent * (F.col("na") + F.col("nb")))
        return materialise(kept.select("a", "b"), "plausible")

    def _want(self, nodes: DataFrame) -> None:
        """Compute the sets of nodes that are not there yet."""
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        wanted = materialise(nodes.join(self.of_node, "node"), "wanted-sets")
        texts = BitFilter(wanted, "th").maybe(self.texts, "th").mapInArrow(_sets(self.size), "node long, shingles array<long>")
        sets = texts.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets = materialise(sets, "sets")
        self.sets = sets if self.sets is None else self.sets.unionAll(sets)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, rest): the whole sets of nodes."""
        self._want(nodes.select("node").distinct())
        return self.sets.withColumnRenamed("shingles", "rest")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """(a, b) -> (a, b, linked, d)."""
        self._want(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
        a, b = (self.sets.select(F.col("node").alias(c), F.col("shingles").alias("s" + c)) for c in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
        union = F.col("na") + F.col("nb") - F.col("shared")
        return materialise(both.select("a", "b", (100 * F.col("shared") >= self.percent * union).alias("linked"), (1 - F.col("shared") / union).alias("d")), "measured")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _possible(x: str, y: str, percent: int) -> Column:
    """Can two members whose first common element is the region's link? Each has ``size`` elements, of which ``place`` stand before it."""
    n, m, sx, sy, px, py = (F.col(c + s) for c, s in (("n", x), ("n", y), ("size", x), ("size", y), ("place", x), ("place", y)))
    differ = sx + sy - 2 * F.least(sx - px, sy - py)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _owner(percent: int) -> Column:
    """Of a linked pair both can't stand behind these places, for all before the first common element is different."""
    return ((100 + percent) * F.col("place") <= (100 - percent) * F.col("n")).alias("owner")


def _named(rows: DataFrame, suffix: str, keep: tuple[str, ...] = ("cell",)) -> DataFrame:
    return rows.select(*(F.col(c).alias(c if c in keep else c + suffix) for c in rows.columns))


def _open(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Cells in which an owner and a member of another component are left, with components and the number of members."""
    rows = cells.join(found.withColumnRenamed("comp", "linked_to"), "node", "left").withColumn("comp", F.coalesce("linked_to", "node")).drop("linked_to")
    busy = rows.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("owner").alias("owned"), F.count("*").alias("members"))
    return materialise(rows.join(busy.filter("low <> high and owned").select("cell", "members"), "cell"), "open-cells")


def _around_medians(large: DataFrame, residual: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    r"""Regions that are too large, and their members' sets -> (regions around medians, links that are certain, residual sets).

    |x /\ y| = |(x /\ m) /\ (y /\ m)| for any m, so a residual set x /\ m stands for x. With e(x) = (100 + p) |x /\ m| - (100 - p) |x| two members
    link for certain where e(x) + e(y) <= 0, and then both link to the one of smallest e. All others must have an element of their residual sets in common.
    """
    of_node = components(large.select(F.col("cell").alias("a"), F.col("node").alias("b"))).withColumnRenamed("comp", "region")
    rows = materialise(large.select("node", "n").distinct().join(of_node, "node").join(residual, "node"), "large-regions")
    members = rows.groupBy("region").agg(F.count("*").alias("members"))
    median = rows.select("region", F.explode("rest").alias("s")).groupBy("region", "s").count().join(members, "region").filter("2 * count > members")
    median = median.groupBy("region").agg(F.collect_list("s").alias("median"))
    rest, median_of = F.col("rest"), F.coalesce("median", F.array().cast("array<long>"))
    moved = rows.join(median, "region", "left").withColumn("rest", F.concat(F.array_except(rest, median_of), F.array_except(median_of, rest)))
    excess = ((100 + percent) * F.size("rest") - (100 - percent) * F.col("n")).alias("e")
    moved = materialise(moved.select("region", "node", "n", "rest", excess), "residual-sets")
    centre = moved.groupBy("region").agg(F.min(F.struct("e", "node")).alias("c"))
    certain = moved.join(centre, "region").filter((F.col("node") != F.col("c.node")) & (F.col("e") + F.col("c.e") <= 0)).withColumn("centre", F.col("c.node"))
    elements = moved.select(F.explode("rest").alias("s"), "node", "n", F.size("rest").alias("size"), F.xxhash64("region", "s").alias("cell"))
    often = elements.groupBy("cell").agg(F.count("*").alias("times"))
    rows = elements.join(often, "cell").groupBy("node").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("times", "cell"))).alias("cells"))
    rows = rows.select("node", "n", "size", F.posexplode("cells").alias("place", "of")).filter((F.col("of.times") > 1) & (percent * F.col("place") <= (100 - percent) * F.col("n")))
    cells = rows.select("of.cell", "node", "n", "size", "place", _owner(percent), F.lit(None).cast("double").alias("d"))
    return materialise(cells, "regions"), materialise(certain.select(*_pair("node", "centre")), "certain-links"), moved.select("node", "rest")


def similarity_classes(docs: DataFrame, size: int = 5, percent: int = 75, small: int = SMALL, deepest: int = DEEPEST) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, node (hash of the set, null if empty), component_id (smallest doc_id reachable) of every row."""
    spark, radius = docs.sparkSession, (100 - percent) / 100
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    shingles = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(MOST_BITS, max(LEAST_BITS, (shingles // 4).bit_length()))
    signed = materialise(texts.mapInArrow(_signatures(size, bits), _SIGNED), "signatures")
    order = spark.sparkContext.broadcast(_order(signed, bits))

    def emit(batches):
        return _regions(size, order.value, bits, percent)(batches)

    members = materialise(texts.select("th", "text").mapInArrow(emit, "shingle long, node long, n int, place int"), "members")
    order.unpersist()
    often = materialise(members.groupBy("shingle").count().filter("count > 1").select("shingle"), "shared-regions")
    cells = BitFilter(often, "shingle").maybe(members, "shingle").join(often, "shingle").dropDuplicates(["shingle", "node"])
    cells = materialise(cells.select(F.col("shingle").alias("cell"), "node", "n", F.col("n").alias("size"), "place", _owner(percent)), "regions")
    release(members, often)

    first = materialise(cells.groupBy("node").agg(F.first("n").alias("n"), F.collect_set("cell").alias("list")), "first-shingles")
    measure = Measure(docs, signed, first, size, percent)
    pivot = F.min(F.when(F.col("owner"), F.struct("node", "n", "place")))
    pivots = cells.groupBy("cell").agg(pivot.alias("p"), F.count("*").alias("members")).filter("members > 1 and p is not null")
    cells = cells.join(pivots.select("cell", F.col("p.node").alias("nodep"), F.col("p.n").alias("np"), F.col("p.place").alias("placep")), "cell")
    cells = materialise(cells, "in-regions")
    stars = cells.filter(F.col("node") != F.col("nodep")).withColumnsRenamed({"n": "nx", "size": "sizex", "place": "placex"}).withColumn("sizep", F.col("np"))
    stars = stars.filter(_possible("x", "p", percent)).select(*_pair("node", "nodep")).distinct()
    done = measure(measure.plausible(stars))
    links = done.filter("linked").select("a", "b")
    found = components(links)
    left = cells.filter("node <> nodep").withColumns(dict(zip("ab", _pair("node", "nodep"), strict=True)))
    left = left.join(done.select("a", "b", "d"), ["a", "b"], "left").select("cell", "node", "n", "size", "place", "owner", "d")
    depth, residual = 0, None
    while not (left := _open(left, found)).isEmpty():
        most = small << 4 * depth if depth < deepest else 1 << 62
        near, large = left.filter(F.col("members") <= most), left.filter(F.col("members") > most)
        x, y = _named(near.filter("owner"), "x"), _named(near, "y")
        pairs = x.join(y, "cell").filter((F.col("compx") != F.col("compy")) & _possible("x", "y", percent))
        pairs = pairs.filter(F.coalesce(F.abs(F.col("dx") - F.col("dy")) <= radius + 1e-9, F.lit(True)))
        pairs = pairs.select(*_pair("nodex", "nodey")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
        measured = measure(measure.plausible(pairs))
        done, links = done.unionAll(measured), measured.filter("linked").select("a", "b")
        if large.isEmpty():
            found = more_links(found, links)
            break
        left, certain, residual = _around_medians(large, residual or measure.sets_of(large), percent)
        found, depth = more_links(found, links.unionAll(certain)), depth + 1

    rows = signed.filter("range is null").select("doc_id", "th", F.col("n").alias("n_shingles"), "node")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    nodes = nodes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = nodes.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = nodes.join(ids, "comp").select("node", "comp", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(ids, "node", "left").select("doc_id", "th", "n_shingles", "node", "comp", component.alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return similarity_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def near_duplicates_removed(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The documents with one row of each component: the one of smallest doc_id (null last), then of smallest text hash; of repeated rows one.

    Documents without words stay. Only rows that may have to go are moved.
    """
    rows = materialise(similarity_classes(docs, size, percent).filter("comp is not null").select("doc_id", "th", "comp"), "classes")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))).alias("best"), F.count("*").alias("members"))
    best = best.filter("members > 1").select("comp", F.col("best.doc_id").alias("best_id"), F.col("best.th").alias("best_th"))
    same = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("th") == F.col("best_th"))
    grouped = rows.join(best, "comp").groupBy(F.xxhash64("doc_id", "th").alias("near_key")).agg(F.max(same).alias("near_stays"))
    grouped = materialise(grouped, "grouped")
    # the row travels as one column, so no name of a document's column can meet one of these
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("near_row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("near_key"))
    maybe, alone = BitFilter(grouped, "near_key").split(keyed, "near_key")
    maybe = maybe.join(grouped, "near_key", "left").filter(F.coalesce("near_stays", F.lit(True)))
    single = maybe.filter("near_stays is null").unionAll(maybe.filter("near_stays").dropDuplicates(["near_key"]))
    return single.select("near_row.*").unionAll(alone.select("near_row.*"))
