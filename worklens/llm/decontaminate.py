"""Benchmark decontamination by the q-gram lemma.

A region of a document within k edits of a passage of m characters shares at least m - q + 1 - k q of its q-grams, all of
them on neighbouring diagonals (document offset less passage offset). So for every passage

1. shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half,
2. bands that reach the bound are kept, and
3. the passage is aligned with each such region inside the band; k edits or fewer make a hit.

Passages are benchmark items, cut into overlapping pieces of ``piece`` characters where they are longer, so that a long
item is also found in part. Both sides are compared in lower case and with white space runs as one space. Items of fewer
than ``shortest`` characters leave no room for edits: they are found as they are, between characters that are no letters
or digits. Documents are read where they lie and need no shuffle; the benchmark is broadcast in blocks of up to
``block_bytes``, a pass each. Texts are joined only to see which of them have enough q-grams of passages in reach; each
of these is then searched by itself, so no hit depends on what else a task reads.

Defined results: null and empty texts hold no passage; null or empty items are never found; long texts are folded and
read in parts that overlap by more than a passage with its edits; repeated rows and items each give their rows; an empty
benchmark or document table gives an empty result; other columns are ignored (by ``drop_contaminated``: kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm import textkernel as K
from worklens.llm.common import table

Q, EDIT_RATE, PIECE, SHORTEST = 8, 0.08, 160, 24
BLOCK_BYTES = 4 << 20
#: Characters of documents that are handled at once, by how many parts of a text overlap, and pairs of a q-gram and its places in passages at once.
PART, OVERLAP, AT_ONCE = 1 << 19, 4 * PIECE, 1 << 22
#: Stands between texts; no character.
_SEPARATOR = np.uint32(0x110000)


def _folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points with letters and white space folded, and where each stands in the text.

    Each code point is folded by itself: U+0130, the only one with a longer lower case, is an i, and a final sigma is a sigma.
    """
    lower = text.replace("\u0130", "i").lower().replace("\u03c2", "\u03c3")
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points[space] = 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return points[at], at


def _grams(points: np.ndarray) -> np.ndarray:
    n = len(points) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    codes = K.mix(points.astype(np.uint64) + np.uint64(1))
    factors = K.powers(Q + 1)[1:]
    out = np.zeros(n, dtype=np.uint64)
    for k in range(Q):
        out += codes[k : k + n] * factors[k]
    return K.mix(out)


def _pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool]]:
    """The folded text with places, as of ``_folded``, in parts of PART that overlap, and whether a part begins and ends where the text does; most texts are one."""
    points, at, begins = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), True
    for a in range(0, len(text), PART):
        more, where = _folded(text[a : a + PART])
        skip = int(len(points) > 0 and len(more) > 0 and points[-1] == 32 and more[0] == 32)
        points, at = (np.concatenate([points, more[skip:]]), np.concatenate([at, where[skip:] + a])) if len(points) else (more, where + a)
        while len(points) >= PART + OVERLAP:
            yield points[: PART + OVERLAP], at[: PART + OVERLAP], begins, False
            points, at, begins = points[PART:], at[PART:], False
    if len(points):
        yield points, at, begins, True


class Short:
    """Items that are too short for q-grams with edits: found as they are, by the hash of all their characters."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.by_length: dict[int, dict[bytes, list[int]]] = {}
        for item, points in items:
            self.by_length.setdefault(len(points), {}).setdefault(points.tobytes(), []).append(item)
        self.hashes = {n: np.unique(np.concatenate([self._spans(np.frombuffer(p, dtype=np.uint32), n) for p in found])) for n, found in self.by_length.items()}

    @staticmethod
    def _spans(points: np.ndarray, n: int) -> np.ndarray:
        codes = K.mix(points.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(codes * K.powers(len(points)), out=sums[1:])
        starts = np.arange(max(0, len(points) - n + 1))
        return K.span_hash(sums, starts, starts + n)

    def find(self, points: np.ndarray, begins: bool = True, ends: bool = True) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the first place of each item. Where a part begins or ends inside its text, the part that overlaps it there knows what stands beside the item."""
        inside = lambda k: 0 <= k < len(points) and points[k] < 0x110000 and chr(points[k]).isalnum()
        for n, found in self.by_length.items():
            seen: set[int] = set()
            hashes = self._spans(points, n)
            for s in np.flatnonzero(np.isin(hashes, self.hashes[n])).tolist():
                known = (begins or s > 0) and (ends or s + n < len(points))
                if known and not inside(s - 1) and not inside(s + n):
                    for item in found.get(points[s : s + n].tobytes(), []):
                        if item not in seen:
                            seen.add(item)
                            yield item, s, s + n


class Passages:
    """An index of the q-grams of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.points, self.edits, short = [], [], [], []
        for item, text in items:
            whole = _folded((text or "").strip())[0]
            if 0 < len(whole) < SHORTEST:
                short.append((item, whole))
            for a in range(0, max(1, len(whole) - PIECE // 2), PIECE // 2):
                piece = whole[a : a + PIECE]
                if a and len(piece) < PIECE:
                    piece = whole[-PIECE:]
                if len(piece) >= SHORTEST:
                    self.item.append(item)
                    self.points.append(piece)
                    self.edits.append(min(int(EDIT_RATE * len(piece)), (len(piece) - Q) // Q))
        grams = [_grams(p) for p in self.points]
        every = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.gram >> np.uint64(42)).astype(np.int64)] = True
        self.bound = np.array([len(p) - Q + 1 - k * Q for p, k in zip(self.points, self.edits, strict=True)], dtype=np.int64)
        self.budget = np.array(self.edits, dtype=np.int64)
        # place of a q-gram and owner in one sorted number: the places of some owners in a q-gram are a range
        self.by_owner = np.repeat(np.arange(len(self.gram)), self.last - self.first) * max(1, len(grams)) + self.owner
        self.short = Short(short)

    def suspects(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the texts, joined in ``points`` from ``starts`` on, that a band with enough q-grams of a passage touches. Neighbours can add texts, not hide them."""
        found = [np.searchsorted(starts, (max(0, near - self.edits[o]), far + len(self.points[o]) + self.edits[o]), side="right") - 1 for o, near, far in self._bands(points)]
        return np.unique(np.concatenate([np.arange(max(0, a), b + 1) for a, b in found])) if found else np.zeros(0, dtype=np.int64)

    def find(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) in the folded points of one text."""
        found = []
        for o, near, far in self._bands(points):
            k, m = self.edits[o], len(self.points[o])
            s, e = max(0, near - k), min(len(points), far + m + k)
            one = exact(self.points[o], points[s:e]) or align(self.points[o], points[s:e], k, near - s - k, far - s + k)
            if one is not None:
                found.append((o, s + one[0], s + one[1], one[2]))
        return found

    def _bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first and last diagonal) of the bands that hold enough q-grams."""
        grams = _grams(points)
        if not len(grams) or not len(self.gram):
            return []
        hit = self.seen[(grams >> np.uint64(42)).astype(np.int64)]
        reach = PIECE + int(self.budget.max())
        upto = np.concatenate([[0], np.cumsum(hit)])
        dense = upto[np.minimum(np.arange(len(hit)) + reach, len(hit))] - upto[:-1] >= self.bound.min()
        if not dense.any():
            return []
        dense_upto = np.concatenate([np.zeros(reach, dtype=np.int64), np.cumsum(dense)])
        at = np.flatnonzero(hit & (dense_upto[reach:] > dense_upto[:-reach]))
        row = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        same = self.gram[row] == grams[at]
        return self._among(at[same], row[same], 0, len(self.points))

    def _among(self, at: np.ndarray, row: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
        """Bands of the passages low to high, given the places ``at`` whose q-grams ``row`` they hold; in halves where the pairs of both are too many."""
        n = max(1, len(self.points))
        every = not low and high == len(self.points)
        first, last = (self.first[row], self.last[row]) if every else (np.searchsorted(self.by_owner, row * n + low), np.searchsorted(self.by_owner, row * n + high))
        many = last - first
        if not many.sum():
            return []
        if many.sum() > AT_ONCE and high - low > 1:
            some, middle = many > 0, (low + high) // 2
            return self._among(at[some], row[some], low, middle) + self._among(at[some], row[some], middle, high)
        each = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        owner, diagonal = self.owner[each], np.repeat(at, many) - self.place[each]
        half, shift = self.budget[owner] + 1, np.int64(1 << 40)
        band = np.floor_divide(diagonal, half)
        keys = np.concatenate([owner * shift + band + 1, owner * shift + band])  # band b holds diagonals of b and b + 1, by halves
        bands, counts = np.unique(keys + (1 << 20), return_counts=True)
        bands -= 1 << 20
        who = (bands + (1 << 20)) // shift
        kept = counts >= self.bound[who]
        return [(o, (b - 1) * (self.edits[o] + 1), (b + 1) * (self.edits[o] + 1)) for o, b in zip(who[kept].tolist(), (bands - who * shift)[kept].tolist(), strict=True)]


def exact(passage: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """An alignment without edits, if there is one: it needs no table of costs."""
    at, where = region.tobytes(), -1
    while (where := at.find(passage.tobytes(), where + 1)) >= 0:
        if not where % 4:
            return where // 4, where // 4 + len(passage), 0
    return None


def align(passage: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best alignment of the whole passage inside the region, on diagonals low to high, if within the budget.

    Row i holds the cells (i, i + d) for every diagonal d; the passage may start and end anywhere in the region.
    """
    diagonals = np.arange(low, high + 1)
    far = budget + len(passage) + 1
    cost = np.where((diagonals >= 0) & (diagonals <= len(region)), 0, far).astype(np.int64)
    origin = diagonals.copy()
    steps = np.arange(len(diagonals))
    for i in range(1, len(passage) + 1):
        column = diagonals + i
        inside = (column >= 1) & (column <= len(region))
        char = region[np.clip(column - 1, 0, max(0, len(region) - 1))] if len(region) else np.zeros(len(column), dtype=np.uint32)
        new = np.where(inside, cost + (char != passage[i - 1]), far)
        source = origin.copy()
        up = np.append(cost[1:], far) + 1
        better = (up < new) & (column >= 0) & (column <= len(region))
        new = np.where(better, up, new)
        source = np.where(better, np.append(origin[1:], 0), source)
        slope = new - steps
        best = np.minimum.accumulate(slope)
        taken = np.maximum.accumulate(np.where(slope == best, steps, 0))
        along = (best + steps < new) & inside
        cost, origin = np.where(along, best + steps, new), np.where(along, source[taken], source)
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    if cost[end] > budget:
        return None
    return int(origin[end]), int(diagonals[end]) + len(passage), int(cost[end])


Part = tuple[int, np.ndarray, np.ndarray, bool, bool]


def _together(held: list[tuple[int, str]]) -> tuple[list[Part], np.ndarray, np.ndarray]:
    """Texts folded in one go: each code point is folded by itself, so only the places of the separators matter."""
    begin = np.cumsum([0, *(len(t) + 1 for _, t in held)])
    points, at = _folded("\x00".join([*(t for _, t in held), ""]))
    edges = np.searchsorted(at, begin)
    points[edges[1:] - 1] = _SEPARATOR
    parts = [(row, points[a : b - 1], at[a : b - 1] - o, True, True) for (row, _), a, b, o in zip(held, edges[:-1], edges[1:], begin, strict=False)]
    return parts, points, edges[:-1]


def _joined(texts: list[str | None]) -> Iterator[tuple[list[Part], np.ndarray, np.ndarray]]:
    """(row, folded points, places in the text, begins, ends) of some texts, or of a part of a long one; their points together, and where each begins in these."""
    held, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PART:
            for piece in _pieces(text):
                yield [(row, *piece)], piece[0], np.zeros(1, dtype=np.int64)
            continue
        held.append((row, text))
        size += len(text) + 1
        if size > PART:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def scan(passages: Passages, texts: list[str | None]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item) -> (edits, start, end) of the best region, in code points of the text."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(row: int, item: int, at: np.ndarray, s: int, e: int, edits: int) -> None:
        if e > s:
            value = (edits, int(at[s]), int(at[e - 1]) + 1)
            if (row, item) not in best or value < best[row, item]:
                best[row, item] = value

    for parts, points, starts in _joined(texts):
        for k in passages.suspects(points, starts).tolist():
            row, own, at, *_ = parts[k]
            for o, s, e, edits in passages.find(own):
                keep(row, passages.item[o], at, s, e, edits)
        if passages.short.by_length:
            for row, own, at, begins, ends in parts:
                for item, s, e in passages.short.find(own, begins, ends):
                    keep(row, item, at, s, e, 0)
    return best


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Passages]:
    """Blocks by the item's hash; each comes to the driver alone and is bounded in bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Passages([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").toLocalIterator()])


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, edits of the best region of each item in each document that holds it."""
    schema = "doc_id long, item_id long, start long, end long, edits long"
    out = None
    for passages in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64())
                found = sorted((r, i, v) for (r, i), v in scan(shared.value, batch.column("text").to_pylist()).items())
                cols = [ids.take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([i for _, i, _ in found], pa.int64())]
                cols += [pa.array([v[c] for _, _, v in found], pa.int64()) for c in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start", "end", "edits"])

        hits = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = hits if out is None else out.unionAll(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that hold no passage, with all columns."""
    for passages in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, _ in scan(shared.value, batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
