"""Spelling variants: words of the corpus at an edit distance of one, by an index of grams of variable length.

1. Words of all texts are counted, in each Python worker first, then by one shuffle of (word, count).
2. Dictionary: grams of two characters, and of three where the first two are frequent (over one in ``rare_part`` of all places
   in words). Words are framed by ^ and $. Characters are 92 at most, so this table has a bound that no corpus passes.
3. A word is decomposed into the longest dictionary gram from each place, without those inside an earlier one.
4. Its affected-gram bound is the largest number of its grams that one edit can touch: those around the edited place, and those behind
   it that a new gram may come to cover. All others are found, at the same place or one further, in any word at distance one; for
   words of five letters or more with grams of at most three there is always such a gram (the test tries all patterns of lengths).
5. Lists: a word is entered under its (bound + 1) rarest grams only, keyed by gram, place and word length. Two near words share
   such an entry, for their common grams are too many to lie outside both selections. The lists are merged by one join.
   Candidates whose letters differ in more than two parities can't be near (one edit changes two letters' counts at most); the others
   are verified by their edit distance.

The longest chain of forms is short, for counts double at each step; roots are found by pointer doubling.

Defined results: null texts have no words; a null doc_id is written as nothing in the contract's checksum; repeated rows
count as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import materialise, release, table

LEAST_LENGTH, LEAST_COUNT, LONGEST_GRAM = 5, 3, 3
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Different words that a worker sums before it passes them on.
HELD = 200_000
RARE_PART = 1000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():  # bytes lower A-Z only
                h = zlib.crc32(word.encode(), before)
                if h % 97 == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                held[word] += n
            if len(held) > HELD:
                yield out()
                held = Counter()
    yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters with the contract's planted deletions, of five code points and three occurrences or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = rows.mapInArrow(_counted, "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_dictionary(words: DataFrame, rare_part: int = RARE_PART) -> dict[str, int]:
    """Gram -> places where it stands in words. At most 92^2 grams of two, and ``rare_part`` times 92 of three."""

    def places(q: int) -> DataFrame:
        framed = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
        return framed.select(F.explode(F.expr(f"transform(sequence(1, length(w) - {q - 1}), i -> substring(w, i, {q}))")).alias("gram"))

    two = {r["gram"]: r["n"] for r in places(2).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    total = sum(two.values())
    longer = [g for g, n in two.items() if n * rare_part > total]
    kept = {g: n for g, n in two.items() if n * rare_part <= total}
    if longer:
        three = places(3).groupBy("gram").agg(F.count("*").alias("n")).filter(F.substring("gram", 1, 2).isin(longer))
        kept |= {r["gram"]: r["n"] for r in three.collect()}
    return kept | dict.fromkeys(longer, total)


def decomposed(framed: str, extended) -> list[tuple[int, int]]:
    """(first, last place) of the grams of a framed word; ``extended`` says whether two characters go on to a third."""
    grams, furthest = [], -1
    for i in range(len(framed) - 1):
        last = min(i + 1 + bool(extended(framed[i : i + 2])), len(framed) - 1)
        if last > furthest:
            grams.append((i, last))
            furthest = last
    return grams


def affected(grams: list[tuple[int, int]], length: int) -> int:
    """The most grams of a framed word of ``length`` characters that one edit can touch or cover."""
    most = 0
    for i in range(1, length):
        if i < length - 1:  # the character i replaced or deleted
            most = max(most, sum(p <= i <= q or (p > i and q <= i + LONGEST_GRAM - 1) for p, q in grams))
        most = max(most, sum(p < i <= q or (p >= i and q <= i + LONGEST_GRAM - 2) for p, q in grams))  # one inserted before it
    return most


def parities(word: str) -> int:
    """A bit for each letter (modulo 63) that occurs an odd number of times."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


def entries(words: DataFrame, grams: dict[str, int], rare_part: int = RARE_PART) -> DataFrame:
    """word, n, size, letters, gram, place: the lists' entries of every word, its rarest grams one more than an edit can touch."""
    shared = words.sparkSession.sparkContext.broadcast(grams)
    total = max(grams.values(), default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                framed = f"^{word}$"
                own = decomposed(framed, lambda g: known.get(g) == total)
                keyed = sorted((known.get(framed[p : q + 1], 0), framed[p : q + 1], p) for p, q in own)
                letters = parities(word)
                for _, gram, place in keyed[: affected(own, len(framed)) + 1]:
                    for col, value in zip(cols, (word, n, len(word), letters, gram, place), strict=True):
                        col.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["word", "n", "size", "letters", "gram", "place"])

    return words.select("word", "n").mapInArrow(scan, "word string, n long, size int, letters long, gram string, place int")


def near_pairs(words: DataFrame, rare_part: int = RARE_PART) -> DataFrame:
    """a, n_a, b, n_b: words at an edit distance of exactly one, each pair once."""
    lists = materialise(entries(words, gram_dictionary(words, rare_part), rare_part), "gram-lists")
    one = lists.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("letters_b"), "gram", "place", "size")
    # a is as long as b, or one shorter: then grams behind the edit stand one place further in b
    probes = "explode(array(struct(place as at, size as to), struct(place as at, size + 1 as to), struct(place + 1 as at, size + 1 as to)))"
    other = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "letters", "gram", "size", F.expr(probes).alias("p"))
    other = other.select("a", "n_a", "letters", "gram", F.col("p.at").alias("place"), F.col("p.to").alias("size"))
    met = other.join(one, ["gram", "place", "size"]).filter(F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_b"))) <= 2)
    met = met.filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.filter(F.expr("levenshtein(a, b, 1)") == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root), by pointer doubling; a step is a written table."""
    step = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(step)
        step = new
        if step.filter("moved").isEmpty():
            return step.select("word", "root")


def spelling_variants(docs: DataFrame, rare_part: int = RARE_PART) -> DataFrame:
    """word, form, root, n, n_near, form_n for all words of a corpus."""
    words = materialise(count_words(docs), "words")
    pairs = near_pairs(words, rare_part)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= 2 * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    judged = materialise(judged, "variants")
    found = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return spelling_variants(table(spark, sf_dir, "documents"))
