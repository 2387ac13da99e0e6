"""Periodic runs and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from worklens.llm import periodic_runs, spelling_variants


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_runs(words):
    """All maximal stretches for every lag; the smallest period of each is looked for lag by lag."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[t] == words[t + d] for t in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = plain_words(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {t for s, length, q in runs for t in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept))


def periodic(rng):
    """A text with nested and neighbouring repetitions at lags around the borders of the classes."""
    words = []
    for _ in range(rng.randrange(1, 5)):
        words += [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        root = [rng.choice("ab") if rng.random() < 0.5 else rng.choice("abcxyz") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33]))]
        if rng.random() < 0.3:
            root = root * 2 + [rng.choice("abc")]
        times = rng.randrange(22, 30 + 5 * len(root))
        words += (root * times)[: rng.randrange(20, 24 + 4 * len(root))]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "z"
    return words


def test_runs_of_words():
    rng = random.Random(3)
    for _ in range(400):
        words = periodic(rng)
        assert periodic_runs.runs_of([w.encode() for w in words]) == plain_runs(words), words


def test_runs_at_the_least_length():
    for q, n in itertools.product(range(1, 12), range(20, 40)):
        words = [f"r{i % q}" for i in range(n)]
        for framed in (words, ["x", *words, "y"]):
            assert periodic_runs.runs_of([w.encode() for w in framed]) == plain_runs(framed), (q, n)


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(w + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for w in periodic(rng)), "s", 1) for i in range(150)]
    rows += [(500, None, "s", 1), (501, "", "s", 1), (502, " \n ", "s", 1), (None, "a b " * 40, "s", 1), rows[3], rows[3]]
    rows += [(503, "same " * 20_000, "s", 1), (504, "é e " * 30 + "\x1c x", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, period int").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()))
    small = Counter(plain_row(*r[:2]) for r in rows if r[0] != 503)
    for row in small:
        assert got[row] == small[row]
    (long,) = [r for r in got if r[0] == 503]
    assert long[1:6] == (1, 0, 20_000, 1, 20_000_000) and sum(got.values()) == len(rows)
    assert sum(r[1] > 0 for r in got) > 50


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def one_edit(a, b):
    """Whether b comes from a by one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def varied(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 12))) for _ in range(40)]
    for _ in range(n):
        w = list(rng.choice(base))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
        base.append("".join(w))
    return base


@pytest.mark.parametrize("letters,part", [("ab", 1000), ("abcdeéÿ×À", 1000), ("abcdefghij", 20)])
def test_variants_query(spark, tmp_path, letters, part):
    rng = random.Random(letters)
    words = varied(rng, letters, 300)
    rows = [(i, " ".join(rng.choice(words[: 1 + int(len(words) * rng.random() ** 2)]) for _ in range(60)), "s", "w") for i in range(120)]
    rows += [(900, None, "s", "w"), (901, "", "s", "w"), (None, "Àpfelbaum apfelbaum Apfelbaum, APFELBAUM! apfelbaúm", "s", "w"), rows[0], rows[0], (902, words[0] * 500 + " " + words[3] * 20_000, "s", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, word string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    expected = plain_variants(rows)
    got = spelling_variants.op11_spelling_variants(spark, str(tmp_path)) if part == 1000 else spelling_variants.spelling_variants(df, part)
    got = list(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert len(got) == len(set(got)) and set(got) == expected
    assert sum(f is not None for _, f, *_ in got) > 5


def test_one_edit_always_leaves_a_shared_gram():
    """Whatever the lengths of the grams, the bound stays under their number for words of five characters or more."""
    for size in range(5, 10):
        for longer in itertools.product((False, True), repeat=size + 1):
            left = iter(longer)
            grams = spelling_variants.decomposed("^" + "x" * size + "$", lambda g, left=left: next(left))
            assert len(grams) > spelling_variants.affected(grams, size + 2)


def test_variants_of_an_empty_table(spark):
    assert spelling_variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
