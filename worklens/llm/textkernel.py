"""Numpy helpers for texts inside Arrow batches: bytes, words, rolling hashes. They see one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; arrays of eight bytes each are made of them.
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))

_powers = {1: np.ones(1, dtype=np.uint64), -1: np.ones(1, dtype=np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or the inverses."""
    if len(_powers[sign]) < n:
        size = max(n, CHUNK + 1024)
        steps = np.full(size, _BASE if sign > 0 else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if size > 4 * CHUNK:
            return made[:n]
        _powers[sign] = made
    return _powers[sign][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts in them, without a copy. Null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with up to ``limit`` (by default CHUNK) bytes together, or one longer text."""
    i, n, limit = 0, len(offsets) - 1, limit or CHUNK
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def rolling(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of code(byte i) * base^i for s <= i < e."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, alike wherever they stand. The length is part of it."""
    shift = powers(len(prefix), -1)
    return mix((prefix[end] - prefix[start]) * shift[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut long bytes behind white space; a word longer than ``limit`` stays whole."""
    start = 0
    while start < len(data):
        end = min(len(data), start + limit)
        while end < len(data) and not SPACE[data[end - 1]]:
            near = np.flatnonzero(SPACE[data[start:end]])
            if len(near):
                end = start + int(near[-1]) + 1
            else:
                end = min(len(data), end + limit)
        yield start, end
        start = end


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word goes over a cut (a place between two texts)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    both = inner[inside[inner] & inside[inner + 1]]
    begins[both] = True
    ends[both] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, and the n + 1 offsets of the texts in them."""
    first = offsets[0]
    if len(offsets) == 2 and offsets[1] - first > 2 * CHUNK:
        text = data[first : offsets[1]]
        parts = [_word_hashes(text[s:e], np.array([0, e - s]))[0] for s, e in _pieces(text, CHUNK)]
        made = np.concatenate(parts)
        return made, np.array([0, len(made)])
    return _word_hashes(data[first : offsets[-1]], offsets - first)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    start, end = word_spans(data, offsets)
    return span_hash(rolling(data), start, end), np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, its distinct shingles as sorted 64-bit hashes; a text of fewer words has one shingle, of none none."""
    data, offsets = utf8(column)
    factors = powers(size + 1)[1:] ^ _WORD_FACTORS[0]
    factors |= np.uint64(1)
    for i, j in groups(offsets):
        words, at = word_hashes(data, offsets[i : j + 1])
        n = max(0, len(words) - size + 1)
        whole = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            whole += words[k : k + n] * factors[k]
        whole = mix(whole)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                yield np.unique(whole[a : b - size + 1])
            elif b > a:
                few = words[a:b]
                yield mix((few * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(b - a)))
            else:
                yield np.zeros(0, dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
