"""Texts of an Arrow batch as one byte array: words, hashes and shingles by numpy, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SHINGLE = 5
CHUNK_BYTES = 4 << 20
LONGEST = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUE = stream(256, 1)
PLACE_VALUE = stream(LONGEST, 2) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_low:_high] = True


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and ``n + 1`` edges; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[edges[0] : edges[-1]], edges - edges[0]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the two-byte Latin-1 capitals."""
    low = LOWER[data]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 32
    return low


def words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the ``n + 1`` word counts at the texts' edges.

    A word is a run of ASCII letters and digits and of bytes above 127; no word crosses texts.
    """
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        full = edges[:-1][edges[:-1] < edges[1:]]
        before[full] = False
        after[full[full > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, edges)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits a word, from its folded bytes and their places."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = BYTE_VALUE[folded[place + np.repeat(starts, sizes)]]
    values *= PLACE_VALUE[place % LONGEST]
    sums = np.add.reduceat(values, first)
    return mix(sums + sizes.astype(U64))


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``n`` words within a text, and the ``m + 1`` shingle counts at the edges.

    A text of fewer words has one shingle of all of them; a text without words has none.
    """
    total = len(hashes)
    sizes = np.diff(counts)
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    rolled = np.zeros(total, U64)
    for k in range(n):
        rolled += padded[k : k + total] * U64(2 * k + 3)
        rolled = mix(rolled)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = counts[owner + 1] - np.arange(total) if total else np.zeros(0, np.int64)
    keep = left >= n
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    for text in short:
        value = np.zeros(1, U64)
        for k in range(counts[text], counts[text + 1]):
            value = mix(value + hashes[k : k + 1] * U64(2 * (k - counts[text]) + 3))
        rolled[counts[text]] = mix(value + U64(sizes[text]))[0]
        keep[counts[text]] = True
    at = np.flatnonzero(keep)
    return rolled[at], at, np.searchsorted(at, counts)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    for start, stop in chunks(texts):
        data, edges = as_bytes(texts.slice(start, stop - start))
        begin, end, counts = words(data, edges)
        values, _, bounds = shingles(word_hashes(fold(data), begin, end), counts, n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(values[a:b])
