"""Benchmark decontamination with SimHash over item-sized windows.

A window has as many words as a benchmark item; a text of fewer words is one window as a whole.  Windows that hold a shingle of an item of their size are
fingerprinted (any other has similarity 0 to all of them); votes of a window are differences of running
sums.  A window is asked of the items of its size that share a shingle with its text.  Fingerprints are cut into ``BLOCKS`` words of 64
bits: two within the radius differ in at most ``RADIUS // BLOCKS`` bits of some word, so one word selects the candidates, of
which chance makes few, and none within the radius is missed.  Candidates are verified by exact similarity of weighted
shingles, a shingle's weight being its count: the sum of least weights over the sum of greatest.

Defined results: null and empty texts match nothing, nor do items without words; an item of fewer than
five words is one shingle; equal items match alike; ids may repeat or be null; other columns pass through
``decontaminate`` unchanged, which drops the rows that match, named by id and text hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import SHINGLE, U64, as_bytes, chunks, fold, mix, word_hashes, words
from .shared import order_id, table, text_hash, write_table

THRESHOLD = 0.8
RADIUS = 32
BITS = 128
BLOCKS = 2
ITEMS = 4096
SHARD_BYTES = 8 << 20
FOUND = "doc_id long, th long, item_id long, similarity double, start_word long, n_words long, n_windows long"


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on, texts run on."""
    total = len(hashes)
    padded = np.concatenate([hashes, np.zeros(n, U64)])
    rolled = np.full(total, n, U64)
    for k in range(n):
        rolled = mix(rolled + padded[k : k + total])
    return rolled


def signed_bits(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a shingle's two hashes."""
    pair = np.stack([values, mix(values ^ U64(0x9E3779B97F4A7C15))], axis=1)
    return np.unpackbits(pair.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def packed(prints: np.ndarray) -> np.ndarray:
    """Fingerprints as words of 64 bits, a block each."""
    return np.packbits(prints, axis=1).view(U64)


class Items:
    """A shard of the benchmark: shingles and fingerprints of its items, and the items that hold each shingle."""

    def __init__(self, ids: list, texts: list):
        data, edges = as_bytes(pa.array(texts, pa.string()))
        start, end, counts = words(data, edges)
        hashes = word_hashes(fold(data), start, end)
        self.ids, self.sizes, self.shingles, self.prints = [], [], [], []
        for item, a, b in zip(ids, counts[:-1], counts[1:]):
            if a < b:
                n = min(SHINGLE, int(b - a))
                values = runs(hashes[a:b], n)[: b - a - n + 1]
                self.ids.append(item)
                self.sizes.append(int(b - a))
                self.shingles.append(values)
                self.prints.append(signed_bits(values).sum(axis=0) > 0)
        self.counted = [np.unique(v, return_counts=True) for v in self.shingles]
        self.runs_of = sorted({min(SHINGLE, n) for n in self.sizes})
        self.known, self.owners = {}, {}
        for n in self.runs_of:
            who = [i for i, size in enumerate(self.sizes) if min(SHINGLE, size) == n]
            value = np.concatenate([self.counted[i][0] for i in who])
            owner = np.repeat(who, [len(self.counted[i][0]) for i in who])
            order = np.argsort(value, kind="stable")
            self.known[n], self.owners[n] = value[order], owner[order]
        self.blocks = packed(np.stack(self.prints)) if self.prints else np.zeros((0, BLOCKS), U64)

    def candidates(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in ``items``, distance) of the pairs of which some block is near enough."""
        mine, theirs = packed(prints), self.blocks[items]
        away = [np.bitwise_count(mine[:, None, b] ^ theirs[None, :, b]) for b in range(BLOCKS)]
        window, place = np.nonzero(np.minimum.reduce(away) <= RADIUS // BLOCKS)
        return window, place, sum(a[window, place].astype(np.int64) for a in away)

    def within(self, prints: np.ndarray, items: np.ndarray) -> np.ndarray:
        """(windows, items) whose fingerprints lie within the radius, of the items given."""
        found = [np.zeros((0, 2), np.int64)]
        for part in np.split(items, range(ITEMS, len(items), ITEMS)):
            window, place, distance = self.candidates(prints, part)
            near = distance <= RADIUS
            found.append(np.stack([window[near], part[place[near]]], axis=1))
        return np.concatenate(found)

    def similarity(self, values: np.ndarray, item: int) -> float:
        own, n = np.unique(values, return_counts=True)
        theirs, m = self.counted[item]
        both, a, b = np.intersect1d(own, theirs, assume_unique=True, return_indices=True)
        least = int(np.minimum(n[a], m[b]).sum()) if len(both) else 0
        return least / (int(n.sum()) + int(m.sum()) - least)


def hits(items: Items, rolled: np.ndarray, n: int) -> np.ndarray:
    """Places whose shingle some item has."""
    known = items.known[n]
    low = np.searchsorted(known, rolled)
    low[low == len(known)] = 0
    return np.flatnonzero(known[low] == rolled)


def matches(items: Items, hashes: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(text, item, similarity, start word, words, windows) of the best window of each text and item."""
    for n in items.runs_of:
        rolled = runs(hashes, n)
        place = hits(items, rolled, n)
        text = np.searchsorted(counts, place, "right") - 1
        for t in np.unique(text):
            first, last = int(counts[t]), int(counts[t + 1])
            here = place[(text == t) & (place + n <= last)]
            if len(here) == 0:
                continue
            low = np.searchsorted(items.known[n], rolled[here], "left")
            high = np.searchsorted(items.known[n], rolled[here], "right")
            owner = np.concatenate([items.owners[n][a:b] for a, b in zip(low, high)])
            spot = np.repeat(here, high - low)
            sizes = np.array([items.sizes[i] for i in owner])
            for size in np.unique(sizes):
                those = np.unique(owner[sizes == size])
                span = int(size) - n + 1
                if last - first < size:
                    # Shorter than the item: the whole text is the one window, verified without fingerprints.
                    own = rolled[first : last - n + 1]
                    for i in those if len(own) >= threshold * span - 1e-9 else ():
                        value = items.similarity(own, i)
                        if value >= threshold:
                            yield int(t), items.ids[i], value, 0, last - first, 1
                    continue
                cover = np.unique(spot[sizes == size])
                starts = np.unique((cover[:, None] - np.arange(span)[None, :]).ravel())
                starts = starts[(starts >= first) & (starts + size <= last)]
                if len(starts) == 0:
                    continue
                best: dict[int, list] = {}
                for part in np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1):
                    base = part[0]
                    total = np.zeros((part[-1] + span - base + 1, BITS), np.int32)
                    np.cumsum(signed_bits(rolled[base : part[-1] + span]), axis=0, out=total[1:])
                    prints = total[part - base + span] - total[part - base] > 0
                    for w, i in items.within(prints, those):
                        item, s = int(i), int(part[w])
                        value = items.similarity(rolled[s : s + span], item)
                        if value >= threshold:
                            seen = best.setdefault(item, [value, s, 0])
                            seen[2] += 1
                            if value > seen[0]:
                                seen[:2] = value, s
                for item, (value, s, windows) in best.items():
                    yield int(t), items.ids[item], value, s - first, int(size), windows


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a document row and benchmark item that some window of it matches, with the best window."""
    return leaks(docs, benchmark, threshold, shard_bytes).drop("th")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``find_leaks`` with the hash of each document row's text.

    The benchmark goes to the workers in shards of about ``shard_bytes``; a larger one takes more passes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-held // shard_bytes))
    narrow = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string"))
    found = None
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        part = narrow.mapInArrow(leak_finder(sent, threshold), FOUND)
        if shards > 1:  # one shard at a time is held
            part = write_table(part, "leaks")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], FOUND)


def leak_finder(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in batches:
            doc_ids, text_hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            rows = []
            for start, stop in chunks(texts):
                data, edges = as_bytes(texts.slice(start, stop - start))
                begin, end, counts = words(data, edges)
                hashes = word_hashes(fold(data), begin, end)
                if items.ids:
                    rows += [(start + t, *rest) for t, *rest in matches(items, hashes, counts, threshold)]
            if rows:
                owner, item, value, at, size, windows = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.take(pa.array(owner, pa.int64())),
                        text_hashes.take(pa.array(owner, pa.int64())),
                        pa.array(item, pa.int64()),
                        pa.array(value, pa.float64()),
                        pa.array(at, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(windows, pa.int64()),
                    ],
                    names=["doc_id", "th", "item_id", "similarity", "start_word", "n_words", "n_windows"],
                )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    leaked = leaks(docs, benchmark, threshold).select(order_id().cast("long").alias("id"), "th").distinct()
    rows = docs.select(F.struct("*").alias("doc"), order_id().cast("long").alias("id"), text_hash(F.col("text")).alias("th"))
    return rows.join(leaked, ["id", "th"], "left_anti").select("doc.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
