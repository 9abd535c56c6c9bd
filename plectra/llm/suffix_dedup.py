"""Removal of repeated byte strings with a sparse suffix array.

A string of ``length`` bytes that occurs twice has the same least ``GRAM``-byte hash in both places, so it
is enough to sort the suffixes that start at such anchors: about one byte in 200.

1. Each text gives its anchors, each with the window starts it stands for and a 128-bit hash of their
   context (the bytes those windows cover).
2. Equal contexts are counted first.  A context found twice is repeated as a whole, and a hot passage is one
   row from here on.
3. Different contexts behind one leading gram may share some windows.  One copy of each is fetched;
   sampled splitters range-partition these suffixes by their leading bytes; each bucket sorts its window
   suffixes by multikey quicksort, eight bytes a level, and windows that stay together for ``length`` bytes are
   equal.  A bucket is sorted in pieces; the group of one leading gram is carried across a piece's boundary
   and splitters never part it, so every comparison is made.
4. A leading gram of more than ``HOT`` contexts is bound to no task.  Windows whose anchors lie in one stretch of
   places share a core, and cover more bytes together.  Cores and covers are counted by 128-bit hash: a cover that
   another context has is repeated, a core that none has is not, and any other stretch is halved, down to windows.
5. Repeated starts go back to the documents and cover ``length`` bytes each.

Defined results: a null or empty text has nothing to remove; texts shorter than ``length`` are kept whole;
equal rows repeat each other; ids may be null or repeat, as a row is named by its id and its text's hash; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import U64, as_bytes, chunks, mix
from .shared import order_id, real_id, table, text_hash, write_table

LENGTH = 400
GRAM = 16
PLACE_BITS = U64(26)
SEGMENT = 1 << 22
SORT_BYTES = 1 << 21

ANCHORS = "id long, th long, low long, high long, at long, lead binary, c1 long, c2 long"
SAMPLED_A_BUCKET = 40
HOT = 2000
SALTS = 32

CONTEXTS = "c1 long, c2 long, at long, n_starts long, context binary"
HASHED = "c1 long, c2 long, place long, whole long, low long, high long, h1 long, h2 long"
SHARED = "c1 long, c2 long, lows array<long>, highs array<long>"


def word_view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number."""
    padded = np.concatenate([data, np.zeros(7, np.uint8)])
    return np.ndarray((len(data),), dtype=">u8", buffer=padded, strides=(1,))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, edges: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, lowest start, highest start) of each run of windows with one anchor; no window crosses texts."""
    usable = np.flatnonzero(np.diff(edges) >= length)
    if len(usable) == 0:
        return
    change = np.zeros(len(data) + 1, np.int8)
    change[edges[usable]] += 1
    change[edges[usable + 1] - length + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    for base in range(0, len(data), SEGMENT):
        starts = np.flatnonzero(valid[base : base + SEGMENT])
        if len(starts) == 0:
            continue
        part = data[base : base + SEGMENT + length - 1]
        words = word_view(part).astype(U64)
        n = len(part) - GRAM + 1
        hashes = mix(words[:n] * U64(0x9E3779B97F4A7C15) + mix(words[8 : 8 + n]))
        del words
        hashes >>= PLACE_BITS
        hashes <<= PLACE_BITS
        hashes |= np.arange(n, dtype=U64)
        least = sliding_least(hashes, length - GRAM + 1)[starts]
        anchor = (least & U64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(starts)] - 1
        yield anchor[first] + base, starts[first] + base, starts[last] + base


def context_hashes(buffer: memoryview, lows: list[int], stops: list[int], ats: list[int]) -> np.ndarray:
    """(c1, c2) of each context ``buffer[low:stop]``, with its anchor's place ``at`` in it as the seed."""
    digests = (xxhash.xxh3_128_digest(buffer[low:stop], at) for low, stop, at in zip(lows, stops, ats))
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2)
            for start, stop in chunks(texts):
                data, edges = as_bytes(texts.slice(start, stop - start))
                buffer = memoryview(np.ascontiguousarray(data)).cast("B")
                for anchor, low, high in anchor_runs(data, edges, length):
                    owner = np.searchsorted(edges, low, "right") - 1
                    c1, c2 = context_hashes(buffer, low.tolist(), (high + length).tolist(), (anchor - low).tolist()).T
                    leads = data[anchor[:, None] + np.arange(GRAM)]
                    ends = np.arange(0, leads.size + 1, GRAM, dtype=np.int32)
                    lead = pa.Array.from_buffers(pa.binary(), len(leads), [None, pa.py_buffer(ends), pa.py_buffer(leads)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[start + owner]),
                            pa.array(hashes[start + owner]),
                            pa.array(low - edges[owner]),
                            pa.array(high - edges[owner]),
                            pa.array(anchor - low),
                            lead,
                            pa.array(c1),
                            pa.array(c2),
                        ],
                        names=["id", "th", "low", "high", "at", "lead", "c1", "c2"],
                    )

    return docs.mapInArrow(run, ANCHORS)


def multikey_ties(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes equal another for ``length`` bytes.

    Multikey quicksort by levels of eight bytes: each level parts the groups that still tie by their next
    word; a suffix alone in its group is in its final place, and a group of one next word needs no sorting at that level.
    """
    tied = np.arange(len(starts))
    firsts = np.zeros(min(1, len(starts)), np.int64)
    for depth in range(0, length, 8):
        if len(tied) == 0:
            break
        key = words[starts[tied] + min(depth, length - 8)]
        sizes = np.diff(np.append(firsts, len(tied)))
        mixed = np.logical_or.reduceat(key != np.repeat(key[firsts], sizes), firsts)
        if not mixed.any():
            continue
        parted = np.flatnonzero(np.repeat(mixed, sizes))
        group = np.repeat(np.arange(np.count_nonzero(mixed)), sizes[mixed])
        order = np.argsort(key[parted]) if len(sizes) == 1 else np.lexsort((key[parted], group))
        tied[parted], key[parted] = tied[parted[order]], key[parted[order]]
        new = np.append(True, key[1:] != key[:-1])
        new[firsts] = True
        alone = new & np.append(new[1:], True)
        tied, new = tied[~alone], new[~alone]
        firsts = np.flatnonzero(new)
    result = np.zeros(len(starts), bool)
    result[tied] = True
    return result


def sort_piece(rows: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(c1, c2, lows, highs): runs of repeated window starts in each context."""
    contexts = list({(c1, c2): (n, raw) for c1, c2, n, raw in rows}.items())
    sizes = np.array([len(raw) for _, (_, raw) in contexts])
    counts = np.array([n for _, (n, _) in contexts])
    base = np.cumsum(sizes) - sizes
    words = word_view(np.frombuffer(b"".join(raw for _, (_, raw) in contexts), np.uint8)).astype(U64)
    owner = np.repeat(np.arange(len(contexts)), counts)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    repeated = multikey_ties(words, base[owner] + inner, length)
    at = np.flatnonzero(repeated)
    if len(at) == 0:
        return []
    new = np.r_[True, (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1])]
    first, last = at[new], at[np.r_[np.flatnonzero(new)[1:], len(at)] - 1]
    found: dict[int, tuple[list[int], list[int]]] = {}
    for o, a, b in zip(owner[first].tolist(), inner[first].tolist(), inner[last].tolist()):
        lows, highs = found.setdefault(o, ([], []))
        lows.append(a)
        highs.append(b)
    return [(*contexts[o][0], lows, highs) for o, (lows, highs) in found.items()]


def sampled_splitters(leads: DataFrame, buckets: int, per_bucket: int = SAMPLED_A_BUCKET) -> list[bytes]:
    """``buckets - 1`` leading grams that part the leads about evenly, from a bounded sample by hash."""
    sample = leads.orderBy(F.xxhash64("lead")).limit(buckets * per_bucket).collect()
    ordered = sorted(bytes(row["lead"]) for row in sample)
    return [ordered[len(ordered) * i // buckets] for i in range(1, buckets)] if ordered else []


def shared_windows(suffixes: DataFrame, buckets: int, length: int) -> DataFrame:
    """(c1, c2, lows, highs) from suffixes (bucket, lead, c1, c2, n_starts, context), a bucket a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, lead = [], 0, None
        for batch in batches:
            for now, c1, c2, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != lead and size >= SORT_BYTES:
                    yield from as_batch(sort_piece(held, length))
                    held, size = [], 0
                lead = now
                held.append((c1, c2, n, raw))
                size += len(raw)
        if held:
            yield from as_batch(sort_piece(held, length))

    def as_batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            c1, c2, lows, highs = zip(*rows)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(lows, lists), pa.array(highs, lists)],
                names=["c1", "c2", "lows", "highs"],
            )

    dealt = suffixes.repartitionById(buckets, F.col("bucket")).drop("bucket")
    return dealt.sortWithinPartitions("lead", "c1", "c2").mapInArrow(run, SHARED)


def stretch_hashes(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Two rows a context and wanted stretch of ``width`` anchor places: a hash of the core, which each of its windows
    holds, and one of all that its windows cover.  At width 1 both are the window, and one row serves.

    contexts: (c1, c2, at, n_starts, context, places)
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = []
                for c1, c2, at, n, raw, places in zip(*(batch.slice(first, 500).column(i).to_pylist() for i in range(6))):
                    for k in places:
                        low, high = max(0, at - (k + 1) * width + 1), min(n - 1, at - k * width)
                        if low > high:
                            continue
                        start = at - k * width
                        named = k.to_bytes(4, "little") + (at - high).to_bytes(4, "little") + (at - low).to_bytes(4, "little")
                        rows.append((c1, c2, k, 1, low, high, b"w" + named + raw[low : high + length]))
                        if width > 1:
                            rows.append((c1, c2, k, 0, low, high, b"c" + named[:4] + raw[start : start + length - width + 1]))
                if rows:
                    *columns, bodies = zip(*rows)
                    hashed = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r) for r in bodies), "<i8").reshape(-1, 2)
                    arrays = [pa.array(x, pa.int64()) for x in columns] + [pa.array(hashed[:, 0]), pa.array(hashed[:, 1])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["c1", "c2", "place", "whole", "low", "high", "h1", "h2"])

    return contexts.mapInArrow(run, HASHED)


def held_by_several(rows: DataFrame) -> DataFrame:
    """The rows whose hash another context has too, ``first`` marking one of each hash; a common hash is dealt over
    ``SALTS`` tasks."""
    rows = rows.withColumn("salt", F.pmod("c1", F.lit(SALTS)))
    ends = [f(c).alias(f.__name__ + c) for c in ("c1", "c2") for f in (F.min, F.max)]
    part = rows.groupBy("h1", "h2", "salt").agg(*ends)
    both = [F.min(f"min{c}").alias(f"min{c}") for c in ("c1", "c2")] + [F.max(f"max{c}").alias(f"max{c}") for c in ("c1", "c2")]
    several = part.groupBy("h1", "h2").agg(*both, F.collect_list("salt").alias("salts"))
    several = several.where("minc1 <> maxc1 or minc2 <> maxc2").select("h1", "h2", "minc1", F.explode("salts").alias("salt"))
    return rows.join(several, ["h1", "h2", "salt"]).withColumn("first", F.col("c1") == F.col("minc1")).drop("h1", "h2", "salt", "minc1")


def hot_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(c1, c2, lows, highs), as ``shared_windows``, from contexts of leads with any number of contexts.

    A stretch whose whole cover another context has is repeated; one whose core none has is not; any other is
    halved, down to single windows.  One context of each repeated cover is halved too, as others may share some of
    its windows.  A passage's edge lies in one half only, so few stretches go on.
    """
    width = 1 << max(0, (length // 2).bit_length() - 1)
    places = F.sequence(
        F.floor((F.col("at") - F.col("n_starts") + 1) / width).cast("int"), F.floor(F.col("at") / width).cast("int")
    )
    wanted, found = contexts.withColumn("places", places), None
    while True:
        hashed = write_table(stretch_hashes(wanted, width, length), "stretches")
        held = held_by_several(hashed).groupBy("c1", "c2", "place").agg(
            F.max("whole").alias("whole"),
            F.min("whole").alias("least"),
            F.max((F.col("whole") == 1) & F.col("first")).alias("first"),
            F.max("low").alias("low"),
            F.max("high").alias("high"),
        )
        held = write_table(held, "held")
        runs = held.where("whole = 1").select("c1", "c2", "low", "high")
        found = runs if found is None else found.unionByName(runs)
        if width == 1:
            break
        width //= 2
        halves = F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1)).alias("place")
        rest = held.where("least = 0 and (whole = 0 or first)").select("c1", "c2", halves).groupBy("c1", "c2").agg(F.collect_list(F.col("place").cast("int")).alias("places"))
        wanted = contexts.join(rest, ["c1", "c2"]).select("c1", "c2", "at", "n_starts", "context", "places")
    return found.groupBy("c1", "c2").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))


def named_texts(docs: DataFrame) -> DataFrame:
    return docs.select(order_id().cast("long").alias("id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))


def repeated_starts(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, th, lows, highs): runs of window starts whose ``length`` bytes start anywhere else too."""
    narrow = named_texts(docs)
    placed = write_table(anchors(narrow, length), "anchors")
    contexts = write_table(
        placed.groupBy("lead", "c1", "c2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "low", "high", "at")).alias("place")
        ),
        "contexts",
    )
    several = write_table(contexts.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "leads")
    hot_leads = F.broadcast(several.where(F.col("m") > hot).select("lead"))  # at most one for ``hot`` contexts
    any_hot = not hot_leads.isEmpty()
    several = several.where(F.col("m") <= hot).select("lead")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = sampled_splitters(several, buckets)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, *lists in zip(*(batch.column(i) for i in range(6))):
                raw = (text.as_py() or "").encode()
                for c1, c2, low, high, at in zip(*(x.as_py() for x in lists)):
                    context = raw[low : high + length]
                    if xxhash.xxh3_128_digest(context, at) == struct.pack("<2q", c1, c2):
                        out.append((c1, c2, at, high - low + 1, context))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["c1", "c2", "at", "n_starts", "context"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_out(batches):
            leads = [raw[at : at + GRAM] for at, raw in zip(batch.column("at").to_pylist(), batch.column("context").to_pylist())]
            dealt = [pa.array([bisect_right(splitters, lead) for lead in leads], pa.int32()), pa.array(leads, pa.binary())]
            names = ["bucket", "lead", "c1", "c2", "n_starts", "context"]
            yield pa.RecordBatch.from_arrays([*dealt, *(batch.column(c) for c in names[2:])], names=names)

    def fetched(chosen: DataFrame) -> DataFrame:
        # A context found twice needs no sorting for itself, but others may share its windows.
        requests = (
            chosen.select("c1", "c2", "place.*")
            .groupBy("id", "th")
            .agg(*[F.collect_list(c).alias(c) for c in ("c1", "c2", "low", "high", "at")])
        )
        return narrow.join(requests, ["id", "th"]).select("text", "c1", "c2", "low", "high", "at")

    cold = contexts.join(hot_leads, "lead", "left_anti") if any_hot else contexts
    suffixes = fetched(cold.join(several, "lead")).mapInArrow(
        deal, "bucket int, lead binary, c1 long, c2 long, n_starts long, context binary"
    )
    shared = shared_windows(suffixes, buckets, length)
    if any_hot:
        cut = fetched(contexts.join(hot_leads, "lead")).mapInArrow(cut_out, CONTEXTS)
        shared = shared.unionByName(hot_windows(write_table(cut, "hot"), length))
    whole = contexts.where("n > 1").select(
        "c1",
        "c2",
        F.array(F.lit(0).cast("long")).alias("lows"),
        F.array(F.col("place.high") - F.col("place.low")).alias("highs"),
    )
    single = contexts.where("n = 1").select("c1", "c2")
    partly = shared.join(single, ["c1", "c2"], "left_semi")
    found = whole.unionByName(partly)
    return (
        placed.select("id", "th", "low", "c1", "c2")
        .join(found, ["c1", "c2"])
        .select("id", "th", F.explode(F.arrays_zip("lows", "highs")).alias("r"), "low")
        .select("id", "th", (F.col("low") + F.col("r.lows")).alias("lows"), (F.col("low") + F.col("r.highs")).alias("highs"))
        .groupBy("id", "th")
        .agg(F.collect_list("lows").alias("lows"), F.collect_list("highs").alias("highs"))
    )


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is the bytes that no repeated string covers."""
    starts = repeated_starts(docs, length, hot)
    narrow = named_texts(docs)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lows, highs in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = (text.as_py() or "").encode()
                if not lows.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, np.asarray(lows.as_py()), 1)
                np.add.at(change, np.asarray(highs.as_py()) + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), spans, kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    joined = narrow.join(starts, ["id", "th"], "left").select("id", "text", "lows", "highs")
    cleaned = joined.mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cleaned.select(real_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
