"""Packing of token pieces by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id.  It is cut into pieces: full windows first, then the rest
in pieces of at most ``piece`` tokens.  Pieces are dealt by hash into bundles of bounded size.  In a
bundle every full piece is a sequence of its own; the others are spread over ``k`` windows by differencing:
the two partial partitions of the largest imbalance are merged with opposing order until one is left.
``k`` starts at the least count that could hold the tokens and rises while a window exceeds the capacity.

Ids are those of ``tokenizers`` under ``add_special_tokens=False``: an added token of the file that stands in a
text is its own id.

Defined results: a null or empty text is the end id alone; every row packs as a document, so repeated
rows and ids do too; ids may be null; an empty table gives no pieces.  ``public_tokenizers`` holds the
vocabulary; its path is a parameter.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table, write_table

WINDOW = 1024
PIECE = 128
BUNDLE = 2048
_ENCODERS: dict[str, object] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """``encode(text) -> ids`` of the byte-level BPE of a ``tokenizers`` file, with its added tokens, as ``tokenizers``
    gives them under ``add_special_tokens=False``.

    tiktoken gives the same ids in a quarter of the time (compared by the tests).  ``tokenizers`` itself runs where
    an added token strips blanks, asks for word borders, is normalised, or holds the start of another.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        added = {token["content"]: token["id"] for token in held.get("added_tokens", [])}
        flags = any(token[k] for token in held.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if flags or any(overlap(a, b) for a in added for b in added):
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: coder.encode(text, add_special_tokens=False).ids
        else:
            import public_tokenizers
            import tiktoken

            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            shown = {chr(b): b for b in printable}
            shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
            words = held["model"]["vocab"].items()
            ranks = {bytes(shown[c] for c in word): i for word, i in words if word not in added and set(word) <= set(shown)}
            coder = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
            _ENCODERS[path] = lambda text: coder.encode(text, allowed_special="all", disallowed_special=())
    return _ENCODERS[path]


def overlap(a: str, b: str) -> bool:
    """Whether places of ``a`` and another token ``b`` can overlap in a text."""
    return a != b and (b in a or any(a.endswith(b[:n]) for n in range(1, len(b))))


def cut(n_tokens: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; the rest is cut evenly, so no piece is tiny for no reason."""
    full, rest = divmod(n_tokens, window)
    spans = [(i * window, window) for i in range(full)]
    parts = -(-rest // piece)
    edges = [full * window + rest * i // parts for i in range(parts + 1)] if parts else []
    return spans + [(a, b - a) for a, b in zip(edges, edges[1:])]


def tokenize_pieces(
    docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, piece: int = PIECE, with_ids: bool = False
) -> DataFrame:
    """One row a piece; ``with_ids`` adds the ids as little-endian unsigned 32-bit ``ids`` bytes."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4")
                for start, length in cut(len(ids), window, piece):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(raw), len(ids), *([raw] if with_ids else [])))
                if len(rows) > 20_000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        kinds = [pa.int64()] * 5 + [pa.binary()]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names[: len(columns)]
        )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the window (0 to k-1) of each size."""
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # A node has k slots in descending order of their sums less the least of them.
    sums: list[np.ndarray | None] = []
    kids: list[tuple[int, int, np.ndarray] | None] = [None] * n
    heap = []
    for i, size in enumerate(sizes):
        slot = np.zeros(k, dtype=np.int64)
        slot[0] = size
        sums.append(slot)
        heap.append((-int(size), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        mixed = sums[a] + sums[b][::-1]
        order = np.argsort(-mixed, kind="stable").astype(np.int32)
        mixed = mixed[order]
        mixed -= mixed[-1]
        sums[a] = sums[b] = None
        kids.append((a, b, order))
        sums.append(mixed)
        heapq.heappush(heap, (-int(mixed[0]), len(sums) - 1))
    window = np.zeros(n, dtype=np.int64)
    stack = [(heap[0][1], np.arange(k))]
    while stack:
        node, names = stack.pop()
        if kids[node] is None:
            window[node] = names[0]
            continue
        a, b, order = kids[node]
        kids[node] = None
        unsorted = np.empty(k, dtype=np.int64)
        unsorted[order] = names
        stack.append((a, unsorted))
        stack.append((b, unsorted[::-1]))
    return window


def pack_sizes(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Windows of near-equal fill, none above the capacity, and their count."""
    total = int(sizes.sum())
    k, step = max(1, -(-total // window)), 1
    while True:
        place = difference(sizes, k)
        if len(sizes) == 0 or np.bincount(place, weights=sizes, minlength=k).max() <= window:
            return place, k
        k, step = k + step, step + 1


def place_bundle(rows: pa.Table, window: int = WINDOW) -> pa.Table:
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
    bundle = rows.column("bundle")[0].as_py()
    sizes = rows.column("length").to_numpy()
    full = sizes == window
    sequence = np.empty(len(sizes), dtype=np.int64)
    place, k = pack_sizes(sizes[~full], window)
    sequence[~full] = place
    sequence[full] = k + np.arange(full.sum())
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    first = np.r_[True, np.diff(sequence[order]) != 0]
    base = np.maximum.accumulate(np.where(first, starts, 0))
    offset = np.empty(len(sizes), dtype=np.int64)
    offset[order] = starts - base
    rows = rows.drop_columns(["bundle"])
    rows = rows.append_column("sequence_id", pa.array((bundle << 24) + sequence))
    return rows.append_column("offset", pa.array(offset))


def pack(
    docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, piece: int = PIECE, bundle: int = BUNDLE
) -> DataFrame:
    """One row a piece with its sequence and offset.  ``bundle`` bounds the pieces that meet in one task."""
    pieces = write_table(tokenize_pieces(docs, vocabulary, window, piece), "pieces")
    bundles = max(1, -(-pieces.count() // bundle))
    # The row's own number in the written table parts repeated rows.
    own = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = pieces.withColumn("bundle", F.pmod(own, F.lit(bundles)))

    def place(rows: pa.Table) -> pa.Table:
        return place_bundle(rows, window)

    return dealt.groupBy("bundle").applyInArrow(place, PLACED)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str | None = None, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Whole sequences: sequence_id and its ids, for documents with distinct ids."""
    ids = tokenize_pieces(docs, vocabulary, window, piece, with_ids=True).select("doc_id", "start", "ids")
    both = placed.join(ids, [placed.doc_id.eqNullSafe(ids.doc_id), placed.start == ids.start])
    parts = F.array_sort(F.collect_list(F.struct(placed.offset, ids.ids)))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("ids_hex")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
