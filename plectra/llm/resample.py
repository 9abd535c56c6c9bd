"""Importance resampling towards a target distribution of hashed word n-grams.

Each feature (a run of 1 to ``longest`` words) falls into a bucket by its crc32.  Tasks count buckets in arrays; Spark adds
the counts of the corpus and of the target.  A bucket's gain compares both with add-one smoothing; a document's weight is
the sum of its features' gains, looked up in an array of ``buckets`` numbers, and its score adds Gumbel noise that a hash of its id
decides, so that the highest scores are a draw without replacement in proportion to the weights.

The draw: an exact histogram of (score, block of ids) over the documents long enough; its counts summed from the highest
score down give each cell's rank offset, by ranges and sums of ranges; the cell in which the draw is filled is the
cutoff; in each cell that survives, row numbers by id give the ranks.  A block spans ``2**BLOCK_BITS`` ids, so that a
cell holds no more different ids, and rows with no id are dealt by the partition that scored them, so that neither meets in one task.

Defined results: a null or empty text, or one without words, has no features, weight 0 and is not drawn; null ids count as empty
text in the hash and come before all others; rows that repeat an id and a score are ranked in order of their features;
an empty table gives no rows, an empty target has T = 0; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import table, write_table

BUCKETS = 10_000
LONGEST = 3
PERCENT = 5
FEWEST_WORDS = 20
SEED = 42
BLOCK_BITS = 20
PART = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def feature_hashes(text: bytes, longest: int = LONGEST, size: int = PART) -> Iterator[tuple[int, list[int]]]:
    """(words, hashes) a part of the text: crc32 of each run of 1 to ``longest`` words joined by one space.

    A run's hash goes on from that of the run one word shorter; the last of each length carries over to the next part.
    """
    text = text.lower()  # A-Z alone in bytes
    carried: list[int | None] = [None] * longest
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        words = WORD.findall(text, start, end)
        spaced = [b" " + w for w in words]
        found: list[int] = []
        first, level = 0, list(map(crc32, words))
        for n in range(longest):
            found += level
            before, carried[n] = carried[n], level[-1] if level else carried[n]
            if before is None:
                first += 1
                level = list(map(crc32, spaced[first:], level))
            else:
                level = list(map(crc32, spaced[first:], [before, *level]))
        yield len(words), found
        start = end


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all texts; a task gives a row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_hashes((text.as_py() or "").encode(), longest):
                    held += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(held[met])], names=["bucket", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The gain of each bucket; at most ``buckets`` counts of either table reach the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, df in ((s, docs), (t, target)):
        for row in bucket_counts(df, buckets, longest).collect():
            held[row.bucket] = row.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratios = [float(b + 1) * all_s / (float(a + 1) * all_t) for a, b in zip(s.tolist(), t.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n_words = n_features = weight = 0
                for n, found in feature_hashes((text.as_py() or "").encode(), longest):
                    n_words += n
                    n_features += len(found)
                    weight += int(gains[np.array(found, np.int64) % buckets].sum())
                rows.append((n_words, n_features, weight))
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            arrays = [batch.column(0), *(pa.array(numbers[:, i]) for i in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds the score: weight and Gumbel noise from the first 32 bits of the id's sha256."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def rank_offsets(cells: DataFrame) -> DataFrame:
    """``cells`` (score, block, n) with ``before``: the rows of all cells of a higher score, or of the same and a lower block."""
    order = [F.col("score").desc(), F.col("block").asc()]
    ranges = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = write_table(cells.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "cells")
    # One row a range.
    ends = dealt.groupBy("part").agg(F.sum("n").alias("all"))
    begins = ends.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("begin"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy(*order)) - F.col("n")
    return dealt.join(F.broadcast(begins), "part").select("score", "block", "n", (inside + F.col("begin")).alias("before"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and ``rank``, null where it is not drawn."""
    gains = bucket_gains(docs, target, buckets, longest)
    no_id = F.lit(-(2**62)) + F.spark_partition_id()
    block = F.when(F.col("doc_id").isNull(), no_id).otherwise(F.shiftright("doc_id", BLOCK_BITS))
    scored = write_table(with_scores(weigh(docs, gains, longest), seed).withColumn("block", block), "scored")
    long_enough = F.col("n_words") >= fewest_words
    cells = write_table(rank_offsets(scored.where(long_enough).groupBy("score", "block").agg(F.count(F.lit(1)).alias("n"))), "offsets")
    n_drawn = percent * (cells.agg(F.sum("n")).first()[0] or 0) // 100
    cutoff = cells.where((F.col("before") < n_drawn) & (F.col("before") + F.col("n") >= n_drawn)).select("score", "block").first()
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = (F.col("score") > cutoff.score) | ((F.col("score") == cutoff.score) & (F.col("block") <= cutoff.block))
    within = Window.partitionBy("score", "block").orderBy("doc_id", "n_features", "n_words", "weight")
    place = F.col("before") + F.row_number().over(within)
    surviving = scored.where(long_enough & above).join(cells.where(above).select("score", "block", "before"), ["score", "block"])
    drawn = surviving.withColumn("place", place).select(*columns, F.when(F.col("place") <= n_drawn, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~(long_enough & above)).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def crc_table() -> list[int]:
    """The reflected crc32's remainder of each byte."""
    found = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        found.append(value)
    return found


OP13_SQL = rf"""
WITH texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), words AS MATERIALIZED (
  SELECT side, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
), counted AS MATERIALIZED (
  SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), keyed AS MATERIALIZED (
  SELECT f, xor(list_reduce(
      list_transform(range(octet_length(encode(f))), lambda i: CAST(('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
      lambda c, b: xor(({crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM counted)
), sums AS (
  SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM counted JOIN keyed USING (f) GROUP BY bucket
), totals AS (
  SELECT CAST(coalesce(sum(n) FILTER (side = 's'), 0) + {BUCKETS} AS DOUBLE) AS alls, CAST(coalesce(sum(n) FILTER (side = 't'), 0) + {BUCKETS} AS DOUBLE) AS allt FROM counted
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * alls / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * allt))) AS BIGINT) AS gain FROM sums, totals
), weights AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN keyed USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('{SEED}:' || CAST(d.doc_id AS VARCHAR))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d JOIN words ON side = 's' AND words.id = d.doc_id LEFT JOIN weights ON weights.id = d.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {FEWEST_WORDS}
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
