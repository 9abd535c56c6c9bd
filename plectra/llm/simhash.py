"""Document fingerprints by SimHash, with DataFrame functions only.

A term is a pair of neighbouring words; its weight is its length, and it votes once an occurrence.  Each
bit of its 128-bit hash votes for or against the same bit of the fingerprint.  Votes are summed two bits to
a long, 32 bits apart, so 64 sums serve 128 bits.

``near_fingerprints`` finds every fingerprint within a Hamming radius: the bits are cut into ``BLOCKS`` blocks, each the
key of one table; of ``RADIUS`` differing bits some block has at most ``RADIUS // BLOCKS``, so a query asks each table
for its block and every key that so many flips make of it.  One word changed in 25 parts two texts by about 12
bits (similarity 0.8 on five-word shingles); the radius of 17 finds nearly all of them.

Documents are followed in id order: sampled bounds and equal steps between them deal them into buckets, in which each
row reads the next; a bucket's last row reads the first of the next bucket.

Defined results: a null text is empty; a text without words has the zero fingerprint; ids may repeat and
ties go by text; a null id comes first; the document after the last is the first, so a single document
follows itself; other columns are left out.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import order_id, table, write_table

BITS = 128
LANES = 0x0000000100000001
BUCKET_ROWS = 2000
BOUNDS = 256
RADIUS = 17
BLOCKS = 6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def terms(w: Column) -> Column:
    """Pairs of neighbouring words; the last word stands alone."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))


def votes() -> list[Column]:
    sums = [F.sum("weight").alias("total")]
    for half in (1, 2):
        for k in range(32):
            lanes = F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(LANES))
            sums.append(F.sum(lanes * F.col("weight")).alias(f"s{half}_{k}"))
    return sums


def bits(half: int) -> Column:
    """The 64 bits of a half: a bit is set if more than half of the weight votes for it."""

    def bit(k: int) -> Column:
        both = F.col(f"s{half}_{k}")
        low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(both, 32)
        one = F.when(low * 2 > F.col("total"), F.lit(1 << k)).otherwise(F.lit(0).cast("long"))
        upper = (1 << (k + 32)) if k < 31 else -(1 << 63)
        return one.bitwiseOR(F.when(high * 2 > F.col("total"), F.lit(upper)).otherwise(F.lit(0).cast("long")))

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(32)])


def fingerprint(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, f1, f2): the fingerprint of each row's text; ``keys`` name one row."""
    exploded = df.select(*keys, words(F.col(text)).alias("w")).select(*keys, F.inline_outer(terms(F.col("w"))).alias("a", "b"))
    weight = F.coalesce(F.length("a"), F.lit(0)) + F.coalesce(F.length("b"), F.lit(0))
    hashed = exploded.select(
        *keys,
        weight.cast("long").alias("weight"),
        F.xxhash64("a", "b").alias("h1"),
        F.xxhash64(F.lit(7919), "a", "b").alias("h2"),
    )
    return hashed.groupBy(*keys).agg(*votes()).select(*keys, bits(1).alias("f1"), bits(2).alias("f2"))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return 1 - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(float(BITS))


def shown(f1: Column, f2: Column) -> Column:
    return F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0"))


def bucketed(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, bounds: int = BOUNDS) -> DataFrame:
    """(part, step, doc_id, id, text) by id range: (part, step) ascends with the id.

    Rows of one id meet in one bucket; those without an id are dealt by their first letter, as ties go by text.
    """
    rows = docs.select("doc_id", order_id().cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    shares = [i / bounds for i in range(bounds + 1)]
    at, n = known.agg(F.percentile_approx("id", shares), F.count("id")).first()
    cuts = sorted(set(at or [0]))
    edges = F.array(*[F.lit(c) for c in cuts])
    part = F.size(F.filter(edges, lambda c: c <= F.col("id"))) - 1
    low = F.get("edges", F.col("part")).cast("decimal(20,0)")
    high = F.coalesce(F.get("edges", F.col("part") + 1), F.lit(cuts[-1] + 1)).cast("decimal(20,0)")
    steps = max(1, n // (bucket_rows * max(1, len(cuts))))
    inside = F.floor((F.col("id") - low) * steps / (high - low)).cast("long")
    step = F.when(F.col("doc_id").isNull(), F.ascii("text").cast("long")).otherwise(F.coalesce(inside, F.lit(0)))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -2).otherwise(part)).withColumn("edges", edges)
    # A stated count, as the work that follows a row is far more than its bytes tell.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("part", step.alias("step"), "doc_id", "id", "text").repartition(tasks, "part", "step")


def following(buckets: DataFrame) -> DataFrame:
    """(part, step, next_part, next_step) of distinct buckets; the first follows the last."""
    inner = F.lead("step").over(Window.partitionBy("part").orderBy("step"))
    firsts = buckets.groupBy("part").agg(F.min("step").alias("first"))
    around = Window.orderBy("part")  # one row a part: ``BOUNDS`` and two more
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct(F.col("part").alias("next_part"), F.col("first").alias("next_step"))
    parts = firsts.select("part", F.coalesce(F.lead(head).over(around), F.first(head).over(every)).alias("head"))
    linked = buckets.withColumn("inner", inner).join(F.broadcast(parts), "part")  # bounded as above
    own = F.col("inner").isNotNull()
    return linked.select(
        "part", "step", F.when(own, F.col("part")).otherwise(F.col("head.next_part")).alias("next_part"), F.coalesce("inner", "head.next_step").alias("next_step")
    )


def with_next(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` of buckets (part, step), each with ``next_<column>`` of the row after it."""
    inside = Window.partitionBy("part", "step").orderBy(*order)
    follower = F.lead(F.struct(*columns)).over(inside)  # a struct, as a follower's id may be null
    ranked = rows.withColumns({"rn": F.row_number().over(inside), "follower": follower})
    heads = ranked.where("rn = 1").select(F.col("part").alias("next_part"), F.col("step").alias("next_step"), F.struct(*columns).alias("head"))
    heads = following(rows.select("part", "step").distinct()).join(heads, ["next_part", "next_step"]).drop("next_part", "next_step")
    joined = ranked.join(heads, ["part", "step"], "left")
    found = joined.withColumn("follower", F.coalesce("follower", "head"))
    return found.withColumns({f"next_{c}": F.col("follower")[c] for c in columns}).drop("follower", "head")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document with its own, its edited text's and its successor's fingerprint."""
    # Heads read the same columns as all rows do, so one shuffle of texts serves both.
    ranked = with_next(bucketed(docs), ["id", "text"], ["doc_id", "text"])
    n = F.char_length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter)
    )
    pair = ranked.select("part", "step", "rn", "doc_id", "next_doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("content")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("content"))
    )
    rows = pair.select("part", "step", "rn", "doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.inline(both))
    keys = ["part", "step", "rn", "doc_id", "next_doc_id", "n_chars", "edited_sha256", "kind"]
    prints = fingerprint(rows, keys, "content")
    of = lambda name, kind: F.max(F.when(F.col("kind") == kind, F.col(name)))
    wide = prints.groupBy(*keys[:-1]).agg(
        of("f1", 0).alias("f1"), of("f2", 0).alias("f2"), of("f1", 1).alias("e1"), of("f2", 1).alias("e2")
    )
    wide = write_table(wide.withColumnRenamed("rn", "own"), "prints")
    linked = with_next(wide, ["own"], ["f1", "f2"]).withColumnsRenamed({"next_f1": "n1", "next_f2": "n2"})
    return linked.drop("part", "step", "rn", "own")


def block_spans(blocks: int) -> list[tuple[int, int, int]]:
    """(half, shift, size) of each block; no block crosses the halves."""
    if blocks % 2 or not 0 < blocks <= BITS:
        raise ValueError("blocks must be even: half of them for each 64 bits")
    edges = [64 * i // (blocks // 2) for i in range(blocks // 2 + 1)]
    return [(half, a, b - a) for half in (1, 2) for a, b in zip(edges, edges[1:])]


def near_fingerprints(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(f1, f2, near1, near2, distance) of every distinct query and row fingerprint within ``radius``."""
    spans, flips = block_spans(blocks), radius // blocks

    def block(half: int, shift: int, size: int) -> Column:
        return F.shiftrightunsigned(f"f{half}", shift).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))

    def table_keys(tab: int, key: Column, masks: list[int]) -> Column:
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(tab).alias("tab"), key.bitwiseXOR(m).alias("key")))

    def entries(df: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        keys = [table_keys(t, block(*span), masks[span[2]]) for t, span in enumerate(spans)]
        return df.select("f1", "f2").distinct().select("f1", "f2", F.inline(F.concat(*keys)))

    sizes = {size for _, _, size in spans}
    near_masks = {
        size: [sum(1 << i for i in chosen) for k in range(min(flips, size) + 1) for chosen in combinations(range(size), k)] for size in sizes
    }
    left = entries(queries, near_masks)
    right = entries(rows, {size: [0] for size in sizes}).select("tab", "key", F.col("f1").alias("near1"), F.col("f2").alias("near2"))
    distance = F.bit_count(F.expr("f1 ^ near1")) + F.bit_count(F.expr("f2 ^ near2"))
    # A merge join: Spark takes the size of the few queries for that of their many keys, and would broadcast these.
    met = left.hint("merge").join(right, (left.tab == right.tab) & (left.key == right.key) & (distance <= radius))
    return met.select("f1", "f2", "near1", "near2", distance.alias("distance")).distinct()


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of the radius search are the documents whose id is divisible by 50 (``n_near``: how many other
    documents lie within the radius; null for the rest).  ``next_doc_id`` is the document whose text the edit takes."""
    prints = write_table(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    asked = F.col("doc_id") % 50 == 0
    counts = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    near = near_fingerprints(prints.where(asked), prints)
    found = (
        near.join(counts.select(F.col("f1").alias("near1"), F.col("f2").alias("near2"), "n"), ["near1", "near2"])
        .groupBy("f1", "f2")
        .agg((F.sum("n") - 1).alias("n_near"))
    )
    return prints.join(found, ["f1", "f2"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("f1"), F.col("f2")).alias("fingerprint"),
        shown(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
        likeness(F.col("f1"), F.col("f2"), F.col("e1"), F.col("e2")).alias("near_edited"),
        likeness(F.col("f1"), F.col("f2"), F.col("n1"), F.col("n2")).alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
        "next_doc_id",
    )
