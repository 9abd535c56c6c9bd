"""Finite domains: products, ranks, grids, intervals and word sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dna import cardinality, masks
from .ranks import rank_within, running_total


def unrank(domains: Column, rank: Column) -> Column:
    """The word at ``rank`` of a product of base masks, the last position fastest."""
    step = F.aggregate(
        F.reverse(domains),
        F.struct(rank.cast("long").alias("rest"), F.lit("").alias("word")),
        lambda acc, m: F.struct(
            F.floor(acc["rest"] / F.bit_count(m)).cast("long").alias("rest"),
            F.concat(F.get(bases_of(m), (acc["rest"] % F.bit_count(m)).cast("int")), acc["word"]).alias("word"),
        ),
    )
    return step["word"]


def bases_of(mask: Column) -> Column:
    weights = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(b).alias("b")) for b, w in (("A", 1), ("C", 2), ("G", 4), ("T", 8))])
    return F.transform(F.filter(weights, lambda x: x["w"].bitwiseAND(mask) != 0), lambda x: x["b"])


def expand(df: DataFrame, keys: list[str], seq: str, budget: int) -> DataFrame:
    """(keys, status, variant, word): the exact words of each sequence, from rank 0; one over the budget gives one row
    with status ``over_budget`` and no word."""
    sized = df.select(*keys, masks(F.col(seq)).alias("domains"), cardinality(F.col(seq)).alias("size"))
    fits = F.col("size") <= budget
    last = F.when(fits, F.col("size")).otherwise(1).cast("int") - 1
    ranked = sized.withColumn("ok", fits).withColumn("variant", F.explode(F.sequence(F.lit(0), last)))
    return ranked.select(
        *keys,
        F.when(F.col("ok"), "expanded").otherwise("over_budget").alias("status"),
        F.when(F.col("ok"), F.col("variant")).alias("variant"),
        F.when(F.col("ok"), unrank(F.col("domains"), F.col("variant"))).alias("word"),
    )


def assignment_text(template: Column, word: Column) -> Column:
    """``place=base; ...`` of a word's places that the template leaves open, counted from 1."""
    cells = F.transform(
        F.split(template, ""),
        lambda s, i: F.when(~s.isin("A", "C", "G", "T", ""), F.concat((i + 1).cast("string"), F.lit("="), F.substring(word, i + 1, F.lit(1)))),
    )
    return F.array_join(F.array_compact(cells), "; ")


def words_of(spark: SparkSession, size: int) -> DataFrame:
    """All words over ACGT of one length, with their rank."""
    domains = F.array(*[F.lit(15)] * size)
    return spark.range(4**size).select(F.col("id").alias("rank"), unrank(domains, F.col("id")).alias("word"))


def global_rank(df: DataFrame, word: str) -> DataFrame:
    """``rank`` from 0 in the order of distinct words, by ranges of words."""
    return rank_within(df, word)


def hamming(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x
    )


def seeded_order(df: DataFrame, word: str, seed: str) -> DataFrame:
    """Distance of each word's start to the seed, and the word's rank by (distance, word)."""
    away = df.withColumn("distance", hamming(F.substring(word, 1, len(seed)), F.lit(seed)))
    keyed = away.withColumn("_key", F.concat(F.lpad(F.col("distance").cast("string"), 4, "0"), word))
    return global_rank(keyed, "_key").drop("_key")


def member_at(df: DataFrame, word: str, ranks: DataFrame) -> DataFrame:
    """The words at the asked ranks (column ``rank``) of the set in word order; a rank past the end has no word."""
    return ranks.join(global_rank(df, word), "rank", "left")


def rank_parts(df: DataFrame, word: str, low: int, high: int, parts: int) -> DataFrame:
    """The words of a rank window [low, high), dealt to parts by rank modulo their number."""
    ranked = global_rank(df, word).where((F.col("rank") >= low) & (F.col("rank") < high))
    return ranked.withColumn("part", F.col("rank") % parts)


def grid(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Coordinates with their rank by (sum, coordinates)."""
    out = spark.range(1).select()
    for i, n in enumerate(sizes):
        out = out.crossJoin(spark.range(n).select(F.col("id").alias(f"c{i}")))
    names = [f"c{i}" for i in range(len(sizes))]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    out = out.withColumn("total", total)
    sums = out.groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("total").rowsBetween(Window.unboundedPreceding, -1)  # one row a sum
    offsets = sums.select("total", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("total").orderBy(*names)
    return out.join(offsets, "total").withColumn("rank", F.col("base") + F.row_number().over(order) - 1).drop("base")


def interleave(df: DataFrame, population: str, member: str) -> DataFrame:
    """Round-robin: first the first member of each population, then the second of each.

    Members are numbered by ranges, so neither a population nor the turns meet in one task; a turn starts after all rows of
    the turns before it, and within a turn populations follow in order.
    """
    numbered = rank_within(df, member, "turn", population)
    sizes = numbered.groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(sizes, "turn", "n", "base").select("turn", "base")
    inside = Window.partitionBy("turn").orderBy(population)
    return numbered.join(starts, "turn").withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("turn", "base")


def subsets(df: DataFrame, group: str, item: str, width: int) -> DataFrame:
    """Nonempty subsets of each group's items up to a width, as ascending arrays."""
    base = df.select(group, item).distinct()
    level = base.select(group, F.array(item).alias("members"))
    out = level
    for _ in range(width - 1):
        level = level.join(base, group).where(F.col(item) > F.element_at("members", -1)).select(group, F.concat("members", F.array(item)).alias("members"))
        out = out.unionByName(level)
    return out


PER_TASK = 250_000  # rows that a task sorts, about
BLOCK = 1 << 12


def _islands(df: DataFrame, by: list[str], low: str, high: str, gap: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(low) > reach + gap), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min(low).alias("low"), F.max(high).alias("high")).drop("_island")


def merged_intervals(df: DataFrame, key: str, low: str, high: str, gap: int = 1) -> DataFrame:
    """Integer intervals of each key, merged where they touch (gaps and islands).

    Intervals are merged within blocks of low ends first, and the islands of the blocks after them, both over as many tasks as there are
    rows for: what a task sorts does not grow with the table, and of a large key only the islands meet.
    """
    rows = df.select(key, F.col(low).alias("low"), F.col(high).alias("high"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_TASK))
    blocks = rows.withColumn("_block", F.floor(F.col("low") / BLOCK)).repartition(tasks, key, "_block")
    merged = _islands(blocks, [key, "_block"], "low", "high", gap).drop("_block").repartition(tasks, key)
    return _islands(merged, [key], "low", "high", gap)


def window_words(df: DataFrame, seq: str, start: int, end: int) -> DataFrame:
    """Distinct substrings of a window, for sequences that reach its end."""
    return df.where(F.length(seq) >= end).select(F.substring(seq, start + 1, end - start).alias("word")).distinct()
