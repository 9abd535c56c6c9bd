"""Cut geometry, base-mask intersections, levels and costs of construction candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import masks, reverse_complement
from .enumerate import global_rank
from .scan import windows


def oriented_nick(motif: Column, native: Column, cut: Column, target: Column) -> Column:
    """(motif, cut) as read on the target strand: reversed where that is not the native one."""
    same = native == target
    return F.struct(
        F.when(same, motif).otherwise(reverse_complement(motif)).alias("motif"),
        F.when(same, cut).otherwise(F.length(motif) - cut).alias("cut"),
    )


def oriented_release(motif: Column, top: Column, bottom: Column, orientation: Column) -> Column:
    """(motif, top, bottom): reversed, each strand's cut becomes the other's, counted from the far end."""
    forward = orientation == "forward"
    n = F.length(motif)
    return F.struct(
        F.when(forward, motif).otherwise(reverse_complement(motif)).alias("motif"),
        F.when(forward, top).otherwise(n - bottom).alias("top"),
        F.when(forward, bottom).otherwise(n - top).alias("bottom"),
    )


def coordinate_masks(df: DataFrame, keys: list[str], seq: str, start: Column) -> DataFrame:
    """(keys, coordinate, mask): one row a position of a template laid at ``start``."""
    laid = df.where(F.length(seq) > 0).select(*keys, start.alias("_start"), F.posexplode(masks(F.col(seq))).alias("_i", "mask"))
    return laid.select(*keys, (F.col("_start") + F.col("_i")).alias("coordinate"), "mask")


def intersected(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Bases that every layer allows at each coordinate; an empty set is a conflict."""
    met = layers.groupBy(*keys, "coordinate").agg(F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("layers"))
    size = F.bit_count("mask")
    return met.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("coordinates"),
        F.sum((size == 0).cast("long")).alias("conflicts"),
        F.round(F.sum(F.when(size > 0, F.log2(size.cast("double"))).otherwise(0.0)), 6).alias("log2_choices"),
    )


def level_summary(rows: DataFrame, group: str, level: str, accepted: str, quota: int) -> DataFrame:
    """Counts by level, with the accepted rows so far; a level past the quota is not visited."""
    counts = rows.groupBy(group, level).agg(F.count(F.lit(1)).alias("examined"), F.sum(F.col(accepted).cast("long")).alias("accepted"))
    order = Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("so_far", F.sum("accepted").over(order))
    before = F.col("so_far") - F.col("accepted")
    status = F.when(before >= quota, "unvisited").when(F.col("so_far") >= quota, "quota_met").otherwise("complete")
    return running.withColumn("status", status)


def runs_by_name(rows: DataFrame, keys: list[str], index: str, name: str) -> DataFrame:
    """Maximal runs of one name along an index."""
    order = Window.partitionBy(*keys).orderBy(index)
    new = F.when(F.lag(name).over(order).eqNullSafe(F.col(name)), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_run", name).agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def controls(rows: DataFrame, group: list[str], properties: list[str], member: str) -> DataFrame:
    """For each property of a group: shared, different, or unassessed where a member lacks it or is alone."""
    cells = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])
    long = rows.select(*group, F.col(member).alias("_m"), F.inline(cells))
    lacking = (F.count("value") < F.count(F.lit(1))) | (F.count(F.lit(1)) < 2)
    state = F.when(lacking, "unassessed").when(F.min("value") == F.max("value"), "shared").otherwise("different")
    return long.groupBy(*group, "property").agg(state.alias("state"), F.min("_m").alias("baseline"))


def effective_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Intersection of inclusive ranges: the greatest minimum and the least maximum; an empty one is a conflict."""
    met = ranges.groupBy(key).agg(F.max("low").alias("low"), F.min("high").alias("high"))
    return met.withColumn("conflict", F.col("low") > F.col("high"))


def preferred_first(words: DataFrame, preferred: DataFrame, word: str) -> DataFrame:
    """``place``: preferred words in order, then the rest in order; ``tier`` tells which.  A preferred word that is
    no word of the set is an error of its own row: tier -1, no place."""
    marked = words.withColumn("_w", F.lit(1)).join(preferred.select(F.col(word)).distinct().withColumn("_p", F.lit(0)), word, "full")
    marked = marked.withColumn("tier", F.when(F.col("_w").isNull(), -1).otherwise(F.coalesce("_p", F.lit(1)))).drop("_w", "_p")
    ranked = global_rank(marked.where("tier >= 0").withColumn("_key", F.concat(F.col("tier").cast("string"), word)), "_key")
    absent = marked.where("tier < 0").select(word, "tier", F.lit(None).cast("long").alias("place"))
    return ranked.select(word, "tier", F.col("rank").cast("long").alias("place")).unionByName(absent)


def word_occurrences(df: DataFrame, keys: list[str], seq: str, word: str) -> DataFrame:
    """Overlapping places of a literal word."""
    return windows(df, keys, seq, [len(word)], word).where(F.col("word") == word).select(*keys, "start")
