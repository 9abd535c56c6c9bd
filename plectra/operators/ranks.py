"""Ranks and running totals of whole tables by ranges of a key.

A bounded sample, drawn by a hash of the key, gives the ranges' bounds; a key's range follows from the bounds alone, so it is the same
wherever a plan computes it.  Counts a range give each its offset, and rows are numbered within their range.  No
task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

PER_RANGE = 16
BEFORE = (Window.unboundedPreceding, -1)


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list:
    """Ascending bounds of at most ``ranges`` ranges (the shuffle partitions by default); the sample reaches the driver."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = df.select(F.col(key).alias("k")).where("k IS NOT NULL").orderBy(F.xxhash64("k")).limit(n * PER_RANGE).collect()
    found = sorted({r.k for r in drawn})
    return [found[len(found) * i // n] for i in range(1, n)] if found else []


def range_of(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key: searched among every m-th bound first, then among the m that follow it."""
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    at = F.size(F.filter(coarse, lambda b: b <= key))  # places after the bound (at - 1) * step
    near = F.slice(every, (at - 1) * step + 1, F.lit(step))
    inside = F.when(at == 0, 0).otherwise((at - 1) * step + F.size(F.filter(near, lambda b: b <= key)))
    return F.coalesce(inside, F.lit(0))


def running_total(df: DataFrame, key: str, value: str, name: str, group: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of lower keys, within ``group`` if one is named.

    Keys are unique within their group; a null key comes first.
    """
    groups = [group] if group else []
    part = range_of(F.col(key), range_bounds(df, key, ranges))
    ends = df.groupBy(*groups, part.alias("_part")).agg(F.sum(value).alias("_sum"))
    # One row a range (and group).
    begins = ends.select(*groups, "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_begin"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*groups, "_part").orderBy(F.col(key).asc_nulls_first()).rowsBetween(*BEFORE)), F.lit(0))
    return df.withColumn("_part", part).join(begins, [*groups, "_part"]).withColumn(name, F.col("_begin") + inside).drop("_part", "_begin")


def rank_within(df: DataFrame, key: str, name: str = "rank", group: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the rank from 0 by ``key``, of the whole table or within ``group``."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), key, "_one", name, group, ranges).drop("_one")
