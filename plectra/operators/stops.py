"""Searches that stop: at a node budget, or once enough hits are found.

The node at which a search stops is found by counting hits in blocks of ordinals, summing the counts up, and looking into the one
block in which the wanted hit lies.  Groups are numbered on their own; no window spans more than a group's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import written

BLOCK = 128


def stopping_ordinals(nodes: DataFrame, keys: list[str], ordinal: str, hit: Column, max_hits: int, block: int = BLOCK) -> DataFrame:
    """(keys, stop): the ordinal of each group's ``max_hits``-th hit; a group with fewer has no row."""
    marked = nodes.withColumn("_block", F.floor(F.col(ordinal) / block)).withColumn("_hit", hit)
    counts = marked.groupBy(*keys, "_block").agg(F.count_if("_hit").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).where((F.col("_before") < max_hits) & (F.col("_before") + F.col("_n") >= max_hits)).drop("_n")
    inside = marked.where("_hit").select(*keys, "_block", F.col(ordinal).alias("stop")).join(last, [*keys, "_block"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("stop"))
    return inside.withColumn("_place", place).where(F.col("_place") == max_hits).select(*keys, "stop")


def stopped_search(nodes: DataFrame, keys: list[str], ordinal: str, codes: str, max_hits: int) -> DataFrame:
    """The nodes that the search examines: all up to its stop.  ``codes`` is an array, empty for a hit.  Adds ``stop``.

    Nodes are written, so that none is evaluated again to find the stop.
    """
    nodes = written(nodes, "nodes")
    stops = stopping_ordinals(nodes, keys, ordinal, F.size(codes) == 0, max_hits)
    return nodes.join(stops, keys, "left").where(F.col("stop").isNull() | (F.col(ordinal) <= F.col("stop")))


def accounting(examined: DataFrame, keys: list[str], codes: str, space: str, max_nodes: int) -> DataFrame:
    """(keys, space_size, examined, hits, status, truncated_by) of ``stopped_search``: a search stopped by its hits names
    these, one stopped by its nodes those, and no more than one of the two."""
    found = examined.groupBy(*keys).agg(
        F.max(space).alias("space_size"), F.count(F.lit(1)).alias("examined"), F.count_if(F.size(codes) == 0).alias("hits"), F.max("stop").alias("stop")
    )
    left = F.col("examined") < F.col("space_size")
    by = F.when(left & F.col("stop").isNotNull(), "max_hits").when(left, "max_search_nodes")
    status = F.when(left, "truncated").when(F.col("hits") > 0, "complete").otherwise("infeasible")
    return found.select(*keys, "space_size", "examined", "hits", status.alias("status"), by.alias("truncated_by"))


def rejections(examined: DataFrame, keys: list[str], codes: str) -> DataFrame:
    """(keys, code, nodes): how many examined nodes each code was given to."""
    return examined.select(*keys, F.explode(codes).alias("code")).groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("nodes"))
