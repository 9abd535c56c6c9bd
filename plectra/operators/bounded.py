"""Bounded searches with exact accounting.

A node budget cuts the traversal before any ordering, a hit budget cuts the ordered hits.  A cut is
``truncated`` even without hits; only a whole traversal without hits is ``infeasible``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Search:
    examined: DataFrame
    hits: DataFrame
    summary: DataFrame


def bounded_search(space: DataFrame, ordinal: str, blockers: Column, order: list[Column], max_nodes: int, max_hits: int) -> Search:
    """``ordinal`` counts the space from 0 without gaps; ``blockers`` is an array, empty for a hit.

    Hits get ``hit`` from 1.  The ordering is a top-k, which Spark takes from each partition's own top-k.
    """
    examined = space.where(F.col(ordinal) < max_nodes).withColumn("blockers", blockers)
    accepted = examined.where(F.size("blockers") == 0)
    top = accepted.orderBy(*order).limit(max_hits)
    hits = top.withColumn("hit", F.row_number().over(_whole(order)))
    counts = space.agg(F.count(F.lit(1)).alias("space_size")).crossJoin(
        examined.agg(
            F.count(F.lit(1)).alias("examined"), F.coalesce(F.sum((F.size("blockers") == 0).cast("long")), F.lit(0)).alias("observed")
        )
    )
    by_nodes, by_hits = F.col("space_size") > max_nodes, F.col("observed") > max_hits
    truncated = F.array_join(F.array_compact(F.array(F.when(by_nodes, F.lit("nodes")), F.when(by_hits, F.lit("hits")))), ",")
    status = F.when(by_nodes | by_hits, "truncated").when(F.col("observed") > 0, "complete").otherwise("infeasible")
    return Search(examined, hits, counts.select("space_size", "examined", "observed", status.alias("status"), truncated.alias("truncated_by")))


def _whole(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over at most max_hits rows
