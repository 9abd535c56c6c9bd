"""Connected components by alternating large-star and small-star steps; every step is a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import write_table


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _joined(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: no id has two parents, and no parent has one itself."""
    up = edges.select(F.col("u").alias("id"), F.lit(1).alias("parents"), F.lit(0).alias("children"))
    down = edges.select(F.col("v").alias("id"), F.lit(0).alias("parents"), F.lit(1).alias("children"))
    ids = up.union(down).groupBy("id").agg(F.sum("parents").alias("parents"), F.max("children").alias("children"))
    return ids.where((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("children") > 0))).isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(id, root) of every id on an edge; the root is the least id of its component.

    Minima are joined back rather than neighbours collected, so a hub needs no list in one task.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = write_table(_distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "edges")
    for _ in range(rounds):
        if _joined(now):
            break
        # Large star: each neighbour above u is linked to the least of u and its neighbours.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that no side of the join is an aggregate and Spark can split a hub's edges, or broadcast a small table.
        least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: u and its lower neighbours are linked to the least of these.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = write_table(_distinct(small.union(low.select("u", F.col("m").alias("v")))), "edges")
    else:
        raise RuntimeError(f"components have not met after {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
