"""Bounded composition of ordered axes, with one disposition a combination.

Combinations are numbered, the last axis fastest.  Two budgets hold: combinations looked at, and combinations accepted; the
search stops before the next combination once enough are accepted.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, functions as F

from .ranks import rank_within
from .stops import stopped_search

ACCEPTED, REJECTED, TRUNCATED = "accepted", "rejected", "truncated"
ALL_VALID = "all_combinations_valid_required"


def product_nodes(axes: dict[str, DataFrame], max_nodes: int) -> DataFrame:
    """(ordinal, space_size, keys) of the first combinations; each axis holds distinct keys in a column of its name.

    Numbers are taken apart into one rank an axis and joined to the ranked axes, so no product is made beyond the budget.
    """
    spark = next(iter(axes.values())).sparkSession
    sizes = {name: axis.count() for name, axis in axes.items()}
    space = prod(sizes.values())
    nodes = spark.range(min(space, max_nodes)).select(F.col("id").alias("ordinal"), F.lit(space).cast("long").alias("space_size"))
    stride = 1
    for name in reversed(list(axes)):
        nodes = nodes.withColumn(f"_{name}", F.floor(F.col("ordinal") / stride) % max(1, sizes[name]))
        stride *= max(1, sizes[name])
    for name, axis in axes.items():
        nodes = nodes.join(rank_within(axis.select(name), name, f"_{name}"), f"_{name}").drop(f"_{name}")
    return nodes.select("ordinal", "space_size", *axes)


def dispositions(evaluated: DataFrame, max_accepted: int, all_valid: bool = False) -> DataFrame:
    """The examined combinations of ``evaluated`` (ordinal, space_size, ..., status, reason).

    With ``all_valid``, a whole search that rejected any combination rejects the accepted ones too.
    """
    codes = F.when(F.col("status") == ACCEPTED, F.array().cast("array<string>")).otherwise(F.array(F.col("status")))
    scoped = evaluated.withColumn("_all", F.lit(0)).withColumn("_codes", codes)
    examined = stopped_search(scoped, ["_all"], "ordinal", "_codes", max_accepted).drop("_all", "_codes", "stop")
    if not all_valid:
        return examined
    told = examined.agg(
        ((F.count(F.lit(1)) == F.max("space_size")) & (F.count_if(F.col("status") == REJECTED) > 0) & (F.count_if(F.col("status") == TRUNCATED) == 0)).alias("_flip")
    )
    flip = F.col("_flip") & (F.col("status") == ACCEPTED)
    both = examined.crossJoin(F.broadcast(told))  # one row
    return both.withColumn("reason", F.when(flip, F.lit(ALL_VALID)).otherwise(F.col("reason"))).withColumn("status", F.when(flip, REJECTED).otherwise(F.col("status"))).drop("_flip")


def composition_summary(disposed: DataFrame, max_nodes: int, max_accepted: int) -> DataFrame:
    """One row: nominal size, examined, dispositions by status, reasons, and what cut the search."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    found = disposed.agg(F.coalesce(F.max("space_size"), F.lit(0)).alias("nominal"), F.count(F.lit(1)).alias("examined"), n(ACCEPTED), n(REJECTED), n(TRUNCATED))
    by_hits = (F.col(ACCEPTED) >= max_accepted) & (F.col("examined") < F.least("nominal", F.lit(max_nodes)))
    cut = F.when(by_hits, "max_realizations").when(F.col("examined") < F.col("nominal"), "max_combinations")
    status = F.when(cut.isNotNull() | (F.col(TRUNCATED) > 0), "truncated").when(F.col(ACCEPTED) > 0, "complete").otherwise("infeasible")
    return found.withColumn("truncated_by", cut).withColumn("state", status)


def addresses(rows: DataFrame, axes: dict[str, DataFrame]) -> DataFrame:
    """Adds the ``ordinal`` of each row's combination in the product of the axes; a row off an axis has none."""
    ordinal = F.lit(0).cast("long")
    for name, axis in axes.items():
        rows = rows.join(rank_within(axis.select(name), name, f"_{name}"), name, "left")
        ordinal = ordinal * axis.count() + F.col(f"_{name}")
    return rows.withColumn("ordinal", ordinal).drop(*[f"_{name}" for name in axes])
