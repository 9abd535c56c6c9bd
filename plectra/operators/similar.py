"""Distances between preparations and exact nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dna import regional_difference


def scales(rows: DataFrame, shape: list[str]) -> DataFrame:
    """Range of each shape feature, as one row; a constant feature has range 0 and is left out."""
    return rows.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"range_{c}") for c in shape])


def shape_distance(shape: list[str]):
    """Mean of absolute differences by range, over the features that vary."""
    varies = [F.col(f"range_{c}") > 0 for c in shape]
    parts = [F.when(v, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.col(f"range_{c}")).otherwise(0.0) for v, c in zip(varies, shape)]
    count = sum((v.cast("int") for v in varies[1:]), varies[0].cast("int"))
    return F.when(count > 0, sum(parts[1:], parts[0]) / count).otherwise(0.0)


def sequence_distance(left: str, right: str):
    edits = F.levenshtein(left, right)
    return regional_difference(edits, F.length(left), F.length(right))


def distances(references: DataFrame, rows: DataFrame, key: str, shape: list[str], sequence: str) -> DataFrame:
    """(a, b, distance) of each stated reference against all rows: the mean of shape and sequence distance."""
    side = lambda df, s: df.select(F.col(key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in [*shape, sequence]])
    # The references are a stated query set, and each row is compared with every one of them: references x rows distances.
    pairs = side(rows, "b").crossJoin(side(references, "a")).where("a <> b").crossJoin(F.broadcast(scales(rows, shape)))  # one row
    distance = (shape_distance(shape) + sequence_distance(f"a_{sequence}", f"b_{sequence}")) / 2
    return pairs.select("a", "b", F.round(distance, 9).alias("distance"))


def neighbours(references: DataFrame, rows: DataFrame, key: str, shape: list[str], sequence: str, k: int) -> DataFrame:
    """The k nearest of each reference by (distance, key)."""
    order = Window.partitionBy("a").orderBy("distance", "b")
    return distances(references, rows, key, shape, sequence).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
