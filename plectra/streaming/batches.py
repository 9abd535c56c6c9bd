"""Resumable evaluation: batches of targets, each made visible by a manifest.

A batch's rows are written first, under a name of their own; then a manifest names them.  A reader opens what manifests
name and nothing else, so a batch that broke off is not seen, and its targets are evaluated again.  A manifest
also holds the rows' number and digest, by which a batch is checked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lineage import number_of

MANIFEST = "batch long, data string, plan string, targets long, rows long, bytes long, digest string"
# Why a run stopped.
BUDGET, EXHAUSTED, STORAGE = "evaluation_budget", "exhausted_enumeration", "checkpoint_storage_limit"


class TornBatch(ValueError):
    """A manifest names rows that are not what it says."""


@dataclass
class Progress:
    """What a run did: new targets, batches, all committed targets, and why it stopped."""

    new_targets: int
    new_batches: int
    targets: int
    reason: str


def digest_of(rows: DataFrame) -> tuple[int, int, str]:
    """(rows, bytes, digest): the digest is a sum, so it does not depend on the order of rows."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    r = rows.select(line.alias("line")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("b"), F.sum(number_of("line")).alias("d")).first()
    return r.n, int(r.b), str(r.d or 0)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """The committed batches; an empty table before the first."""
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests/*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all committed batches."""
    paths = [f"{folder}/{r.data}" for r in manifests(spark, folder).select("data").collect()]  # one row a batch
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_batch(rows: DataFrame, folder: str) -> str:
    """Writes rows that no manifest names yet; returns their name."""
    name = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{name}")
    return name


def commit(spark: SparkSession, folder: str, batch: int, data: str, plan: str, targets: int, facts: tuple[int, int, str]) -> None:
    """Writes the manifest of a batch; one of the same number refuses to be replaced."""
    row = spark.createDataFrame([(batch, data, plan, targets, *facts)], MANIFEST)
    row.coalesce(1).write.mode("error").json(f"{folder}/manifests/{batch:09d}")


def advance(
    targets: DataFrame,
    key: str,
    evaluate: Callable[[DataFrame], DataFrame],
    folder: str,
    plan: str,
    batch_size: int,
    max_targets: int,
    max_bytes: int | None = None,
) -> Progress:
    """Evaluates the next targets in order of their key, batch by batch, until a budget or the targets end.

    ``evaluate`` turns some targets into rows that keep ``key``; a target without rows still counts as done.  ``plan``
    names what is evaluated and how; a folder begun under another plan is refused.
    """
    spark = targets.sparkSession
    known = manifests(spark, folder).collect()  # one row a batch
    if {r.plan for r in known} - {plan}:
        raise ValueError("the folder holds another plan's batches")
    done, held = sum(r.targets for r in known), sum(r.bytes for r in known)
    batch = max((r.batch for r in known), default=-1) + 1
    # Targets are taken in key order, so what is done ends at the last key of the last batch.
    last = spark.read.json(f"{folder}/marks/{batch - 1:09d}").first()["last"] if known else None
    new = batches = 0
    while True:
        left = max_targets - new
        if left <= 0:
            return Progress(new, batches, done + new, BUDGET)
        if max_bytes is not None and held >= max_bytes:
            return Progress(new, batches, done + new, STORAGE)
        rest = targets if last is None else targets.where(F.col(key) > F.lit(last))
        chosen = rest.orderBy(key).limit(min(batch_size, left))
        end = chosen.agg(F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).first()
        if not end.n:
            return Progress(new, batches, done + new, EXHAUSTED)
        bounds = F.col(key) <= F.lit(end.last)
        own = targets.where(bounds if last is None else bounds & (F.col(key) > F.lit(last)))
        data = write_batch(evaluate(own), folder)
        facts = digest_of(spark.read.parquet(f"{folder}/{data}"))
        spark.createDataFrame([(end.last,)], ["last"]).coalesce(1).write.mode("overwrite").json(f"{folder}/marks/{batch:09d}")
        commit(spark, folder, batch, data, plan, end.n, facts)
        last, new, held, batch, batches = end.last, new + end.n, held + facts[1], batch + 1, batches + 1


def verify(spark: SparkSession, folder: str) -> int:
    """Checks every committed batch against its manifest; returns their number."""
    known = manifests(spark, folder).collect()
    for r in known:
        if digest_of(spark.read.parquet(f"{folder}/{r.data}")) != (r.rows, r.bytes, r.digest):
            raise TornBatch(f"batch {r.batch} differs from its manifest")
    return len(known)


def recomputed(targets: DataFrame, key: str, evaluate: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(side, and the rows): committed rows that a new evaluation of the same targets lacks, and the other way round."""
    spark = targets.sparkSession
    known = manifests(spark, folder).agg(F.max("batch").alias("batch")).first()
    fresh = evaluate(targets)
    if known.batch is None:
        return fresh.limit(0).withColumn("side", F.lit(""))
    last = spark.read.json(f"{folder}/marks/{known.batch:09d}").first()["last"]
    again = evaluate(targets.where(F.col(key) <= F.lit(last)))
    rows = committed(spark, folder, again.schema)
    missing = rows.exceptAll(again).withColumn("side", F.lit("unexpected"))
    return missing.unionByName(again.exceptAll(rows).withColumn("side", F.lit("missing")))


# Why partitions are not admitted.
ADMISSION = ("too_few", "too_many", "mixed_request", "mixed_effort", "overlapping", "undeclared", "incomplete")


def admission(parts: DataFrame, targets: DataFrame, most: int = 256) -> DataFrame:
    """One row: the number of parts, and the codes that forbid to combine them.

    ``parts`` (part, request, effort, ordinal) has a row a part and target; ``targets`` (ordinal) are those declared.  Parts
    agree in request and effort, and hold each declared target once; the order of parts does not matter.
    """
    rows = parts.select("part", "request", "effort", "ordinal").distinct()
    each = rows.groupBy("ordinal").agg(F.countDistinct("part").alias("held"))
    cover = targets.select("ordinal").distinct().withColumn("_d", F.lit(1)).join(each, "ordinal", "full")
    facts = cover.agg(
        F.count_if(F.col("held") > 1).alias("overlaps"), F.count_if(F.col("_d").isNull()).alias("undeclared"), F.count_if(F.col("held").isNull()).alias("missing")
    )
    said = rows.agg(F.countDistinct("part").alias("parts"), F.countDistinct("request").alias("requests"), F.countDistinct("effort").alias("efforts"))
    both = said.crossJoin(facts)  # one row each
    tests = [F.col("parts") < 2, F.col("parts") > most, F.col("requests") > 1, F.col("efforts") > 1, F.col("overlaps") > 0, F.col("undeclared") > 0, F.col("missing") > 0]
    codes = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(tests, ADMISSION, strict=True)]))
    return both.select("parts", "overlaps", "undeclared", "missing", F.array_join(codes, ",").alias("refused"))


def united(parts: DataFrame, steps: DataFrame, targets: DataFrame, most: int = 256) -> DataFrame:
    """The steps of all parts, if they may be combined; else none."""
    told = admission(parts, targets, most).select((F.col("refused") == "").alias("_ok"))
    return steps.crossJoin(F.broadcast(told)).where("_ok").drop("_ok")  # one row
