"""Append-only evaluation steps: coverage, continuity, replay, partitions, and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def coverage(steps: DataFrame) -> DataFrame:
    """What is known of each target; support beats exhaustion, and neither is unresolved."""
    state = F.when(F.sum("witness") > 0, "supported").when(F.max("exhausted") == 1, "excluded").otherwise("unresolved")
    return steps.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("witness").alias("witnesses"),
        F.max("exhausted").alias("exhausted"),
        F.max("step").alias("last_step"),
        F.max_by("event_id", "step").alias("last_event"),
        state.alias("state"),
    )


def violations(steps: DataFrame) -> DataFrame:
    """Steps that skip a number, or that follow the end of their target."""
    order = Window.partitionBy("ordinal").orderBy("step")
    before = F.coalesce(F.lag("step").over(order), F.lit(0))
    closed = F.coalesce(F.max("exhausted").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = steps.select("ordinal", "step", before.alias("before"), closed.alias("after_end"))
    return marked.where("step <> before + 1 or after_end = 1").select("ordinal", "step", "after_end")


def replay(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks; empty if the replay agrees."""
    missing = recorded.exceptAll(again).withColumn("side", F.lit("missing"))
    return missing.unionByName(again.exceptAll(recorded).withColumn("side", F.lit("unexpected")))


def combined(steps: DataFrame) -> DataFrame:
    """Targets and steps of each part, and whether none of its targets is in another."""
    parts = steps.groupBy("ordinal").agg(F.countDistinct("part").alias("parts"), F.min("part").alias("part"), F.count(F.lit(1)).alias("steps"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("targets"), F.sum("steps").alias("steps"), (F.max("parts") == 1).alias("disjoint"))


def storage(rows: DataFrame, content: str) -> DataFrame:
    """Records and the bytes of their content; of an empty log none and 0."""
    return rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length(content).cast("long")), F.lit(0)).alias("bytes"))


def append_new(batch: DataFrame, log_path: str) -> None:
    """Append the steps that the log lacks: for ``foreachBatch``, where a batch may come twice."""
    spark = batch.sparkSession
    batch = batch.dropDuplicates(["ordinal", "step"])
    try:
        known = spark.read.parquet(log_path).select("ordinal", "step")
    except Exception as error:  # the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    (batch if known is None else batch.join(known, ["ordinal", "step"], "left_anti")).write.mode("append").parquet(log_path)


def stream_steps(spark: SparkSession, source: str, schema: str, log_path: str, checkpoint: str):
    """Follow a folder of Parquet steps into the log; the caller stops or awaits the query."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_new(df, log_path)).start()
