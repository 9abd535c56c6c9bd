"""Tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOWEST_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, a temporary one in local mode only: on a cluster
    each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plectra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(column: str | Column = "doc_id") -> Column:
    """A document's place in the id order; a null id comes before every other."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(LOWEST_ID))


def real_id(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(LOWEST_ID))


def text_hash(text: Column) -> Column:
    """With its id, this names a row: ids may be null or repeat with other texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; name a column, not a costly expression, as it is named four times."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def hash_pair(*columns: Column) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(7919), *columns).alias("h2"))
