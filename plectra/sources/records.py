"""Sequence records in and out: FASTA, CSV, duplicate policies, material orders and file manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import normalized


def read_fasta(spark: SparkSession, path: str, max_nt: int | None = None) -> DataFrame:
    """(record_id, sequence).  Records are split at header lines by the reader, so a file needs no single task."""
    parts = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    records = parts.select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("record_id"),
        F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")).alias("sequence"),
    )
    bad = F.col("record_id") == ""
    if max_nt is not None:
        bad = bad | (F.length("sequence") > max_nt)
    message = F.when(F.col("record_id") == "", "a header has no id").otherwise("a sequence is over the limit")
    return records.withColumn("record_id", F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("record_id")))


def read_csv(spark: SparkSession, path: str, id_column: str, sequence_column: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    missing = [c for c in (id_column, sequence_column) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(F.col(id_column).alias("record_id"), normalized(F.col(sequence_column)).alias("sequence"))


def limited(rows: DataFrame, max_records: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``rows`` (record_id, sequence), if they keep to the limits; too many records or bytes are an error, never a cut."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("sequence").cast("long")), F.lit(0)).alias("b")).first()
    if max_records is not None and facts.n > max_records:
        raise ValueError(f"{facts.n} records are over the limit of {max_records}")
    if max_bytes is not None and facts.b > max_bytes:
        raise ValueError(f"{facts.b} bytes are over the limit of {max_bytes}")
    return rows


def collect_records(rows: DataFrame, policy: str) -> DataFrame:
    """Unique ids are required; equal sequences fail, keep the first, or stay."""
    if policy not in ("fail", "dedupe", "keep"):
        raise ValueError(f"no such policy: {policy}")
    if rows.isEmpty():
        raise ValueError("there are no records")
    if not rows.groupBy("record_id").count().where("count > 1").isEmpty():
        raise ValueError("record ids repeat")
    if policy == "keep":
        return rows
    firsts = rows.groupBy("sequence").agg(F.min_by(F.struct("record_id", "ordinal"), "ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    if policy == "fail" and not firsts.where("n > 1").isEmpty():
        raise ValueError("sequences repeat")
    return firsts.select("first.record_id", "sequence", "first.ordinal")


def write_fasta(rows: DataFrame, record_id: str, sequence: str, path: str, width: int = 80) -> None:
    wrapped = F.regexp_replace(F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1 ")), " ", "\n")
    rows.select(F.concat(F.lit(">"), F.col(record_id), F.lit("\n"), wrapped)).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Nested columns go as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.csv(path, header=True, escape='"')


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    """Each relation as CSV in a folder of its own name, and a manifest of their rows and columns; nothing is written over.

    The manifest comes last, so that relations without one are not taken for a whole export.
    """
    facts = []
    for name, rows in relations.items():
        write_csv(rows, f"{folder}/{name}")
        facts.append((name, rows.count(), ",".join(rows.columns)))
    spark = next(iter(relations.values())).sparkSession
    spark.createDataFrame(facts, "relation string, rows long, columns string").coalesce(1).write.json(f"{folder}/relations")


def read_relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations of a whole export as text columns; one whose rows differ from the manifest's is an error."""
    out = {}
    for fact in spark.read.json(f"{folder}/relations").collect():  # one row a relation
        rows = spark.read.csv(f"{folder}/{fact.relation}", header=True, schema=", ".join(f"`{c}` string" for c in fact["columns"].split(",")), escape='"', multiLine=True)
        if rows.count() != fact.rows:
            raise ValueError(f"{fact.relation} has not {fact.rows} rows")
        out[fact.relation] = rows
    return out


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, size) of the files in a folder, hashed where they are read; paths are relative to the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(re.sub(r"^[a-z0-9]+:/*", "/", folder.rstrip("/")) + "/")
    name = F.element_at(F.split("path", F.concat(F.lit("\\Q"), root, F.lit("\\E")), 2), -1)
    return files.select(name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verify_manifest(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, extra or changed."""
    now = manifest(spark, folder).select("path", F.col("sha256").alias("now"))
    both = expected.select("path", F.col("sha256").alias("then")).join(now, "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")
