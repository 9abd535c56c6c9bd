"""Driver tables and their views as sequences and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import dna_view, iupac_view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", dna_view(F.col("text")).alias("dna"))


def item_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", dna_view(F.col("text")).alias("dna"))


def item_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", iupac_view(F.col("text")).alias("seq"))


DNA_SQL = "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))"
IUPAC_SQL = "upper(regexp_replace(coalesce(text, ''), '[^ACGTRYNacgtryn]', '', 'g'))"
