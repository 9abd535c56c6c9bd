"""GenBank flat files: records with features as text, written by line and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What a feature is: a kind, a zero-based half-open span, its strand, and one qualifier.
FEATURE = "struct<kind: string, start: bigint, stop: bigint, complement: boolean, qualifier: string, value: string>"


def location(start: Column, stop: Column, complement: Column) -> Column:
    """A span as the format writes it: counted from 1, both ends inside."""
    span = F.concat((start + 1).cast("string"), F.lit(".."), stop.cast("string"))
    return F.when(complement, F.concat(F.lit("complement("), span, F.lit(")"))).otherwise(span)


def feature_lines(features: Column) -> Column:
    """Two lines a feature; quotation marks within a value are doubled."""
    return F.transform(
        features,
        lambda f: F.concat(
            F.lit(" " * 5), F.rpad(f["kind"], 16, " "), location(f["start"], f["stop"], f["complement"]),
            F.lit("\n" + " " * 21 + "/"), f["qualifier"], F.lit('="'), F.replace(f["value"], F.lit('"'), F.lit('""')), F.lit('"'),
        ),
    )


def origin_lines(sequence: Column) -> Column:
    """Lines of six words of ten bases, each begun by its first base's number."""
    rows = F.sequence(F.lit(0), F.ceil(F.length(sequence) / 60).cast("int") - 1)
    grouped = lambda i: F.rtrim(F.regexp_replace(F.lower(F.substring(sequence, i * 60 + 1, F.lit(60))), "(.{10})", "$1 "))
    lines = F.transform(rows, lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), grouped(i)))
    return F.when(F.length(sequence) > 0, lines).otherwise(F.array().cast("array<string>"))


def genbank_text(record_id: Column, sequence: Column, features: Column) -> Column:
    """One linear record as text; a null sequence is empty, and null features are none.

    The line of a source that spans the whole sequence comes first, then the features in their order.
    """
    seq = F.coalesce(sequence, F.lit(""))
    n = F.length(seq)
    name = record_id.cast("string")
    lines = F.concat(
        F.array(
            F.concat(F.lit("LOCUS       "), F.rpad(name, 16, " "), F.lpad(n.cast("string"), 12, " "), F.lit(" bp    ds-DNA     linear   SYN 01-JAN-1980")),
            F.concat(F.lit("DEFINITION  "), name, F.lit(".")),
            F.concat(F.lit("ACCESSION   "), F.substring(F.sha2(seq, 256), 1, 16)),
            F.lit("FEATURES             Location/Qualifiers"),
        ),
        F.when(n > 0, F.array(F.concat(F.lit(" " * 5), F.rpad(F.lit("source"), 16, " "), location(F.lit(0), n, F.lit(False))))).otherwise(F.array().cast("array<string>")),
        feature_lines(F.coalesce(features, F.array().cast(f"array<{FEATURE}>"))),
        F.array(F.lit("ORIGIN")),
        origin_lines(seq),
        F.array(F.lit("//")),
    )
    return F.array_join(lines, "\n")


def write_genbank(rows: DataFrame, record_id: str, sequence: str, features: str, path: str) -> None:
    """Each record as its lines; ids over 16 characters are an error, as the format would cut them."""
    name = F.col(record_id).cast("string")
    checked = F.when(F.length(name) > 16, F.raise_error("an id is over 16 characters").cast("string")).otherwise(name)
    rows.select(genbank_text(checked, F.col(sequence), F.col(features))).write.text(path)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, sequence, features) of records ended by ``//``; files are split at these by the reader.

    The source's own line is no feature.  A record whose sequence has not the length its first line tells is an error.
    """
    records = spark.read.option("lineSep", "\n//\n").text(path).where(F.trim("value") != "")
    body = F.element_at(F.split("value", r"(^|\n)ORIGIN[^\n]*", 2), 2)
    sequence = F.upper(F.regexp_replace(F.coalesce(body, F.lit("")), "[^A-Za-z]", ""))
    head = r"(?m)^LOCUS +(\S+) +(\d+) bp"
    told = F.regexp_extract("value", head, 2).cast("int")
    spans = r'(?m)^ {5}(\S+) +(complement\()?(\d+)\.\.(\d+)\)?\n +/([^=\s]+)="((?:[^"]|"")*)"'
    part = lambda g: F.regexp_extract_all("value", F.lit(spans), F.lit(g))
    cells = F.arrays_zip(*[part(g).alias(f"g{g}") for g in range(1, 7)])
    features = F.transform(
        cells,
        lambda c: F.struct(
            c["g1"].alias("kind"), (c["g3"].cast("bigint") - 1).alias("start"), c["g4"].cast("bigint").alias("stop"), (c["g2"] != "").alias("complement"),
            c["g5"].alias("qualifier"), F.replace(c["g6"], F.lit('""'), F.lit('"')).alias("value"),
        ),
    )
    rows = records.select(F.regexp_extract("value", head, 1).alias("record_id"), sequence.alias("sequence"), features.alias("features"), told.alias("_told"))
    wrong = F.col("_told").isNull() | (F.length("sequence") != F.col("_told"))
    return rows.select(F.when(wrong, F.raise_error("a record is not whole").cast("string")).otherwise(F.col("record_id")).alias("record_id"), "sequence", "features")
