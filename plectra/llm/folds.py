"""Learning folds and bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label): up to ``per_class`` documents of each label among those ``learn`` allows.

    The choice goes by a hash of the id.  Ids are chosen from the label table alone; at most
    ``2 * per_class`` of them are broadcast to the documents, and only their texts are shuffled, so that rows which
    repeat an id keep to the bound as well.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1)).distinct()
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return sample_of_each(docs.join(F.broadcast(chosen), "doc_id"), "label", per_class)


def sample_of_each(docs: DataFrame, key: str, per_key: int) -> DataFrame:
    """Up to ``per_key`` rows of each key, by a hash of the id; Spark cuts the ranks before the shuffle too."""
    order = Window.partitionBy(key).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return docs.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_key).drop("_rank")


def within_bytes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of each key in the order of their ids' hash, as far as their texts together keep within ``most`` bytes.

    A text that alone has more is passed over; so what the driver collects is bounded for texts of any length.
    """
    order = Window.partitionBy(key).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    size = F.octet_length("text").cast("long")
    total = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.where(size <= most).withColumn("_total", total).where(F.col("_total") <= most).drop("_total")
