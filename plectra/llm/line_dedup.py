"""Line deduplication with levelled sorted runs of line hashes.

Documents come in batches, largest ids first.  A batch's line keys, each with its number of documents, are merge-joined with the
runs so far and form the batch's own sorted run: a key that no run has yet (the anti-joined part) brings the id that
first held it (the largest one, as batches descend), one that is known brings its number alone.  Compaction merges the runs
of a level into one of the next: numbers are added up, and a key has one holder.  At the end a key is repeated if its number
reaches ``min_docs`` over all runs; its lines stay only in the document that holds the key.

Defined results: a null or empty text is one empty line; a row is a document, so repeated rows count
each; among rows that tie on the holding id all keep the line; a null id is below every other id; empty
tables give empty results; other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import ascii_lower, hash_pair, order_id, table, write_table

BLANKS = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hashes(text: Column, min_chars: int) -> Column:
    """One entry a line: the key's 128-bit hash, or null for keys that are too short.

    Each step has its own transform: Spark evaluates a lambda's body anew wherever it is named.
    """
    keys = F.transform(split_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, hash_pair(key)))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, holder), each key once a run; the holder stands in one run only."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Take a batch of (h1, h2, id), one row for each document and distinct key; return its new run."""
        own = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("holder"))
        fresh = F.lit(True)
        for i, run in enumerate(self.runs()):
            known = run.select("h1", "h2", F.lit(True).alias(f"seen{i}"))
            own = own.join(known.hint("merge"), ["h1", "h2"], "left")
            fresh = fresh & F.col(f"seen{i}").isNull()
        own = own.select("h1", "h2", "n_docs", F.when(fresh, F.col("holder")).alias("holder"))
        run = write_table(own.sortWithinPartitions("h1", "h2"), "line-run")
        self.levels[0].append(run)
        self.compact()
        return run

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        return every.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def compact(self) -> None:
        """Merge a full level into one run of the next."""
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                merged = self.merged(self.levels[depth]).sortWithinPartitions("h1", "h2")
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(write_table(merged, f"line-run-l{depth + 1}"))
                self.levels[depth] = []

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, holder) of keys found in ``min_docs`` documents or more."""
        return self.merged(self.runs()).where(F.col("n_docs") >= min_docs).drop("n_docs")


def document_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Id ranges, largest first; Parquet row groups outside a range are skipped."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    edges = [low + (high - low + 1) * i // batches for i in range(1, batches)]
    cuts = sorted(set(edges), reverse=True)
    parts, upper = [], None
    for cut in cuts:
        here = F.col("doc_id") >= cut
        parts.append(docs.where(here if upper is None else here & (F.col("doc_id") < upper)))
        upper = cut
    rest = F.col("doc_id").isNull()
    parts.append(docs.where(rest | (F.col("doc_id") < upper)) if upper is not None else docs)
    return parts


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """``docs`` as struct ``doc`` beside n_lines, n_dropped and kept_text."""
    runs = LineRuns(fanout)
    for part in document_batches(docs.select("doc_id", "text"), batches):
        hashes = F.array_compact(F.array_distinct(key_hashes(F.col("text"), min_chars)))
        runs.add(part.select(order_id().alias("id"), F.explode(hashes).alias("k")).select("id", "k.h1", "k.h2"))
    # Written, so that its size is known and neither side of the join below is an aggregate: Spark can then broadcast a small
    # table, or split the places of a line that a third of all documents hold.
    repeated = write_table(runs.repeated(min_docs), "line-repeated")

    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    places = (
        docs.select(
            order_id().alias("id"),
            text_hash.alias("th"),
            F.posexplode(key_hashes(F.col("text"), min_chars)).alias("line", "k"),
        )
        .where(F.col("k").isNotNull())
        .select("id", "th", "line", "k.h1", "k.h2")
    )
    dropped = (
        places.join(repeated, ["h1", "h2"])
        .where(F.col("id") < F.col("holder"))
        .groupBy("id", "th")
        .agg(F.collect_set("line").alias("gone"))
    )
    rows = docs.select(F.struct("*").alias("doc"), order_id().alias("id"), text_hash.alias("th"))
    joined = rows.join(dropped, ["id", "th"], "left").select("doc", "gone", split_lines(F.col("doc.text")).alias("lines"))
    marks = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform("keep", lambda i: F.get(F.col("lines"), i)), "\n")
    return (
        joined.withColumn("keep", F.when(F.col("gone").isNotNull(), marks))
        .select(
            "doc",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(kept).alias("kept_text"),
        )
    )


def clean_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept text, and its length where the documents carry one."""
    made = dedup_lines(docs, **options)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return made.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), e AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e
), r AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id < r.holder) AS gone
  FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
