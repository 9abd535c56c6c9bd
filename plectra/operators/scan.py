"""Motif scans: windows of each motif length, hash-joined to the motifs' exact words.

Sequences are cut into pieces that overlap by a window less one base, coarse ones first, so that work is linear in a
sequence's length; a piece without any motif makes no window.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dna import BASES, COMPLEMENTS, SYMBOLS

WORD_BUDGET = 4096
COARSE, FINE = 4096, 64


def reverse_motif(motif: str) -> str:
    return motif.translate(str.maketrans(SYMBOLS, COMPLEMENTS))[::-1]


def motif_words(motif: str, budget: int = WORD_BUDGET) -> list[str]:
    """Exact words of a motif in lexical order; the count is checked before any is made."""
    size = 1
    for symbol in motif:
        size *= len(BASES[symbol])
    if size > budget:
        raise ValueError(f"{motif} stands for {size} words, over the budget of {budget}")
    return ["".join(w) for w in product(*(BASES[s] for s in motif))]


def word_table(spark: SparkSession, motifs: list[tuple]) -> DataFrame:
    """(agent_id, orientation, word, size, first, second) from (id, motif, first, second).

    ``first`` and ``second`` are offsets on the motif as written; reversed, both count from the other end and
    change places, as the top cut of one strand is the bottom cut of the other.
    """
    rows = []
    for agent_id, motif, first, second in motifs:
        n = len(motif)
        rows += [(agent_id, "forward", w, n, first, second) for w in motif_words(motif)]
        rows += [(agent_id, "reverse", w, n, n - second, n - first) for w in motif_words(reverse_motif(motif))]
    return spark.createDataFrame(rows, "agent_id string, orientation string, word string, size int, first int, second int")


def motif_pattern(motifs: list[str]) -> str:
    """A regular expression for any of the motifs, either way round."""
    both = sorted({m for motif in motifs for m in (motif, reverse_motif(motif))})
    return "|".join("".join(f"[{BASES[s]}]" for s in m) for m in both)


def pieces(df: DataFrame, keys: list[str], seq: str, over: int) -> DataFrame:
    """(keys, n_nt, base, piece): a sequence in pieces that share ``over`` bases with the next one."""

    def cut(rows: DataFrame, text: str, starts: int, width: int) -> DataFrame:
        at = F.sequence(F.lit(0), F.least(F.length(text), F.lit(starts)) - 1, F.lit(width))
        parts = rows.where(F.length(text) > 0).select(*keys, "n_nt", "base", F.col(text).alias("whole"), F.explode(at).alias("_at"))
        return parts.select(*keys, "n_nt", (F.col("base") + F.col("_at")).alias("base"), F.substring(F.col("whole"), F.col("_at") + 1, F.lit(width + over)).alias("piece"))

    whole = df.select(*keys, F.length(seq).alias("n_nt"), F.lit(0).alias("base"), F.col(seq).alias("piece"))
    return cut(cut(whole, "piece", 2**31 - 1, COARSE), "piece", COARSE, FINE)


def windows(df: DataFrame, keys: list[str], seq: str, sizes: list[int], pattern: str | None = None) -> DataFrame:
    """(keys, n_nt, size, start, word): every overlapping window of each size, of pieces that hold ``pattern``."""
    fine = pieces(df, keys, seq, max(sizes) - 1)
    if pattern is not None:
        fine = fine.where(F.col("piece").rlike(pattern))
    sized = fine.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.length("piece") >= F.col("size"))
    placed = sized.withColumn("_o", F.explode(F.sequence(F.lit(0), F.least(F.lit(FINE - 1), F.length("piece") - F.col("size")))))
    return placed.select(*keys, "n_nt", "size", (F.col("base") + F.col("_o")).alias("start"), F.substring(F.col("piece"), F.col("_o") + 1, F.col("size")).alias("word"))


def distinct_words(df: DataFrame, seq: str, size: int) -> DataFrame:
    """The distinct words of all windows of all sequences; a piece gives each of its words once."""
    starts = F.sequence(F.lit(0), F.length("piece") - size)
    words = F.array_distinct(F.transform(starts, lambda i: F.substring("piece", i + 1, F.lit(size))))
    return pieces(df, [], seq, size - 1).where(F.length("piece") >= size).select(F.explode(words).alias("word")).distinct()


def scan(df: DataFrame, keys: list[str], seq: str, words: DataFrame, sizes: list[int], pattern: str) -> DataFrame:
    """Sites (keys, agent_id, orientation, start, first, second) whose two boundaries lie in the sequence.

    A start lies in one piece, and words, agents and orientations are unique, so a row of ``df`` gives a site once.
    """
    hits = windows(df, keys, seq, sizes, pattern).join(words, ["size", "word"])
    at = lambda c: F.col("start") + F.col(c)
    inside: Column = (F.least(at("first"), at("second")) >= 0) & (F.greatest(at("first"), at("second")) <= F.col("n_nt"))
    return hits.where(inside).select(*keys, "agent_id", "orientation", "start", at("first").alias("first"), at("second").alias("second"))


def scan_nicks(df: DataFrame, keys: list[str], seq: str, agents: list[tuple]) -> DataFrame:
    """Agents are (id, motif, native strand, cut offset); a reversed site nicks the other strand."""
    spark = df.sparkSession
    words = word_table(spark, [(i, motif, cut, cut) for i, motif, _, cut in agents])
    native = spark.createDataFrame([(i, strand) for i, _, strand, _ in agents], "agent_id string, native string")
    other = F.when(F.col("native") == "top", "bottom").otherwise("top")
    motifs = [a[1] for a in agents]
    sites = scan(df, keys, seq, words, sorted({len(m) for m in motifs}), motif_pattern(motifs)).join(native, "agent_id")
    strand = F.when(F.col("orientation") == "forward", F.col("native")).otherwise(other)
    return sites.select(*keys, "agent_id", "orientation", "start", F.col("first").alias("nick_boundary"), strand.alias("nicked_strand"))


def scan_releases(df: DataFrame, keys: list[str], seq: str, agents: list[tuple]) -> DataFrame:
    """Agents are (id, motif, top cut, bottom cut)."""
    motifs = [a[1] for a in agents]
    sites = scan(df, keys, seq, word_table(df.sparkSession, agents), sorted({len(m) for m in motifs}), motif_pattern(motifs))
    return sites.select(*keys, "agent_id", "orientation", "start", F.col("first").alias("top_cut"), F.col("second").alias("bottom_cut"))


def motif_presence(df: DataFrame, keys: list[str], seq: str, motif: str) -> DataFrame:
    """``guaranteed`` if some window of a symbolic sequence lies within the motif, ``possible`` if one meets it."""

    def symbols(bases: str, within: bool) -> str:
        fits = (lambda s: set(BASES[s]) <= set(bases)) if within else (lambda s: set(BASES[s]) & set(bases))
        return "".join(s for s in SYMBOLS if fits(s))

    def found(within: bool) -> Column:
        patterns = {"".join(f"[{symbols(BASES[s], within)}]" for s in m) for m in (motif, reverse_motif(motif))}
        return F.col(seq).rlike("|".join(sorted(patterns)))

    status = F.when(found(True), "guaranteed").when(found(False), "possible").otherwise("absent")
    return df.select(*keys, status.alias("status"))
