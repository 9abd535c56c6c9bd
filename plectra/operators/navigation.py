"""Pages over a grid of coordinates in order of their distance, and exclusions learned from conflicts.

A navigator visits nodes (context, coordinates) wave by wave; a wave is the context plus the sum of the coordinates.  A cursor is the
last node looked at; the next page starts behind it, so no page is counted off from the beginning.  How many nodes each
wave has follows from the sizes alone, which bounds the waves that a page can reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import reverse_complement
from ..sources.shared import written
from .arms import motif_class


@dataclass
class Page:
    """``rows`` in order, the ``cursor`` behind which the next page starts (None at the end), and the nodes looked at."""

    rows: DataFrame
    cursor: tuple[int, ...] | None
    examined: int


def wave_sizes(sizes: list[int]) -> list[int]:
    """How many nodes of a grid have each sum of coordinates."""
    counts = [1]
    for n in sizes:
        wider = [0] * (len(counts) + n - 1)
        for i, c in enumerate(counts):
            for k in range(n):
                wider[i + k] += c
        counts = wider
    return counts


def wave_nodes(spark: SparkSession, sizes: list[int], low: int, high: int) -> DataFrame:
    """(wave, c0, c1, ...) of the nodes in the waves from ``low`` to ``high``: the last coordinate follows from the others."""
    names = [f"c{i}" for i in range(len(sizes))]
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("_sum"))
    for name, n in zip(names[:-1], sizes[:-1]):
        nodes = nodes.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.lit(high).cast("long") - F.col("_sum")))))
        nodes = nodes.withColumn("_sum", F.col("_sum") + F.col(name))
    last = sizes[-1] - 1
    ends = nodes.withColumn("_low", F.greatest(F.lit(0).cast("long"), low - F.col("_sum"))).withColumn("_high", F.least(F.lit(last).cast("long"), high - F.col("_sum")))
    ends = ends.where("_low <= _high").withColumn(names[-1], F.explode(F.sequence("_low", "_high")))
    return ends.select((F.col("_sum") + F.col(names[-1])).alias("wave"), *names)


def scan_page(
    spark: SparkSession, sizes: list[int], pages: DataFrame, empty_planes: DataFrame, plane: list[str], cursor: tuple[int, ...] | None, page_size: int, max_nodes: int
) -> Page:
    """The next page: up to ``page_size`` nodes that ``pages`` (c0, c1, ..., and what they hold) has, among the next ``max_nodes``.

    Nodes on a plane of ``empty_planes`` count as looked at and are not asked for.  The cursor is the last node of a full page, else the last node looked at.
    """
    names = [f"c{i}" for i in range(len(sizes))]
    counts = wave_sizes(sizes)
    low = cursor[0] if cursor else 0
    high, reachable = low, 0
    while high < len(counts) - 1 and reachable < max_nodes:  # the cursor's own wave may lie behind it
        high += 1
        reachable += counts[high]
    order = ["wave", *names]
    nodes = wave_nodes(spark, sizes, low, high)
    if cursor:
        nodes = nodes.where(F.struct(*order) > F.struct(*[F.lit(int(v)).cast("long").alias(n) for n, v in zip(order, cursor)]))
    frontier = written(nodes.orderBy(*order).limit(max_nodes), "frontier")  # at most max_nodes rows
    open_ = frontier.join(empty_planes.select(*plane).distinct(), plane, "left_anti")
    found = open_.join(pages, names).orderBy(*order).limit(page_size)
    last = frontier.agg(F.max(F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n")).first()
    held = found.agg(F.max(F.struct(*order)).alias("last"), F.count(F.lit(1)).alias("n")).first()
    full = held.n == page_size
    end = (held if full else last).last
    done = end is None or (not full and last.n < max_nodes)
    return Page(found, None if done else tuple(end), int(last.n))


def site_patterns(conflicts: DataFrame, motifs: DataFrame, word: str, flank: str) -> DataFrame:
    """(pattern, motif_id, orientation, start): what a word must not look like, from sites seen in words followed by ``flank``.

    A pattern holds the motif's symbols where the site covers the word and N elsewhere.  A site that lies in the flank
    alone says nothing about words.  The site's other symbols agree with the flank, which every word shares.
    """
    size = F.length(word)
    turned = motifs.select("motif_id", F.lit("forward").alias("orientation"), "motif").unionByName(
        motifs.select("motif_id", F.lit("reverse").alias("orientation"), reverse_complement(F.col("motif")).alias("motif"))
    )
    source = F.concat(F.col(word), F.lit(flank))
    starts = F.sequence(F.lit(0), F.greatest(F.least(size - 1, F.length(source) - F.length("motif")), F.lit(-1)))
    sites = conflicts.select(word).distinct().crossJoin(F.broadcast(turned))  # a catalogue of motifs
    fits = F.length(source) >= F.length("motif")
    placed = sites.where(fits).withColumn("start", F.explode(starts)).where("start >= 0").where(F.rlike(F.substring(source, F.col("start") + 1, F.length("motif")), motif_class(F.col("motif"))))
    inside = F.substring(F.col("motif"), F.lit(1), size - F.col("start"))
    pattern = F.rpad(F.concat(F.repeat(F.lit("N"), F.col("start")), inside), size, F.lit("N"))
    return placed.select(pattern.alias("pattern"), "motif_id", "orientation", "start").distinct()


def without_patterns(words: DataFrame, word: str, patterns: DataFrame) -> DataFrame:
    """Words that match no learned pattern.  Patterns are as many as a catalogue's motifs have places in a word."""
    learned = patterns.select("pattern").distinct()
    return words.join(F.broadcast(learned), F.rlike(F.col(word), motif_class(F.col("pattern"))), "left_anti")
