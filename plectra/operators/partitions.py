"""Source partitions: which subsets of cutting agents leave exactly the required fragments above a length.

Cuts of a subset are those of its agents together; every subset is cut at once, as rows.  A subset is judged by an ordered
cascade: an agent without a site, required fragments that are not among the fragments, no length up to the absolute limit
that the other fragments stay within, and required fragments that do not exceed that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import reverse_complement
from .arms import motif_class

# The reasons against a subset.
SITE_ABSENT, MISMATCH, NO_THRESHOLD = "site_absent", "retained_fragment_set_mismatch", "fragment_threshold_infeasible"


def nick_sites(sources: DataFrame, agents: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, agent_id, strand, boundary) of agents (agent_id, motif, native, cut) on both strands; cuts at or beyond an end are none.

    Sources are short and agents a catalogue, so places are found in arrays; a motif that is its own reverse complement
    cuts on both strands.
    """
    n, m = F.length(seq), F.length("motif")

    def starts(pattern: Column) -> Column:
        every = F.when(n >= m, F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda i: F.rlike(F.substring(F.col(seq), i + 1, m), pattern))

    other = F.when(F.col("native") == "top", "bottom").otherwise("top")
    forward = F.transform(starts(motif_class(F.col("motif"))), lambda i: F.struct(F.col("native").alias("strand"), (i + F.col("cut")).alias("boundary")))
    reverse = F.transform(starts(motif_class(reverse_complement(F.col("motif")))), lambda i: F.struct(other.alias("strand"), (i + m - F.col("cut")).alias("boundary")))
    pairs = sources.select(key, seq).crossJoin(agents.select("agent_id", "motif", "native", "cut"))  # a catalogue beside each source
    sites = pairs.select(key, "agent_id", n.alias("_n"), F.inline(F.concat(forward, reverse)))
    return sites.where((F.col("boundary") > 0) & (F.col("boundary") < F.col("_n"))).drop("_n").distinct()


def fragments(cuts: DataFrame, lengths: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """(keys, strand, start, stop) between neighbouring cuts (keys, strand, boundary); both strands of a source without cuts are whole.

    ``lengths`` (keys, n_nt) has a row for each group of ``keys``; ``on`` are the columns it shares with ``cuts``.
    """
    ends = lengths.select(*keys, F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("strand"), F.explode(F.array(F.lit(0), F.col("n_nt"))).alias("boundary"))
    every = cuts.select(*keys, "strand", F.col("boundary").cast("int")).unionByName(ends.select(*keys, "strand", F.col("boundary").cast("int"))).distinct()
    stop = F.lead("boundary").over(Window.partitionBy(*keys, "strand").orderBy("boundary"))
    return every.withColumn("stop", stop).where(F.col("stop").isNotNull()).select(*keys, "strand", F.col("boundary").alias("start"), "stop")


def judged(sources: DataFrame, sites: DataFrame, subsets: DataFrame, required: DataFrame, key: str, preferred: int, absolute: int) -> DataFrame:
    """(key, subset, ordinal, failure, threshold, n_fragments, boundary_nicks, cleanup_nicks) of every source and subset.

    ``sources`` (key, n_nt); ``subsets`` (subset, ordinal, agents); ``required`` (key, strand, start, stop).
    """
    members = subsets.select("subset", "ordinal", F.explode("agents").alias("agent_id"))
    grid = sources.select(key, "n_nt").crossJoin(subsets.select("subset", "ordinal", F.size("agents").alias("n_agents")))
    cuts = sites.join(members.select("subset", "agent_id"), "agent_id")
    found = cuts.groupBy(key, "subset").agg(F.countDistinct("agent_id").alias("n_found"))
    pieces = fragments(cuts.select(key, "subset", "strand", "boundary"), grid, [key, "subset"], [key])
    needed = required.withColumn("needed", F.lit(True))
    marked = pieces.join(needed, [key, "strand", "start", "stop"], "left")
    size = F.col("stop") - F.col("start")
    told = marked.groupBy(key, "subset").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.count("needed").alias("n_kept"),
        F.max(F.when(F.col("needed").isNull(), size)).alias("longest_other"),
        F.min(F.when(F.col("needed"), size)).alias("shortest_kept"),
    )
    edges = required.select(key, "strand", F.explode(F.array("start", "stop")).alias("boundary")).distinct().withColumn("edge", F.lit(True))
    nicks = cuts.select(key, "subset", "strand", "boundary").distinct().join(edges, [key, "strand", "boundary"], "left")
    counted = nicks.groupBy(key, "subset").agg(F.count("edge").alias("boundary_nicks"), F.count_if(F.col("edge").isNull()).alias("cleanup_nicks"))
    wanted = required.groupBy(key).agg(F.count(F.lit(1)).alias("n_required"))
    rows = grid.join(found, [key, "subset"], "left").join(told, [key, "subset"], "left").join(counted, [key, "subset"], "left").join(wanted, key, "left")
    rows = rows.fillna(0, ["n_found", "n_kept", "n_required", "boundary_nicks", "cleanup_nicks"])
    threshold = F.greatest(F.lit(preferred), F.coalesce("longest_other", F.lit(0)))
    failure = (
        F.when(F.col("n_found") < F.col("n_agents"), SITE_ABSENT)
        .when(F.col("n_kept") < F.col("n_required"), MISMATCH)
        .when(threshold > absolute, NO_THRESHOLD)
        .when((F.col("n_required") == 0) | (F.col("shortest_kept") <= threshold), MISMATCH)
    )
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_fragments", "boundary_nicks", "cleanup_nicks")]
    return rows.withColumn("failure", failure).select(key, "subset", "ordinal", "failure", F.when(F.col("failure").isNull(), threshold).cast("long").alias("threshold"), *numbers)
