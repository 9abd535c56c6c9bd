"""Domains with shared variables, completions of contexts, release actions, comparisons of routes, and bounded matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import reverse_complement
from .lineage import number_of
from .ranks import rank_within
from .scan import motif_pattern


def complemented(mask: Column) -> Column:
    """The complements of a set of bases."""
    partner = {1: 8, 2: 4, 4: 2, 8: 1}
    return F.get(F.array(*[F.lit(sum(p for w, p in partner.items() if m & w)) for m in range(16)]), mask)


def shared_variables(places: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` (keys, place, variable, complement, mask) with ``domain``, and ``size`` and ``failure`` of each request.

    Places that show one variable, some of them complemented, share its bases: a variable keeps what all its places
    allow, and each place shows that again in its own sense.  The size counts variables, not places.
    """
    own = F.when(F.col("complement"), complemented(F.col("mask"))).otherwise(F.col("mask"))
    met = places.groupBy(*keys, "variable").agg(F.bit_and(own).alias("_met"))
    sized = met.groupBy(*keys).agg(
        F.round(F.exp(F.sum(F.when(F.bit_count("_met") > 0, F.log(F.bit_count("_met").cast("double"))).otherwise(0.0)))).cast("long").alias("_size"),
        F.min(F.when(F.col("_met") == 0, F.col("variable"))).alias("_bad"),
    )
    rows = places.join(met, [*keys, "variable"]).join(sized, keys)
    shown = F.when(F.col("complement"), complemented(F.col("_met"))).otherwise(F.col("_met"))
    failure = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("no_base_for_"), F.col("_bad").cast("string")))
    return rows.select(*places.columns, shown.alias("domain"), F.when(F.col("_bad").isNull(), F.col("_size")).otherwise(0).alias("size"), failure.alias("failure"))


def completions_of(contexts: DataFrame, word: str, suffixes: DataFrame, suffix: str, motifs: list[str]) -> DataFrame:
    """Adds ``completions``: how many ``suffixes`` behind a context make a word without a site, either way round.

    A site that crosses the border lies in the last bases of a context and the first of a suffix, one less than the longest motif; words are
    counted by these ends, so no context meets every suffix.  A context that holds a site has none.
    """
    over = max(map(len, motifs)) - 1
    pattern = motif_pattern(motifs)
    clean = lambda df, c: df.where(~F.col(c).rlike(pattern))
    ends = contexts.withColumn("_end", F.expr(f"right({word}, {over})"))
    heads = clean(suffixes.select(suffix).distinct(), suffix).groupBy(F.expr(f"left({suffix}, {over})").alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    # At most 4 ** over ends and heads.
    crossing = clean(ends, word).select("_end").distinct().crossJoin(F.broadcast(heads)).where(~F.concat("_end", "_head").rlike(pattern))
    counts = crossing.groupBy("_end").agg(F.sum("_n").alias("_c"))
    found = F.when(F.col(word).rlike(pattern), 0).otherwise(F.coalesce("_c", F.lit(0)))
    return ends.join(counts, "_end", "left").withColumn("completions", found.cast("long")).drop("_end", "_c")


def release_actions(agents: DataFrame, overhang: int) -> DataFrame:
    """(release_id, orientation, overhang, end_kind, excised, fits) of agents (motif, top, bottom) either way round.

    The end is blunt, or one strand hangs over; a site before both cuts is cut off.  It fits an end of ``overhang`` bases
    whose five-prime strand hangs over.
    """
    turned = agents.select(
        "release_id", F.lit("reverse").alias("orientation"), reverse_complement(F.col("motif")).alias("motif"), (F.length("motif") - F.col("bottom")).alias("top"), (F.length("motif") - F.col("top")).alias("bottom")
    )
    both = agents.select("release_id", F.lit("forward").alias("orientation"), "motif", "top", "bottom").unionByName(turned)
    length = F.abs(F.col("bottom") - F.col("top"))
    kind = F.when(length == 0, "blunt").when(F.col("top") < F.col("bottom"), "five_prime").otherwise("three_prime")
    excised = (F.least("top", "bottom") >= F.length("motif")) | (F.greatest("top", "bottom") <= 0)
    return both.select("release_id", "orientation", length.alias("overhang"), kind.alias("end_kind"), excised.alias("excised"), ((length == overhang) & (kind == "five_prime")).alias("fits"))


def compared_routes(left: DataFrame, right: DataFrame, keys: list[str], region: str, value: str) -> DataFrame:
    """(keys, region, left, right, relation) of two routes' regions: same, changed, added or removed; nulls alike."""
    a = left.select(*keys, region, F.col(value).alias("left"), F.lit(True).alias("_a"))
    b = right.select(*keys, region, F.col(value).alias("right"), F.lit(True).alias("_b"))
    relation = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("left").eqNullSafe(F.col("right")), "same").otherwise("changed")
    return a.join(b, [*keys, region], "full").select(*keys, region, "left", "right", relation.alias("relation"))


def bounded_matches(candidates: DataFrame, group: str, key: str, properties: list[str], reference: DataFrame, budget: int) -> DataFrame:
    """(group, examined, match, cursor): the first candidate of each group, in key order, that has its reference's properties.

    ``reference`` (group, properties) has a row a group.  A group that finds none within ``budget`` candidates has the last key looked at
    as the cursor to go on from; one whose candidates end has neither.
    """
    ranked = rank_within(candidates.select(group, key, *properties), key, "_rank", group).where(F.col("_rank") < budget)
    wanted = reference.select(group, *[F.col(p).alias(f"_{p}") for p in properties])
    same = F.lit(True)
    for p in properties:
        same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
    rows = ranked.join(wanted, group).withColumn("_same", same)
    found = rows.groupBy(group).agg(F.min(F.when(F.col("_same"), F.struct("_rank", key))).alias("_m"), F.max(F.struct("_rank", key)).alias("_l"))
    sizes = candidates.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.col("_m").isNotNull()
    return found.join(sizes, group).select(
        group,
        F.when(hit, F.col("_m._rank") + 1).otherwise(F.col("_l._rank") + 1).alias("examined"),
        F.col(f"_m.{key}").alias("match"),
        F.when(~hit & (F.col("_n") > budget), F.col(f"_l.{key}")).alias("cursor"),
    )


def block_digests(rows: DataFrame, key: str, size: int, columns: list[str]) -> DataFrame:
    """(block, first, last, rows, digest) of blocks of ``size`` keys; a row's digest holds its key, so sums tell the order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (key, *columns)]
    blocked = rows.withColumn("block", F.floor(F.col(key) / size))
    return blocked.groupBy("block").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"), F.sha2(F.sum(number_of(*cells)).cast("string"), 256).alias("digest")
    )


def changed_blocks(recorded: DataFrame, again: DataFrame) -> DataFrame:
    """(block, problem): blocks that are missing, extra or changed against a record of ``block_digests``."""
    a = recorded.select("block", F.col("digest").alias("_a"), F.col("rows").alias("_n"))
    b = again.select("block", F.col("digest").alias("_b"), F.col("rows").alias("_m"))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when((F.col("_a") != F.col("_b")) | (F.col("_n") != F.col("_m")), "changed")
    return a.join(b, "block", "full").select("block", problem.alias("problem")).where("problem IS NOT NULL")


def parameter_facts(rows: DataFrame, axes: dict[str, tuple[float, float]]) -> DataFrame:
    """(axis, inside, outside, unassessed, least, greatest): what rows achieved against the requested ranges."""
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("v"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for a, (lo, hi) in axes.items()])
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return rows.select(F.inline(cells)).groupBy("axis").agg(
        F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_if(F.col("v").isNull()).alias("unassessed"), F.min("v").alias("least"), F.max("v").alias("greatest")
    )


def transitions(steps: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """(before, after, times): how often one state follows another along each key's chronology; the first state follows none."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    return steps.select(before.alias("before"), F.col(state).alias("after")).groupBy("before", "after").agg(F.count(F.lit(1)).alias("times"))
