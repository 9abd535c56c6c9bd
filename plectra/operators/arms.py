"""Foldback arms by tiers of replaced bases, and precursors within a template, as bounded searches.

Arms of a tract are numbered: the exact arm, then those with one replaced base, two, and so on; places in combination order, bases in
order.  A number alone gives its arm, so only the arms within a budget are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dna import BASES, SYMBOLS, masks, reverse_complement
from .enumerate import unrank

MOST_REPLACED = 4
BLOCK = 256
# The codes of an arm's and a precursor's faults.
ARM_CODES = ("FOLD-002", "FOLD-003", "FOLD-004")
DOMAIN_CONFLICT, EXTRA_SITE = "CAND-001", "CAND-002"


def choose(n: Column, k: int) -> Column:
    """How many ways to choose ``k`` of ``n``, for the few that arms ask for."""
    ways = F.lit(1).cast("long")
    for i in range(k):
        ways = F.floor(ways * F.greatest(n - i, F.lit(0)) / (i + 1)).cast("long")
    return ways


def tier_sizes(n: Column, most: int) -> list[Column]:
    return [choose(n, m) * 3**m for m in range(most + 1)]


def arm_count(n: Column, most: int) -> Column:
    """Arms of ``n`` bases with at most ``most`` replaced, without making one."""
    sizes = tier_sizes(n, most)
    return sum(sizes[1:], sizes[0])


def _choose(n: Column, k: Column) -> Column:
    return F.coalesce(*[F.when(k == m, choose(n, m)) for m in range(1, MOST_REPLACED + 1)], F.lit(1).cast("long"))


def combination(n: Column, size: Column, rank: Column) -> Column:
    """The ascending places of the combination at ``rank`` of ``size`` out of ``n`` places, in lexicographic order.

    Place by place: the combinations that begin below a place are counted, and the last place they do not pass is taken.
    """

    def step(state: Column, j: Column) -> Column:
        left, need = n - state["start"], size - j
        bound = F.array(_choose(left, need) - state["rest"])  # an array, to be worked out once
        skipped = F.transform(bound, lambda b: F.size(F.filter(F.sequence(F.lit(1), left), lambda q: _choose(left - q, need) >= b)))
        return F.get(
            F.transform(
                skipped,
                lambda s: F.struct(
                    (state["start"] + s + 1).alias("start"),
                    (state["rest"] - _choose(left, need) + _choose(left - s, need)).alias("rest"),
                    F.array_append(state["places"], state["start"] + s).alias("places"),
                ),
            ),
            F.lit(0),
        )

    start = F.struct(F.lit(0).alias("start"), rank.cast("long").alias("rest"), F.array().cast("array<int>").alias("places"))
    return F.when(size > 0, F.aggregate(F.sequence(F.lit(0), size - 1), start, step)["places"]).otherwise(F.array().cast("array<int>"))


@dataclass(frozen=True)
class ArmLimits:
    """What an arm may look like, and how long to look."""

    replaced: int
    least_terminal: int
    most_run_of_thirds: int
    protected: int
    max_nodes: int
    max_hits: int


def arm_nodes(requests: DataFrame, keys: list[str], tract: str, limits: ArmLimits) -> DataFrame:
    """(keys, tract, space_size, ordinal, places, digits, codes) of the first arms of each tract; ``with_arms`` spells them.

    A replaced base among the first ``protected`` of the tract, a paired run at its start shorter than ``least_terminal``,
    or one anywhere longer than ``most_run_of_thirds`` thirds of the tract has its code.
    """
    n = F.length(tract)
    sizes = tier_sizes(n, limits.replaced)
    offsets, total = [], F.lit(0).cast("long")
    for size in sizes:
        offsets.append(total)
        total = total + size
    last = F.least(total, F.lit(limits.max_nodes)) - 1
    blocks = F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK))
    # Blocks of numbers are dealt out, so that few requests keep many tasks busy.
    dealt = requests.select(*keys, tract, total.alias("space_size"), last.alias("_last"), F.explode(blocks).alias("_block")).repartition(*keys, tract, "_block")
    inside = F.sequence(F.col("_block") * BLOCK, F.least(F.col("_last"), F.col("_block") * BLOCK + BLOCK - 1))
    rows = dealt.withColumn("ordinal", F.explode(inside))
    sizes = tier_sizes(n, limits.replaced)
    offset, tier, total = F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long")
    for m, size in enumerate(sizes):
        inside = F.col("ordinal") >= total
        offset, tier = F.when(inside, total).otherwise(offset), F.when(inside, m).otherwise(tier)
        total = total + size
    rows = rows.withColumn("_tier", tier).withColumn("_rest", F.col("ordinal") - offset)
    power = F.element_at(F.array(*[F.lit(3**m) for m in range(limits.replaced + 1)]), F.col("_tier") + 1)
    rows = rows.withColumn("digits", F.col("_rest") % power).withColumn("places", combination(n, F.col("_tier"), F.floor(F.col("_rest") / power)))
    # Places of the tract face those of the arm backwards.
    faults = F.reverse(F.transform("places", lambda p: n - 1 - p))
    edges = F.concat(F.array(F.lit(-1)), faults, F.array(n))
    runs = F.zip_with(F.slice(edges, 2, F.size(edges)), F.slice(edges, 1, F.size(edges) - 1), lambda b, a: b - a - 1)
    tests = [
        F.exists(faults, lambda p: p < limits.protected),
        F.get(runs, F.lit(0)) < limits.least_terminal,
        F.array_max(runs) * 3 > n * limits.most_run_of_thirds,
    ]
    codes = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(tests, ARM_CODES, strict=True)]))
    return rows.select(*keys, tract, "space_size", "ordinal", "places", "digits", codes.alias("codes"))


def with_arms(nodes: DataFrame, tract: str) -> DataFrame:
    """Adds ``arm``: the reverse complement of the tract with the bases at ``places`` replaced."""
    exact = reverse_complement(F.col(tract))
    powers = F.array(*[F.lit(3**m) for m in range(MOST_REPLACED)])

    def replaced(arm: Column, i: Column) -> Column:
        place = F.get("places", i)
        digit = F.floor(F.col("digits") / F.get(powers, F.size("places") - 1 - i)) % 3
        other = F.substring(F.replace(F.lit(SYMBOLS[:4]), F.substring(exact, place + 1, F.lit(1))), digit.cast("int") + 1, F.lit(1))
        return F.overlay(arm, other, place + 1, F.lit(1))

    spelled = F.aggregate(F.sequence(F.lit(0), F.size("places") - 1), exact, replaced)
    return nodes.withColumn("arm", F.when(F.size("places") == 0, exact).otherwise(spelled))


def motif_class(motif: Column) -> Column:
    """A motif column as a regular expression of base classes."""
    classes = F.array(*[F.lit(f"[{BASES[s]}]") for s in SYMBOLS])
    return F.array_join(F.transform(F.split(motif, ""), lambda s: F.get(classes, F.instr(F.lit(SYMBOLS), s) - 1)), "")


def site_count(sequence: Column, motif: Column) -> Column:
    """Places of a motif on both strands, overlaps included; one that is its own reverse complement counts once a place."""
    seen = lambda m: F.regexp_count(sequence, F.concat(F.lit("(?=(?:"), motif_class(m), F.lit("))")))
    turned = reverse_complement(motif)
    return seen(motif) + F.when(turned == motif, 0).otherwise(seen(turned))


def precursor_nodes(requests: DataFrame, keys: list[str], max_nodes: int) -> DataFrame:
    """(keys, space_size, ordinal, precursor, designed, codes) of requests (template, motif, start, tract).

    The motif is laid on the template at ``start``; a base set left empty is a domain conflict, told in one row without an
    ordinal.  Words follow in order of rank.  The designed sequence adds the arm that folds back on the last ``tract`` bases;
    one with any site beyond the intended one is rejected.
    """
    laid = masks(F.col("motif"))
    own = masks(F.col("template"))
    met = F.transform(own, lambda m, i: F.when((i >= F.col("start")) & (i < F.col("start") + F.length("motif")), m.bitwiseAND(F.coalesce(F.get("_motif", i - F.col("start")), F.lit(15)))).otherwise(m))
    size = F.aggregate("_domains", F.lit(1).cast("decimal(38,0)"), lambda n, m: F.least(n * F.bit_count(m), F.lit(10**18)).cast("decimal(38,0)"))
    rows = requests.withColumn("_motif", laid).withColumn("_domains", met).withColumn("space_size", size.cast("long"))
    last = F.least(F.col("space_size"), F.lit(max_nodes)).cast("long") - 1
    rows = rows.withColumn("ordinal", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))))
    word = F.when(F.col("ordinal").isNotNull(), unrank(F.col("_domains"), F.col("ordinal")))
    rows = rows.withColumn("precursor", word)
    n = F.length("precursor")
    rows = rows.withColumn("designed", F.concat("precursor", reverse_complement(F.substring(F.col("precursor"), n - F.col("tract") + 1, F.col("tract").cast("int")))))
    extra = site_count(F.col("designed"), F.col("motif")) > 1
    codes = F.array_compact(F.array(F.when(F.col("ordinal").isNull(), F.lit(DOMAIN_CONFLICT)).when(extra, F.lit(EXTRA_SITE))))
    return rows.select(*keys, "space_size", "ordinal", "precursor", "designed", codes.alias("codes"))


def precursor_search(nodes: DataFrame, keys: list[str], max_nodes: int, max_hits: int) -> DataFrame:
    """(keys, space_size, examined, observed, returned, rejected, status, truncated_by): nodes are cut before hits are ordered, and both may cut."""
    found = nodes.groupBy(*keys).agg(
        F.max("space_size").alias("space_size"),
        F.count("ordinal").alias("examined"),
        F.count_if(F.size("codes") == 0).alias("observed"),
        F.count_if(F.array_contains("codes", EXTRA_SITE)).alias("extra_site"),
        F.count_if(F.array_contains("codes", DOMAIN_CONFLICT)).alias("domain_conflict"),
    )
    by_nodes, by_hits = F.col("examined") < F.col("space_size"), F.col("observed") > max_hits
    cut = F.array_join(F.array_compact(F.array(F.when(by_nodes, F.lit("max_search_nodes")), F.when(by_hits, F.lit("max_hits")))), ",")
    status = F.when(by_nodes | by_hits, "truncated").when(F.col("observed") > 0, "complete").otherwise("infeasible")
    return found.withColumns({"returned": F.least("observed", F.lit(max_hits)).cast("long"), "status": status, "truncated_by": cut})
