"""Branches and what is decided of them, permissions and their conflicts, site placement and mirroring, catalogue lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dna import reverse_complement
from .arms import motif_class
from .pool import Selections, accepts
from .ranks import rank_within

# What is decided of a branch.
REUSED, EVALUATE, UNEXAMINED = "reused", "evaluate", "unexamined"


def branch_decisions(branches: DataFrame, keys: list[str], targets: DataFrame, options: DataFrame, target: str, budget: int) -> DataFrame:
    """(keys, ordinal, targets, matched, decision): a branch is reused if recorded options match all its targets; of the others
    the first ``budget`` in order are evaluated, the rest are not examined.

    ``branches`` (keys), ``targets`` (keys and a target each), ``options`` (keys and the target that one matches).
    """
    wanted = targets.select(*keys, target).distinct()
    held = options.select(*keys, target).distinct().withColumn("_held", F.lit(1))
    met = wanted.join(held, [*keys, target], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"), F.count("_held").alias("matched"))
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    ordered = rank_within(branches.select(*keys).distinct().withColumn("_key", key), "_key", "ordinal").drop("_key")
    rows = ordered.join(met, keys, "left").fillna(0, ["targets", "matched"])
    done = (F.col("targets") > 0) & (F.col("matched") == F.col("targets"))
    turn = rank_within(rows.where(~done).select("ordinal"), "ordinal", "_turn")
    decision = F.when(done, REUSED).when(F.col("_turn") < budget, EVALUATE).otherwise(UNEXAMINED)
    return rows.join(turn, "ordinal", "left").withColumn("decision", decision).drop("_turn")


def member_conflicts(members: DataFrame, member: str, permitted: DataFrame) -> DataFrame:
    """(member, field, requested, permitted): each requested value outside what its dimension permits.

    ``members`` has the dimensions as its other columns, a null asking for nothing; ``permitted`` (field, value) are the marginal permissions, and a
    dimension without any permits everything.
    """
    fields = [c for c in members.columns if c != member]
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("requested")) for c in fields])
    asked = members.select(member, F.inline(cells)).where("requested IS NOT NULL")
    sizes = permitted.distinct().groupBy("field").agg(F.count(F.lit(1)).alias("permitted"))
    values = permitted.select("field", F.col("value").alias("requested")).distinct()
    return asked.join(values, ["field", "requested"], "left_anti").join(sizes, "field").select(member, "field", "requested", "permitted")


def predicates_permitted(selections: Selections, declared: DataFrame) -> DataFrame:
    """(key, declared, accepted, permitted): a predicate is impossible only if it accepts no value of a domain that is declared.

    ``declared`` (key, value) holds values as text; ranges compare them as numbers.
    """
    tests = F.lit(False)
    for key, selection in selections.items():
        value = F.col("value") if "values" in selection else F.try_to_number("value", F.lit("999999999"))
        tests = F.when(F.col("key") == key, accepts(value, selection)).otherwise(tests)
    counted = declared.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("declared"), F.count_if(tests).alias("accepted"))
    every = declared.sparkSession.createDataFrame([(k,) for k in selections], "key string")
    found = every.join(counted, "key", "left").fillna(0)
    return found.withColumn("permitted", (F.col("declared") == 0) | (F.col("accepted") > 0))


def by_id(requests: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Requests with their catalogue rows; an id that the catalogue lacks, or has twice, is an error."""
    known = catalogue.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    wrong = requests.select(key).distinct().join(known, key, "left").where("n IS NULL OR n > 1").orderBy(key).limit(1).collect()
    if wrong:
        raise KeyError(f"{wrong[0][0]} is {'not' if wrong[0].n is None else 'more than once'} in the catalogue")
    return requests.join(catalogue, key)


def mirrored(sites: DataFrame, size: Column, n_nt: Column) -> DataFrame:
    """Sites (start, orientation, strand, boundary) as they stand on the reverse complement of their source."""
    return sites.withColumns({
        "start": n_nt - F.col("start") - size,
        "boundary": n_nt - F.col("boundary"),
        "strand": F.when(F.col("strand") == "top", "bottom").otherwise("top"),
        "orientation": F.when(F.col("orientation") == "forward", "reverse").otherwise("forward"),
    })


def placed(agents: DataFrame, strand: Column, boundary: Column, n_nt: Column) -> DataFrame:
    """Adds ``orientation``, ``start``, ``stop`` and ``fits``: where an agent (motif, native, cut) must lie to cut a strand at a boundary."""
    forward = F.col("native") == strand
    m = F.length("motif")
    start = boundary - F.when(forward, F.col("cut")).otherwise(m - F.col("cut"))
    rows = agents.withColumn("orientation", F.when(forward, "forward").otherwise("reverse")).withColumn("start", start).withColumn("stop", start + m)
    return rows.withColumn("fits", (F.col("start") >= 0) & (F.col("stop") <= n_nt))


def admitted_words(words: DataFrame, word: str, motifs: list[str], max_checks: int) -> DataFrame:
    """The words without a site of any motif, either way round; more words than ``max_checks`` are an error, never a cut."""
    from .scan import motif_pattern

    if words.limit(max_checks + 1).count() > max_checks:
        raise ValueError(f"more than {max_checks} words to check")
    return words.where(~F.col(word).rlike(motif_pattern(motifs)))


def release_windows(agents: DataFrame, width: int) -> DataFrame:
    """(release_id, orientation, pattern): what the last ``width`` bases of a product must look like for an agent (motif, top, bottom) to cut at its end.

    The top cut lies at the product's end; the motif's symbols before the cut stand in the product, and N where it does not reach.
    """
    forward = agents.select("release_id", F.lit("forward").alias("orientation"), "motif", F.col("top").alias("cut"))
    reverse = agents.select("release_id", F.lit("reverse").alias("orientation"), reverse_complement(F.col("motif")).alias("motif"), (F.length("motif") - F.col("bottom")).alias("cut"))
    both = forward.unionByName(reverse)
    # Place i of the window is place cut - width + i of the motif.
    place = lambda i: F.col("cut") - width + i
    symbols = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when((place(i) >= 0) & (place(i) < F.length("motif")), F.substring(F.col("motif"), place(i) + 1, F.lit(1))).otherwise("N"),
    )
    return both.select("release_id", "orientation", F.array_join(symbols, "").alias("pattern"))


def matching_words(words: DataFrame, word: str, patterns: DataFrame) -> DataFrame:
    """(pattern's columns, word) of every word that a pattern admits; patterns are a catalogue's."""
    return words.join(F.broadcast(patterns), F.rlike(F.col(word), F.concat(F.lit("^"), motif_class(F.col("pattern")), F.lit("$"))))


def material_changes(prior: DataFrame, now: DataFrame, key: str, role: str, material: str) -> DataFrame:
    """(key, changed, reused): roles whose material differs between two preparations, a missing one counting as changed."""
    a = prior.select(key, role, F.col(material).alias("_a"))
    b = now.select(key, role, F.col(material).alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return a.join(b, [key, role], "full").groupBy(key).agg(F.count_if(~same).alias("changed"), F.count_if(same).alias("reused"))


def primer_binding(template: Column, primer: Column) -> Column:
    """Where a primer binds: the template's start, or, turned round, its end; null where neither does or the primer is empty."""
    return F.when(primer == "", None).when(template.startswith(primer), "prefix").when(template.endswith(reverse_complement(primer)), "suffix")
