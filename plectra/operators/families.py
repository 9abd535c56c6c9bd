"""Families of members: rosters, revisions and matching; edited declarations; measures, boundaries and regions located by ancestry; chosen routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import rank_within, running_total

# Faults of a revision.
UNKNOWN_SOURCE, ROSTER, TARGET_EXISTS, CHANGED_REQUEST, UNCHANGED_EDIT = "unknown_source", "roster_not_kept", "target_exists", "changed_request", "unchanged_edit"


def expanded(roster: DataFrame, base: DataFrame, family: str, member: str) -> DataFrame:
    """Members of a roster with every dimension that they leave null taken from their family's base, and how many they ``set`` themselves.

    ``base`` has a row a family; its other columns are the dimensions.
    """
    dims = [c for c in base.columns if c != family]
    own = F.lit(0)
    for d in dims:
        own = own + F.col(d).isNotNull().cast("int")
    inherited = base.select(family, *[F.col(d).alias(f"_{d}") for d in dims])
    return roster.withColumn("set", own).join(inherited, family).select(family, member, *[F.coalesce(d, f"_{d}").alias(d) for d in dims], "set")


def with_outcomes(requests: DataFrame, outcomes: DataFrame, on: list[str], outcome: str) -> DataFrame:
    """Requests with how many outcomes meet them, the least one, and a status; a request without any stays, as ``missing``."""
    told = outcomes.groupBy(*on).agg(F.count(F.lit(1)).alias("outcomes"), F.min(outcome).alias("first"))
    rows = requests.join(told, on, "left").fillna(0, ["outcomes"])
    return rows.withColumn("status", F.when(F.col("outcomes") > 0, "found").otherwise("missing"))


def family_coverage(candidates: DataFrame, member: str, key: str, reference: str, properties: list[str], controls: DataFrame, budget: int) -> DataFrame:
    """(member, recorded, evaluated, unexamined, same, first_same, differences) of every member but the reference, of all under one budget.

    Members take from the budget in order of their names: each evaluates as many of its candidates, in key order, as those before it
    leave.  A candidate is the ``same`` if it has all the control's properties (one row), nulls alike; ``differences`` counts the properties
    in which evaluated candidates differ.
    """
    others = candidates.where(F.col(member) != reference)
    sizes = others.groupBy(member).agg(F.count(F.lit(1)).alias("recorded"))
    spent = running_total(sizes, member, "recorded", "_before")
    quota = spent.withColumn("evaluated", F.greatest(F.lit(0), F.least("recorded", budget - F.col("_before"))).cast("long")).drop("_before")
    ranked = rank_within(others.select(member, key, *properties), key, "_rank", member)
    wanted = controls.select(*[F.col(p).alias(f"_{p}") for p in properties])
    looked = ranked.join(quota.select(member, "evaluated"), member).where(F.col("_rank") < F.col("evaluated")).crossJoin(F.broadcast(wanted))  # one row
    differ = F.lit(0)
    for p in properties:
        differ = differ + (~F.col(p).eqNullSafe(F.col(f"_{p}"))).cast("int")
    facts = looked.withColumn("_differ", differ).groupBy(member).agg(
        F.count_if(F.col("_differ") == 0).alias("same"), F.min(F.when(F.col("_differ") == 0, F.col(key))).alias("first_same"), F.sum("_differ").alias("differences")
    )
    rows = quota.join(facts, member, "left").fillna(0, ["same", "differences"])
    return rows.select(member, "recorded", "evaluated", (F.col("recorded") - F.col("evaluated")).alias("unexamined"), "same", "first_same", "differences")


def revisions(before: DataFrame, after: DataFrame, asked: DataFrame, family: str, member: str, request: str) -> DataFrame:
    """(family, kind, kept, faults) of each revision of a family's roster.

    ``before`` and ``after`` (family, member, request) are rosters, ``asked`` (family, source, target) has a row a family.  A revision whose
    target is its source is a continuation, any other an edit.  It must know its source, keep all members with their requests and add none but
    the target; an edit's target is new, and asks for something other than the source did.  Faults are listed in this order of checks.
    """
    a = before.select(family, member, F.col(request).alias("_a"), F.lit(True).alias("_old"))
    b = after.select(family, member, F.col(request).alias("_b"), F.lit(True).alias("_new"))
    both = a.join(b, [family, member], "full").join(asked, family)
    is_source, is_target = F.col(member) == F.col("source"), F.col(member) == F.col("target")
    old, new, same = F.col("_old").isNotNull(), F.col("_new").isNotNull(), F.col("_a").eqNullSafe(F.col("_b"))
    facts = both.groupBy(family, "source", "target").agg(
        F.count_if(old & new & same).alias("kept"),
        F.count_if(is_source & old).alias("_source"),
        F.count_if((old & ~new) | (new & ~old & ~is_target)).alias("_strays"),
        F.count_if(is_target & new).alias("_target"),
        F.count_if(is_target & old).alias("_taken"),
        F.count_if(old & new & ~same).alias("_changed"),
        F.max(F.when(is_source, F.struct(F.col("_a").alias("r")))).alias("_was"),
        F.max(F.when(is_target, F.struct(F.col("_b").alias("r")))).alias("_asks"),
    )
    rows = asked.join(facts, [family, "source", "target"], "left").fillna(0)
    edit = F.col("source") != F.col("target")
    told = [
        (F.col("_source") == 0, UNKNOWN_SOURCE),
        ((F.col("_strays") > 0) | (F.col("_target") == 0), ROSTER),
        (edit & (F.col("_taken") > 0), TARGET_EXISTS),
        (F.col("_changed") > 0, CHANGED_REQUEST),
        (edit & (F.col("_source") > 0) & (F.col("_target") > 0) & F.col("_was.r").eqNullSafe(F.col("_asks.r")), UNCHANGED_EDIT),
    ]
    faults = F.concat_ws(",", *[F.when(test, name) for test, name in told])
    return rows.select(family, F.when(edit, "edit").otherwise("continuation").alias("kind"), "kept", faults.alias("faults"))


def narrowed(permitted: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least, greatest, provenance, conflict): ranges that are both permitted and asked for.

    Either side may be silent: then the other holds.  An empty range is a conflict, and has no bounds.
    """
    a = permitted.select(*keys, F.col("least").alias("_a"), F.col("greatest").alias("_z"), F.lit(True).alias("_context"))
    b = asked.select(*keys, F.col("least").alias("_b"), F.col("greatest").alias("_y"), F.lit(True).alias("_user"))
    lo, hi = F.greatest("_a", "_b"), F.least("_z", "_y")  # a null side does not count
    empty = F.coalesce(lo > hi, F.lit(False))
    source = F.when(F.col("_user").isNull(), "context").otherwise("user_within_context")
    return a.join(b, keys, "full").select(*keys, F.when(~empty, lo).alias("least"), F.when(~empty, hi).alias("greatest"), source.alias("provenance"), empty.alias("conflict"))


def edited_declarations(declared: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, before, after, outcome) of each edit: ``changed``, ``same``, ``not_declared`` or ``choose_one``.

    ``declared`` (keys, path, kind, values) is what stands, ``edits`` (keys, path, values) what is to stand; values are arrays.  A path of the kind
    ``choice`` takes one value, a ``list`` any.  A failed edit leaves what stood.
    """
    asked = edits.select(*keys, "path", F.array_sort(F.array_distinct("values")).alias("_asked"))
    both = asked.join(declared, [*keys, "path"], "left")
    stood = F.array_sort(F.array_distinct("values"))
    outcome = (
        F.when(F.col("kind").isNull(), "not_declared")
        .when((F.col("kind") == "choice") & (F.size("_asked") != 1), "choose_one")
        .when(stood == F.col("_asked"), "same")
        .otherwise("changed")
    )
    after = F.when(outcome == "changed", F.col("_asked")).otherwise(stood)
    text = lambda c: F.array_join(c, ",")
    return both.select(*keys, "path", text(stood).alias("before"), text(after).alias("after"), outcome.alias("outcome"))


def resolved_methods(requests: DataFrame, catalogue: DataFrame, barred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, method_id, outcome) of requested names: ``resolved``, ``unknown``, ``ambiguous`` (two ids of a name) or ``barred``.

    ``requests`` (keys, name), ``catalogue`` (name, method_id), ``barred`` (keys, method_id).
    """
    known = catalogue.groupBy("name").agg(F.countDistinct("method_id").alias("_ids"), F.min("method_id").alias("_id"))
    prohibited = barred.select(*keys, F.col("method_id").alias("_id"), F.lit(True).alias("_barred")).distinct()
    rows = requests.select(*keys, "name").distinct().join(known, "name", "left").join(prohibited, [*keys, "_id"], "left")
    outcome = F.when(F.col("_ids").isNull(), "unknown").when(F.col("_ids") > 1, "ambiguous").when(F.col("_barred"), "barred").otherwise("resolved")
    return rows.select(*keys, "name", F.when(outcome == "resolved", F.col("_id")).alias("method_id"), outcome.alias("outcome"))


def measure_occurrences(measures: DataFrame, references: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, state, places, first, last) of the bases of each state that share an origin with a measure's own places.

    ``measures`` (keys, measure) are all measures, ``references`` (keys, measure, state, index) their places, ``bases`` (keys, state, index, origin)
    every state.  A measure of no extent has one row, without a state.
    """
    origins = references.join(bases, [*keys, "state", "index"]).select(*keys, "measure", "origin").distinct()
    found = origins.join(bases, [*keys, "origin"]).groupBy(*keys, "measure", "state").agg(F.count(F.lit(1)).alias("places"), F.min("index").alias("first"), F.max("index").alias("last"))
    return measures.select(*keys, "measure").distinct().join(found, [*keys, "measure"], "left").fillna(0, ["places"])


def boundary_occurrences(anchors: DataFrame, cuts: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anchor, state, boundary, direction): where the two origins beside an anchor stand side by side, in their order (1) or turned round (-1).

    ``anchors`` (keys, anchor, before, after) and ``cuts`` (keys, before, after) name origins.  An anchor at a state's end has one side;
    it takes the other from the cuts, if all that share its side agree.
    """
    pairs = cuts.where("before IS NOT NULL AND after IS NOT NULL").select(*keys, "before", "after").distinct()

    def completed(side: str, other: str) -> DataFrame:
        single = pairs.groupBy(*keys, side).agg(F.count(F.lit(1)).alias("_n"), F.min(other).alias("_other")).where("_n = 1")
        open_ = anchors.where(F.col(side).isNotNull() & F.col(other).isNull()).select(*keys, "anchor", side)
        return open_.join(single, [*keys, side]).select(*keys, "anchor", *[F.col(side if c == side else "_other").alias(c) for c in ("before", "after")])

    whole = anchors.where("before IS NOT NULL AND after IS NOT NULL").select(*keys, "anchor", "before", "after")
    whole = whole.unionByName(completed("before", "after")).unionByName(completed("after", "before")).distinct()
    left = bases.select(*keys, "state", (F.col("index") + 1).alias("boundary"), F.col("origin").alias("_l"))
    right = bases.select(*keys, "state", F.col("index").alias("boundary"), F.col("origin").alias("_r"))
    beside = left.join(right, [*keys, "state", "boundary"])
    here = lambda l, r, d: beside.select(*keys, "state", "boundary", F.col(l).alias("before"), F.col(r).alias("after"), F.lit(d).alias("direction"))
    return whole.join(here("_l", "_r", 1).unionByName(here("_r", "_l", -1)), [*keys, "before", "after"]).select(*keys, "anchor", "state", "boundary", "direction")


def product_stages(portrait: DataFrame, strands: DataFrame, pairings: DataFrame, key: str) -> DataFrame:
    """(key, strand, index, column, region, reason) of a product's bases, in the frame of its pairs, with the region of the portrait they come from.

    ``portrait`` (key, origin, region), ``strands`` (key, strand, index, origin) with strands 0 and 1, ``pairings`` (key, top, bottom).  A base whose origin
    is in no region, or in several, is ``unmapped``.  A product without pairs, or whose pairs have no single antiparallel frame, has one row with the reason.
    """
    regions = portrait.groupBy(key, "origin").agg(F.countDistinct("region").alias("_n"), F.min("region").alias("_region"))
    frame = pairings.groupBy(key).agg(F.min(F.col("top") + F.col("bottom")).alias("_low"), F.max(F.col("top") + F.col("bottom")).alias("_high"))
    products = strands.select(key).distinct().join(frame, key, "left")
    reason = F.when(F.col("_low").isNull(), "no_paired_duplex").when(F.col("_low") != F.col("_high"), "no_single_frame")
    told = products.withColumn("reason", reason)
    rows = strands.join(told.where("reason IS NULL").select(key, F.col("_low").alias("_sum")), key).join(regions, [key, "origin"], "left")
    column: Column = F.when(F.col("strand") == 0, F.col("index")).otherwise(F.col("_sum") - F.col("index"))
    region = F.when(F.col("_n") == 1, F.col("_region")).otherwise("unmapped")
    placed = rows.select(key, "strand", "index", column.alias("column"), region.alias("region"), F.lit(None).cast("string").alias("reason"))
    return placed.unionByName(told.where("reason IS NOT NULL").select(key, "reason"), allowMissingColumns=True)


def chosen_routes(chosen: DataFrame, dispositions: DataFrame, steps: DataFrame, route: str, step: str, accepted: list[str]) -> DataFrame:
    """Chosen routes with an ``outcome`` and their steps, in order from 0: only an accepted route has any.

    ``dispositions`` (route, status) has a row a route.  A rejected or unknown route has one row without a step.
    """
    status = dispositions.select(route, F.col("status").alias("_status"))
    told = chosen.join(status, route, "left")
    outcome = F.when(F.col("_status").isNull(), "unknown").when(F.col("_status").isin(*accepted), "accepted").otherwise("rejected")
    told = told.withColumn("outcome", outcome).drop("_status")
    ordered = rank_within(steps, step, "place", route)
    known = told.where("outcome = 'accepted'").join(ordered, route, "left")
    return known.unionByName(told.where("outcome <> 'accepted'"), allowMissingColumns=True)
