"""Queries over a pool of options: facets, reasons, groups, preservation, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import number_of

Selections = dict[str, dict]


def accepts(column: str | Column, selection: dict) -> Column:
    """Membership in ``values``, or an inclusive range; a null is not accepted."""
    c = F.col(column) if isinstance(column, str) else column
    test = c.isin(*selection["values"]) if "values" in selection else c.between(selection["low"], selection["high"])
    return F.coalesce(test, F.lit(False))


def failed(selections: Selections) -> Column:
    """Keys whose predicate a row fails."""
    return F.array_compact(F.array(*[F.when(~accepts(k, s), F.lit(k)) for k, s in selections.items()]))


def reasons(selections: Selections) -> Column:
    """``key:unassessed`` or ``key:different`` of each failing predicate."""
    said = [
        F.when(F.col(k).isNull(), F.lit(f"{k}:unassessed")).when(~accepts(k, s), F.lit(f"{k}:different"))
        for k, s in selections.items()
    ]
    return F.array_compact(F.array(*said))


def facets(pool: DataFrame, axes: list[str], selections: Selections, preparation: str, eligible: Column | None = None) -> DataFrame:
    """Records and distinct preparations by axis value: all, and those that pass the other axes' predicates.

    One pass: a row counts for an axis if it fails nothing, or that axis alone.  ``eligible`` keeps a row out of the
    conditional counts without taking it from the recorded ones.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    kept = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    rows = pool.select(F.col(preparation).alias("prep"), failed(selections).alias("failed"), kept.alias("kept"), F.inline(cells))
    open_ = F.col("kept") & ((F.size("failed") == 0) | ((F.size("failed") == 1) & (F.col("failed")[0] == F.col("axis"))))
    return rows.groupBy("axis", "value").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("prep").alias("preparations"),
        F.sum(open_.cast("long")).alias("conditional_records"),
        F.countDistinct(F.when(open_, F.col("prep"))).alias("conditional_preparations"),
    )


def pin_reasons(pins: dict[str, list], focus: str | None = None) -> Column:
    """``region:unassessed`` or ``region:different`` of each pinned region whose variant is not an allowed one; the
    region in focus may be left out, so that its alternatives stay open."""
    said = [
        F.when(F.col(region).isNull(), F.lit(f"{region}:unassessed")).when(~F.col(region).isin(*allowed), F.lit(f"{region}:different"))
        for region, allowed in pins.items()
        if region != focus
    ]
    return F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")


def refine(pool: DataFrame, axes: list[str], selections: Selections, preparation: str, reference: DataFrame, preserve: list[str]) -> DataFrame:
    """Facets again, where only options that keep the reference's surroundings are witnesses.

    ``reference`` is one row; a property that either side lacks is not preserved.  A value with records and no witness is
    supported elsewhere.
    """
    own = reference.select(*[F.col(p).alias(f"_ref_{p}") for p in preserve]).limit(1)
    same = F.forall(F.array(*[F.coalesce(F.col(p) == F.col(f"_ref_{p}"), F.lit(False)) for p in preserve]), lambda x: x)
    counted = facets(pool.crossJoin(F.broadcast(own)), axes, selections, preparation, same)  # one reference row
    state = F.when(F.col("conditional_records") > 0, "supported").when(F.col("preparations") > 0, "supported_elsewhere").otherwise("unresolved")
    return counted.withColumn("state", state)


def domain_states(found: DataFrame, declared: DataFrame, complete: bool) -> DataFrame:
    """Declared values are kept: supported, supported elsewhere, or unresolved (excluded only by a complete search)."""
    state = (
        F.when(F.col("conditional_records") > 0, "supported")
        .when(F.col("records") > 0, "supported_elsewhere")
        .otherwise("excluded_in_scope" if complete else "unresolved")
    )
    return declared.join(found, ["axis", "value"], "left").select("axis", "value", state.alias("state"))


def distributions(pool: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """Histogram of each integer key: recorded, eligible, and the key's totals and missing rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("value")) for k in keys])
    rows = pool.select(eligible.alias("ok"), F.inline(cells))
    counts = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("recorded"), F.sum(F.col("ok").cast("long")).alias("eligible"))
    whole = Window.partitionBy("key")
    return (
        counts.withColumn("missing", F.sum(F.when(F.col("value").isNull(), F.col("recorded")).otherwise(0)).over(whole))
        .withColumn("of_recorded", F.sum("recorded").over(whole))
        .withColumn("of_eligible", F.sum("eligible").over(whole))
        .where(F.col("value").isNotNull())
    )


def families(pool: DataFrame, product: str, features: list[str]) -> DataFrame:
    """Products by their set of features; products with equal sets are one family, named by the set's digest."""
    cell = F.concat_ws("|", *[F.col(f).cast("string") for f in features])
    products = pool.groupBy(product).agg(F.array_join(F.array_sort(F.collect_set(cell)), ";").alias("features"), F.count(F.lit(1)).alias("records"))
    return products.groupBy(F.sha2("features", 256).alias("family_id")).agg(
        F.count(F.lit(1)).alias("products"), F.sum("records").alias("records"), F.min(product).alias("first_product")
    )


def feature_families(pool: DataFrame, product: str, features: list[str]) -> DataFrame:
    """Products by the multiset of their features: how often a feature occurs counts as well.

    Features are counted and their counts summed as digests, so a product with many options needs no list.
    """
    counts = pool.groupBy(product, *features).agg(F.count(F.lit(1)).alias("_n"))
    cell = number_of(*[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in features], F.col("_n"))
    products = counts.groupBy(product).agg(F.sum(cell).alias("_sum"), F.count(F.lit(1)).alias("features"), F.sum("_n").alias("records"))
    named = products.withColumn("family_id", F.sha2(F.concat_ws("|", F.col("features").cast("string"), F.col("_sum").cast("string")), 256))
    return named.groupBy("family_id").agg(F.count(F.lit(1)).alias("products"), F.sum("records").alias("records"), F.min(product).alias("first_product"))


def option_sets(pool: DataFrame, shared: list[str], slot: str, required: list[str]) -> DataFrame:
    """Groups of equal shared properties: members, and the required slots none of them fills."""
    want = F.array(*[F.lit(r) for r in sorted(required)])
    grouped = pool.groupBy(*shared).agg(F.count(F.lit(1)).alias("members"), F.collect_set(slot).alias("present"))
    missing = F.array_join(F.array_except(want, "present"), ",")
    return grouped.select(*shared, "members", missing.alias("missing"), (F.size(F.array_except(want, "present")) == 0).alias("whole"))


def surroundings(pool: DataFrame, key: str, reference: DataFrame, regions: list[str], free: str) -> DataFrame:
    """Regions other than ``free`` that differ from the one reference row, nulls alike."""
    ref = reference.select(*[F.col(r).alias(f"ref_{r}") for r in regions])
    differs = [F.when(~F.col(r).eqNullSafe(F.col(f"ref_{r}")), F.lit(r)) for r in regions if r != free]
    joined = pool.crossJoin(F.broadcast(ref))  # one row
    return joined.select(key, F.array_join(F.array_compact(F.array(*differs)), ",").alias("changed"))


def hash_rank(seed: str, key: Column) -> Column:
    """A repeatable order that looks random."""
    return F.sha2(F.concat(F.lit(seed), F.lit(":"), key.cast("string")), 256)


def hash_sample(pool: DataFrame, key: str, seed: str, groups: list[str]) -> DataFrame:
    """The row of the least hash in each group."""
    rank = hash_rank(seed, F.col(key))
    return pool.groupBy(*groups).agg(F.min_by(F.col(key), F.struct(rank, F.col(key))).alias(key))


def guided_choice(pool: DataFrame, key: str, family: str, product: str, seen: DataFrame, seed: str) -> DataFrame:
    """The next option: of an unvisited family, else an unvisited product, else a product other than the last one seen, else any;
    then by hash.  The last one seen has the greatest key."""
    families_, products = seen.select(F.col(family)).distinct(), seen.select(F.col(product)).distinct()
    last = seen.agg(F.max_by(F.col(product), F.col(key)).alias("_last"))  # one row
    marked = pool.join(families_.withColumn("_f", F.lit(1)), family, "left").join(products.withColumn("_p", F.lit(1)), product, "left").crossJoin(F.broadcast(last))
    tier = F.when(F.col("_f").isNull(), 0).when(F.col("_p").isNull(), 1).when(~F.col(product).eqNullSafe(F.col("_last")), 2).otherwise(3)
    ranked = marked.select(key, tier.alias("tier"), hash_rank(seed, F.col(key)).alias("rank"))
    return ranked.orderBy("tier", "rank").limit(1).select(key, "tier")


def matching(pool: DataFrame, key: str, selections: Selections, members: DataFrame | None = None) -> DataFrame:
    """The options that pass all selections and, if ``members`` (the key) are named, are among them."""
    passing = pool.where(F.size(failed(selections)) == 0)
    return passing if members is None else passing.join(members.select(key).distinct(), key, "left_semi")


def stratified_rank(df: DataFrame, classes: list[str], order: list[Column]) -> DataFrame:
    """Rank within a class: sorted by it, every class gives its best before any gives its second."""
    return df.withColumn("stratum", F.row_number().over(Window.partitionBy(*classes).orderBy(*order)) - 1)


def canonical_members(df: DataFrame, digest: Column, ordinal: str) -> DataFrame:
    """Each row's first row of the same digest."""
    first = F.min(ordinal).over(Window.partitionBy("digest"))
    return df.withColumn("digest", digest).withColumn("canonical", first).withColumn("duplicate", F.col("canonical") != F.col(ordinal))


def dedupe(df: DataFrame, seq: str, ordinal: str) -> DataFrame:
    """One row a sequence: the first, and how many there were.  Partial minima keep hot sequences small."""
    return df.groupBy(seq).agg(F.min(ordinal).alias(ordinal), F.count(F.lit(1)).alias("copies"))


def excluded_values(steps: DataFrame, value: str, partner: str, partners: int) -> DataFrame:
    """Values proven empty with every partner: exhausted and never supported (relational division)."""
    cells = steps.groupBy(value, partner).agg(F.max("exhausted").alias("exhausted"), F.sum("witness").alias("witness"))
    closed = (F.col("exhausted") == 1) & (F.col("witness") == 0)
    return cells.groupBy(value).agg(F.sum(closed.cast("long")).alias("closed")).select(value, "closed", (F.col("closed") == partners).alias("excluded"))


def changed_keys(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs, missing on a side counting as a difference."""
    a = before.select(F.col(key), F.col(value).alias("before"))
    b = after.select(F.col(key), F.col(value).alias("after"))
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def interface_status(lefts: DataFrame, rights: DataFrame, ended: DataFrame, excluded: DataFrame) -> DataFrame:
    """(query, targets, excluded, pending) of queries that permit (query, left) and (query, right) values.

    A query is excluded if every target it permits is among the ``excluded`` (left, right) pairs, and pending while one is not
    among the ``ended``.  One that permits no target is neither.  Targets are counted from the sides; only recorded pairs are joined.
    """
    lefts, rights = lefts.distinct(), rights.distinct()
    sides = lefts.groupBy("query").agg(F.count(F.lit(1)).alias("n_left")).join(
        rights.groupBy("query").agg(F.count(F.lit(1)).alias("n_right")), "query", "full"
    )
    recorded = ended.select("left", "right", F.lit(1).alias("ended"), F.lit(0).alias("excluded")).unionByName(
        excluded.select("left", "right", F.lit(0).alias("ended"), F.lit(1).alias("excluded"))
    )
    pairs = recorded.groupBy("left", "right").agg(F.max("ended").alias("ended"), F.max("excluded").alias("excluded"))
    held = pairs.join(lefts, "left").join(rights, ["query", "right"]).groupBy("query")
    counts = held.agg(F.sum("ended").alias("n_ended"), F.sum("excluded").alias("n_excluded"))
    targets = (F.coalesce("n_left", F.lit(0)) * F.coalesce("n_right", F.lit(0))).alias("targets")
    found = sides.join(counts, "query", "left").select(
        "query", targets, F.coalesce("n_ended", F.lit(0)).alias("n_ended"), F.coalesce("n_excluded", F.lit(0)).alias("n_excluded")
    )
    full = (F.col("targets") > 0) & (F.col("n_excluded") == F.col("targets"))
    return found.select("query", "targets", full.alias("excluded"), (F.col("n_ended") < F.col("targets")).alias("pending"))


def survey_coverage(targets: DataFrame, steps: DataFrame) -> DataFrame:
    """One row over the declared ``targets`` (ordinal, left_word, right_word): support beats exclusion, and supported, excluded
    and unresolved add up to all of them.  Steps of targets that were not declared are counted apart."""
    known = steps.groupBy("ordinal").agg(F.sum("witness").alias("w"), F.max("exhausted").alias("e"))
    joined = targets.withColumn("_declared", F.lit(True)).join(known, "ordinal", "full")
    declared = F.coalesce("_declared", F.lit(False))
    seen = F.col("e").isNotNull()
    supported = declared & (F.coalesce("w", F.lit(0)) > 0)
    excluded = declared & ~supported & (F.coalesce("e", F.lit(0)) == 1)
    return joined.agg(
        F.count_if(declared).alias("targets"),
        F.count_if(declared & seen).alias("examined"),
        F.count_if(supported).alias("supported"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(declared & ~supported & ~excluded).alias("unresolved"),
        F.count_if(declared & ~seen).alias("unexamined"),
        F.countDistinct(F.when(supported, F.col("left_word"))).alias("left_words"),
        F.countDistinct(F.when(supported, F.col("right_word"))).alias("right_words"),
        F.count_if(~declared).alias("undeclared"),
    )


def parameter_page(pool: DataFrame, key: str, declared: DataFrame, selections: Selections, page_size: int) -> DataFrame:
    """(value, page, status, matching, complete, blocked_by): each declared value against the options that have it.

    ``declared`` (value, rank).  A value is supported if an option passes all other selections, blocked by them if there are options
    but none passes, and else has none recorded, which proves nothing.  ``blocked_by`` are the keys that rule options out.
    """
    others = {k: s for k, s in selections.items() if k != key}
    rows = pool.select(F.col(key).alias("value"), failed(others).alias("_failed"))
    blocked = [F.when(F.count_if(F.array_contains("_failed", k)) > 0, F.lit(k)) for k in sorted(others)]
    found = rows.groupBy("value").agg(F.count_if(F.size("_failed") == 0).alias("matching"), F.count(F.lit(1)).alias("complete"), F.concat_ws(",", *blocked).alias("blocked_by"))
    status = F.when(F.col("matching") > 0, "supported").when(F.col("complete") > 0, "blocked_by_selections").otherwise("no_complete_preparation_recorded")
    joined = declared.join(found, "value", "left").fillna(0, ["matching", "complete"]).fillna("", ["blocked_by"])
    return joined.select("value", F.floor(F.col("rank") / page_size).alias("page"), status.alias("status"), "matching", "complete", "blocked_by")


def choice_axes(pool: DataFrame, axes: list[str], selections: Selections, declared: DataFrame) -> DataFrame:
    """(axis, observed, offered, varying, observed_variation, fixed_by_request, domain_status) over the options that pass.

    ``declared`` (axis, value) are the values a request permits; those and the observed ones are offered.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    passing = pool.where(F.size(failed(selections)) == 0).select(F.inline(cells)).where("value IS NOT NULL").distinct().withColumn("o", F.lit(1))
    both = passing.join(declared.distinct().withColumn("d", F.lit(1)), ["axis", "value"], "full").groupBy("axis")
    found = both.agg(F.count("o").alias("observed"), F.count(F.lit(1)).alias("offered"), F.count("d").alias("n_declared"))
    every = pool.sparkSession.createDataFrame([(a,) for a in axes], "axis string").join(found, "axis", "left").fillna(0)
    return every.select(
        "axis", "observed", "offered", (F.col("offered") > 1).alias("varying"), (F.col("observed") > 1).alias("observed_variation"),
        (F.col("n_declared") == 1).alias("fixed_by_request"), F.when(F.col("n_declared") > 0, "declared").otherwise("observed_only").alias("domain_status"),
    )


def overhead_matrix(rows_searched: DataFrame, columns: DataFrame, found: DataFrame, row: str, column: str, cost: str, key: str) -> DataFrame:
    """(row, column, least, rows, first_id, status) of the grid of two catalogues; ``rows_searched`` (row, whole) tells whether a
    row's search was complete, so that a missing cell is infeasible, or was cut, so that it is unknown."""
    best = found.groupBy(row, column).agg(F.min(cost).alias("least"), F.count(F.lit(1)).alias("rows"), F.min_by(key, F.struct(cost, key)).alias("first_id"))
    grid = rows_searched.crossJoin(columns)  # two catalogues; Spark broadcasts one below its own threshold
    state = F.when(F.col("rows").isNotNull(), "found").when(F.col("whole"), "infeasible").otherwise("unknown")
    return grid.join(best, [row, column], "left").select(row, column, "least", F.coalesce("rows", F.lit(0)).alias("rows"), "first_id", state.alias("status"))


def query_groups(pool: DataFrame, product: str, key: str, selections: Selections, focus: str) -> DataFrame:
    """(product, eligible, excluded, first_option, focus_variants): a query's options by product; the variants of the region in
    focus are those of options that pass all other selections."""
    rows = pool.select(F.col(product).alias("product"), key, focus, failed(selections).alias("_failed"))
    ok = F.size("_failed") == 0
    open_ = ok | ((F.size("_failed") == 1) & (F.get("_failed", F.lit(0)) == focus))
    variants = F.array_join(F.array_sort(F.collect_set(F.when(open_, F.col(focus)))), ",")  # a region's vocabulary
    return rows.groupBy("product").agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"), F.min(F.when(ok, F.col(key))).alias("first_option"), variants.alias("focus_variants"))
