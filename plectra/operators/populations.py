"""Populations of paired words under one mismatch budget, without making their members.

A member is a source word within base sets and an adapter that faces it; a matching pair costs nothing, a G and a T cost one,
and the costs stay within the budget.  Counts of completions by position and remaining budget give the size, the member at a
rank and the rank of a member.  Members are in order of their source, then of their adapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .arms import choose

BASES = "ACGT"
WOBBLING = 12  # G and T
#: The partner that matches a base, and the one that wobbles with it.
MATCH = {"A": "T", "C": "G", "G": "C", "T": "A"}
WOBBLE = {"G": "T", "T": "G"}


def completions(domains: Column, budget: int) -> Column:
    """Rows for positions 0 to n: the completions from there with a cost of at most 0, 1, ... ``budget``."""
    end = F.array(*[F.lit(1).cast("long")] * (budget + 1))

    def step(rows: Column, mask: Column) -> Column:
        after = F.get(rows, F.lit(0))
        ways, wobbling = F.bit_count(mask), F.bit_count(mask.bitwiseAND(WOBBLING))
        row = F.array(*[(ways * F.get(after, F.lit(b)) + (wobbling * F.get(after, F.lit(b - 1)) if b else F.lit(0))).cast("long") for b in range(budget + 1)])
        return F.concat(F.array(row), rows)

    return F.aggregate(F.reverse(domains), F.array(end), step)


def cardinality(counts: Column, budget: int) -> Column:
    return F.get(F.get(counts, F.lit(0)), F.lit(budget))


def _branches(state: Column, place: Column, counts: str, budget: int) -> list[tuple[Column, Column]]:
    """For each base: the ways to have spent each cost once it is taken, and the members that follow; none outside the base set."""
    mask = F.get("_domains", place)
    after = F.get(F.col(counts), place + 1)
    found = []
    for b in BASES:
        spent = [F.get(state["spent"], F.lit(u)) + (F.get(state["spent"], F.lit(u - 1)) if u and b in WOBBLE else F.lit(0)) for u in range(budget + 1)]
        members = sum((s * F.get(after, F.lit(budget - u)) for u, s in enumerate(spent)), F.lit(0).cast("long"))
        allowed = mask.bitwiseAND(1 << BASES.index(b)) != 0
        found.append((F.array(*[s.cast("long") for s in spent]), F.when(allowed, members).otherwise(0).cast("long")))
    return found


def _start(budget: int, **fields: Column) -> Column:
    return F.struct(F.array(*[F.lit(int(u == 0)).cast("long") for u in range(budget + 1)]).alias("spent"), *[c.alias(n) for n, c in fields.items()])


def _at_most(n: Column, budget: Column, most: int) -> Column:
    """Ways to choose at most ``budget`` of ``n``; none for a budget below 0."""
    return sum((F.when(budget >= i, choose(n, i)).otherwise(0) for i in range(most + 1)), F.lit(0).cast("long"))


def _facing(source: Column) -> Column:
    """The source's bases in the order of the adapter's."""
    return F.split(F.reverse(source), "")


def _wobbling_after(facing: Column, place: Column) -> Column:
    rest = F.slice(facing, place + 2, F.greatest(F.size(facing) - place - 1, F.lit(0)))
    return F.size(F.filter(rest, lambda b: b.isin(*WOBBLE)))


def _partner(base: Column, table: dict[str, str]) -> Column:
    out = F
    for own, other in table.items():
        out = out.when(base == own, other)
    return out


def member_at(requests: DataFrame, domains: Column, rank: Column, budget: int) -> DataFrame:
    """Adds ``cardinality``, and ``source`` and ``adapter`` of the member at ``rank`` (null beyond the last)."""
    rows = requests.withColumn("_domains", domains).withColumn("_counts", completions(F.col("_domains"), budget))
    rows = rows.withColumn("cardinality", cardinality(F.col("_counts"), budget)).withColumn("_rank", rank.cast("long"))
    places = F.sequence(F.lit(0), F.size("_domains") - 1)

    def source_step(state: Column, place: Column) -> Column:
        below = F.lit(0).cast("long")
        picked, spent, passed = F, F, F
        for b, (after, members) in zip(BASES, _branches(state, place, "_counts", budget)):
            inside = state["rest"] < below + members
            picked, spent, passed = picked.when(inside, b), spent.when(inside, after), passed.when(inside, below)
            below = below + members
        return F.struct(spent.otherwise(state["spent"]).alias("spent"), (state["rest"] - passed.otherwise(0)).alias("rest"), F.concat(state["word"], picked.otherwise("")).alias("word"))

    walked = F.aggregate(places, _start(budget, rest=F.col("_rank"), word=F.lit("")), source_step)
    valid = (F.col("_rank") >= 0) & (F.col("_rank") < F.col("cardinality")) & (F.size("_domains") > 0)
    rows = rows.withColumn("_walk", F.when(valid, walked)).withColumn("source", F.col("_walk.word")).withColumn("_facing", _facing(F.col("source")))

    def adapter_step(state: Column, place: Column) -> Column:
        base = F.get("_facing", place)
        left = _wobbling_after(F.col("_facing"), place)
        matched = _at_most(left, state["budget"], budget)
        wobbles = base.isin(*WOBBLE) & (state["rest"] >= matched)
        return F.struct(
            F.when(wobbles, state["rest"] - matched).otherwise(state["rest"]).alias("rest"),
            F.when(wobbles, state["budget"] - 1).otherwise(state["budget"]).alias("budget"),
            F.concat(state["word"], F.when(wobbles, _partner(base, WOBBLE)).otherwise(_partner(base, MATCH))).alias("word"),
        )

    start = F.struct(F.col("_walk.rest").alias("rest"), F.lit(budget).alias("budget"), F.lit("").alias("word"))
    rows = rows.withColumn("adapter", F.when(F.col("source").isNotNull(), F.aggregate(places, start, adapter_step)["word"]))
    return rows.drop("_domains", "_counts", "_rank", "_walk", "_facing")


def rank_of(members: DataFrame, domains: Column, source: str, adapter: str, budget: int) -> DataFrame:
    """Adds ``rank`` of each member, found without its predecessors; null for a word that is no member."""
    rows = members.withColumn("_domains", domains).withColumn("_counts", completions(F.col("_domains"), budget))
    rows = rows.withColumn("_source", F.split(source, "")).withColumn("_adapter", F.split(adapter, "")).withColumn("_facing", _facing(F.col(source)))
    places = F.sequence(F.lit(0), F.size("_domains") - 1)

    def source_step(state: Column, place: Column) -> Column:
        own = F.get("_source", place)
        below, spent = F.lit(0).cast("long"), F
        for b, (after, members_) in zip(BASES, _branches(state, place, "_counts", budget)):
            below = below + F.when(F.lit(b) < own, members_).otherwise(0)
            spent = spent.when(own == b, after)
        return F.struct(spent.otherwise(state["spent"]).alias("spent"), (state["rank"] + below).alias("rank"))

    def adapter_step(state: Column, place: Column) -> Column:
        base, own = F.get("_facing", place), F.get("_adapter", place)
        wobbles = base.isin(*WOBBLE) & (own == _partner(base, WOBBLE))
        matched = _at_most(_wobbling_after(F.col("_facing"), place), state["budget"], budget)
        return F.struct(
            (state["rank"] + F.when(wobbles, matched).otherwise(0)).alias("rank"), F.when(wobbles, state["budget"] - 1).otherwise(state["budget"]).alias("budget")
        )

    n = F.size("_domains")
    weights = F.transform(F.col("_source"), lambda b: F.coalesce(*[F.when(b == x, 1 << i) for i, x in enumerate(BASES)], F.lit(0)))
    pairs = F.zip_with("_facing", "_adapter", lambda b, a: F.when(a == _partner(b, MATCH), 0).when(a == _partner(b, WOBBLE), 1).otherwise(budget + 1))
    cost = F.aggregate(pairs, F.lit(0), lambda n_, c: n_ + c)
    fits = (F.size("_source") == n) & (F.size("_adapter") == n) & (n > 0) & F.forall(F.zip_with(weights, "_domains", lambda w, m: w.bitwiseAND(m) != 0), lambda x: x) & (cost <= budget)
    head = F.aggregate(places, _start(budget, rank=F.lit(0).cast("long")), source_step)["rank"]
    tail = F.aggregate(places, F.struct(F.lit(0).cast("long").alias("rank"), F.lit(budget).alias("budget")), adapter_step)["rank"]
    return rows.withColumn("rank", F.when(fits, head + tail)).drop("_domains", "_counts", "_source", "_adapter", "_facing")


def all_members(requests: DataFrame, domains: Column, budget: int, most: int) -> DataFrame:
    """Adds ``rank``, ``source`` and ``adapter`` of a population's first ``most`` members."""
    size = cardinality(completions(domains, budget), budget)
    ranks = F.explode(F.sequence(F.lit(0).cast("long"), F.least(size, F.lit(most)) - 1))
    sized = requests.withColumn("_size", size).where("_size > 0")
    return member_at(sized.withColumn("rank", ranks).drop("_size"), domains, F.col("rank"), budget)


def end_pairs(requests: DataFrame, keys: list[str], source: str, adapter: str, width: int, budget: int) -> DataFrame:
    """(keys, left_word, right_word, cost): the end words that some members show, with the least cost that shows them.

    ``source`` and ``adapter`` are columns of base sets that face each other place by place.  The first ``width`` contacts
    are seen; a hidden contact takes its cheapest pair.  A state is a pair of words and its cost so far: each contact joins
    it to the pairs it allows, equal words are merged at their least cost, and those over the budget go.  States are
    bounded by 16 ** width a request.
    """
    letters = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(0 if MATCH[a] == b else 1).alias("c")) for a in BASES for b in BASES])

    def allowed(place: Column) -> Column:
        weight = lambda base: F.get(F.array(*[F.lit(1 << i) for i in range(4)]), F.instr(F.lit(BASES), base) - 1)
        inside = lambda column, base: F.get(column, place).bitwiseAND(weight(base)) != 0
        return F.filter(letters, lambda p: inside(F.col(source), p["x"]) & inside(F.col(adapter), p["y"]))

    n = F.least(F.size(source), F.size(adapter))
    hidden = F.when(n > width, F.sequence(F.lit(width), n - 1)).otherwise(F.array().cast("array<int>"))
    least = F.transform(hidden, lambda i: F.coalesce(F.array_min(F.transform(allowed(i), lambda p: p["c"])), F.lit(budget + 1)))
    cost = F.aggregate(least, F.lit(0), lambda a, c: a + c)
    contacts = requests.where(n >= width).select(*keys, cost.alias("cost"), *[allowed(F.lit(i)).alias(f"_{i}") for i in range(width)])
    states = contacts.select(*keys, F.lit("").alias("left_word"), F.lit("").alias("right_word"), "cost")
    for i in range(width):
        pairs = contacts.select(*keys, F.inline(f"_{i}"))
        joined = states.join(pairs, keys).select(*keys, F.concat("left_word", "x").alias("left_word"), F.concat("y", "right_word").alias("right_word"), (F.col("cost") + F.col("c")).alias("cost"))
        states = joined.groupBy(*keys, "left_word", "right_word").agg(F.min("cost").alias("cost")).where(F.col("cost") <= budget)
    return states
