"""Foldbacks judged whole, released strand states, base domains that must pair, and programs of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import SYMBOLS, masks, reverse_complement, symbol_mask
from .ranks import rank_within

# Codes of a foldback's independent faults, in order, and of a release's.
FOLD_CODES = tuple(f"FOLD-00{i}" for i in range(1, 7))
RELEASE_CODES = ("nick_outside_precursor", "cut_outside_precursor", "cut_not_downstream_of_nick", "incomplete_separation")
#: Symbols in the order of their masks, none first.
MASK_SYMBOLS = "-" + "".join(sorted(SYMBOLS, key=symbol_mask))
# What may face a base, as masks: matches alone, or a G and a T as well.
PARTNERS = {False: {1: 8, 2: 4, 4: 2, 8: 1}, True: {1: 8, 2: 4, 4: 2 | 8, 8: 1 | 4}}


def evaluated_foldback(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds ``designed``, the counts and ``codes`` of rows (precursor, start, stop, extension, arm, protected_start, protected_stop).

    The retained tract is precursor[start, stop), the turn is the rest of the precursor and the extension.  ``limits`` holds
    max_mismatches, terminal_min, terminal_max, max_run, max_added and turn_nt.  The arm is as long as the tract.
    """
    tract = F.substring(F.col("precursor"), F.col("start") + 1, F.col("stop") - F.col("start"))
    aligned = reverse_complement(F.col("arm"))
    n = F.col("stop") - F.col("start")
    unlike = F.zip_with(F.split(tract, ""), F.split(aligned, ""), lambda a, b: a != b)
    rows = rows.withColumn("_unlike", unlike).withColumn("faults", F.array_compact(F.transform("_unlike", lambda x, i: F.when(x, i)))).drop("_unlike")
    edges = F.concat(F.array(F.lit(-1)), F.col("faults"), F.array(n))
    runs = F.zip_with(F.slice(edges, 2, F.size(edges)), F.slice(edges, 1, F.size(edges) - 1), lambda b, a: b - a - 1)
    rows = rows.withColumns({
        "terminal": F.get(runs, F.lit(0)),
        "longest": F.array_max(runs),
        "added_nt": F.length("extension") + F.length("arm"),
        "turn_nt": F.length("precursor") - F.col("stop") + F.length("extension"),
        "designed": F.concat("precursor", "extension", "arm"),
    })
    inside = F.exists("faults", lambda i: (F.col("start") + i >= F.col("protected_start")) & (F.col("start") + i < F.col("protected_stop")))
    tests = [
        F.size("faults") > limits["max_mismatches"],
        inside,
        ~F.col("terminal").between(limits["terminal_min"], limits["terminal_max"]),
        F.col("longest") > limits["max_run"],
        F.col("added_nt") > limits["max_added"],
        F.col("turn_nt") != limits["turn_nt"],
    ]
    return rows.withColumn("codes", F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(tests, FOLD_CODES, strict=True)])))


def released_state(rows: DataFrame) -> DataFrame:
    """Adds ``active_product``, ``retained_partner``, their origins and ``codes`` of rows (precursor, active, nick, top_cut, bottom_cut).

    The strand that is not active is nicked.  The active strand keeps what lies from the nick to its own cut, its partner what
    lies before the nick; the bottom strand reads backwards, so its origins fall.  A row with codes has no products.
    """
    n = F.length("precursor")
    own = F.when(F.col("active") == "top", F.col("top_cut")).otherwise(F.col("bottom_cut"))
    other = F.when(F.col("active") == "top", F.col("bottom_cut")).otherwise(F.col("top_cut"))
    tests = [
        (F.col("nick") <= 0) | (F.col("nick") >= n),
        (F.least("top_cut", "bottom_cut") < 0) | (F.greatest("top_cut", "bottom_cut") > n),
        own <= F.col("nick"),
        other < own,
    ]
    codes = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(tests, RELEASE_CODES, strict=True)]))
    rows = rows.withColumn("codes", codes)
    ok = F.size("codes") == 0
    kept = F.substring(F.col("precursor"), F.col("nick") + 1, (own - F.col("nick")).cast("int"))
    rest = F.substring(F.col("precursor"), F.lit(1), F.col("nick").cast("int"))
    forward = F.col("active") == "top"
    spans = lambda low, high, up: F.when(up, F.sequence(low, high - 1)).otherwise(F.sequence(high - 1, low, F.lit(-1).cast("long")))
    return rows.withColumns({
        "active_product": F.when(ok, F.when(forward, kept).otherwise(reverse_complement(kept))),
        "retained_partner": F.when(ok, F.when(forward, reverse_complement(rest)).otherwise(rest)),
        "active_origins": F.when(ok, spans(F.col("nick").cast("long"), own.cast("long"), forward)),
        "partner_origins": F.when(ok, spans(F.lit(0).cast("long"), F.col("nick").cast("long"), ~forward)),
    })


def paired_domains(rows: DataFrame, source: str, adapter: str, wobble: bool) -> DataFrame:
    """Adds what is left of two templates that face each other, as symbols, and the first failure.

    A base stays if some base of the facing set may pair with it.  A place without bases is ``-``; templates of other
    lengths fail before any place is looked at.
    """
    partner = [sum(1 << i for i in range(4) if any((m >> b) & 1 and (PARTNERS[wobble][1 << b] >> i) & 1 for b in range(4))) for m in range(16)]
    table = F.array(*[F.lit(p) for p in partner])
    met = lambda a, b: F.zip_with(masks(F.col(a)), masks(F.col(b)), lambda x, y: x.bitwiseAND(F.get(table, y)))
    same = F.length(source) == F.length(adapter)
    rows = rows.withColumn("_s", F.when(same, met(source, adapter))).withColumn("_a", F.when(same, met(adapter, source)))
    text = lambda c: F.array_join(F.transform(c, lambda m: F.substring(F.lit(MASK_SYMBOLS), m + 1, F.lit(1))), "")
    at = F.array_position(F.transform("_s", lambda m: m == 0), True)
    failure = F.when(~same, "lengths_differ").when(at > 0, F.concat(F.lit("no_pair_at_"), (at - 1).cast("string")))
    return rows.withColumns({"source_domain": text(F.col("_s")), "adapter_domain": text(F.col("_a")), "failure": failure}).drop("_s", "_a")


def programs(nicks: DataFrame, releases: DataFrame, permitted: Column) -> DataFrame:
    """(ordinal, kind, nick_id, orientation, release_id): one agent alone, then with each permitted release, in order of their ids.

    ``permitted`` is a test of a row (nick_id, nick_motif, orientation, release_id, release_motif).
    """
    alone = nicks.select("nick_id", F.col("motif").alias("nick_motif"), F.explode(F.array(F.lit("forward"), F.lit("reverse"))).alias("orientation"))
    singles = alone.select(F.lit("single").alias("kind"), "nick_id", "orientation", F.lit(None).cast("string").alias("release_id"))
    both = alone.crossJoin(releases.select("release_id", F.col("motif").alias("release_motif"))).where(permitted)  # two catalogues of agents
    pairs = both.select(F.lit("two").alias("kind"), "nick_id", "orientation", "release_id")
    key = F.concat_ws("|", F.when(F.col("kind") == "single", "0").otherwise("1"), "nick_id", "orientation", F.coalesce("release_id", F.lit("")))
    ranked = rank_within(singles.unionByName(pairs).withColumn("_key", key), "_key", "ordinal")
    return ranked.select("ordinal", "kind", "nick_id", "orientation", "release_id")


def integer_levels(rows: DataFrame, group: str, level: str, reason: str, top: int, quota: int) -> DataFrame:
    """(group, level, examined, accepted, reasons, so_far, status) of every level from 0 to ``top``, empty ones too.

    A row without a ``reason`` is accepted.  Levels after the one that fills the quota are not visited.
    """
    counts = rows.where(F.col(level).between(0, top)).groupBy(group, level).agg(
        F.count(F.lit(1)).alias("examined"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons")
    )
    every = rows.select(group).distinct().withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(top))))
    full = every.join(counts, [group, level], "left").fillna(0, ["examined", "accepted"]).fillna("", ["reasons"])
    so_far = F.sum("accepted").over(Window.partitionBy(group).orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("so_far") - F.col("accepted")
    status = F.when(before >= quota, "unvisited").when(F.col("so_far") >= quota, "quota_met").when(F.col("examined") == 0, "empty").otherwise("complete")
    return full.withColumn("so_far", so_far).withColumn("status", status)


def bounded_agents(feasible: DataFrame, keys: list[str], agent: str, max_nodes: int, max_hits: int) -> DataFrame:
    """The agents looked at (``ordinal`` from 0 by id) with their blockers, and ``hit`` from 1 in the same order up to ``max_hits``.

    ``feasible`` (keys, agent, blockers) has a row an agent of a catalogue and key.
    """
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy(agent)) - 1  # a catalogue
    seen = feasible.withColumn("ordinal", ordinal).where(F.col("ordinal") < max_nodes)
    place = F.sum((F.size("blockers") == 0).cast("int")).over(Window.partitionBy(*keys).orderBy("ordinal"))
    return seen.withColumn("_p", place).withColumn("hit", F.when((F.size("blockers") == 0) & (F.col("_p") <= max_hits), F.col("_p"))).drop("_p")


def supported_union(rows: DataFrame, case: str, program: str, word: str, budget: int) -> DataFrame:
    """(case, word, programs): each case's words once, with how many programs support them; a case over the budget is an error."""
    union = rows.select(case, program, word).distinct().groupBy(case, word).agg(F.count(F.lit(1)).alias("programs"))
    sizes = union.groupBy(case).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > budget)
    if not sizes.isEmpty():
        raise ValueError(f"a case has more than {budget} words")
    return union
