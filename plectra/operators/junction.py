"""Released foldbacks, their precursors, and routes that join them to basal pairs.

Searches walk a product of ordered axes by ordinal: the first nodes are unranked and joined to each axis by rank, so no
product is made beyond the node budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dna import COMPLEMENTS, SYMBOLS, WEIGHTS, masks, reverse_complement
from .bounded import Search, bounded_search
from .enumerate import global_rank
from .geometry import oriented_nick, oriented_release
from .scan import motif_pattern

ANY = 15
DECIMAL = "decimal(38,0)"
#: Strides stop growing here; ordinals stay below it.
STRIDE_CAP = 1 << 40

BLOCKERS = [
    "nick_site_before_origin", "release_site_before_origin", "release_site_not_downstream_of_nick", "incomplete_downstream_separation",
    "processing_domain_conflict", "foldback_pairing_domain_conflict",
]


@dataclass(frozen=True)
class FoldbackRequest:
    """What a released foldback must look like; ``active`` is the strand that folds, the other one is nicked."""

    active: str
    target: int
    displacement: int
    paired: int
    turn: int
    downstream: bool = True
    separated: bool = True

    @property
    def nicked(self) -> str:
        return "top" if self.active == "bottom" else "bottom"

    def boundaries(self) -> list[int]:
        """The target first, then by distance, the lower one of a pair first; never below 0."""
        near = [self.target + s * d for d in range(1, self.displacement + 1) for s in (-1, 1)]
        return [self.target, *[b for b in near if b >= 0]]


def strand_roles(nicked: Column) -> Column:
    """The strand that is active after a nick, the one kept as its partner, and the nicked one."""
    other = F.when(nicked == "top", "bottom").when(nicked == "bottom", "top")
    return F.struct(other.alias("active"), nicked.alias("retained"), nicked.alias("nicked"))


def paired_mask(mask: Column) -> Column:
    """The bases that pair with any base of a set."""
    partner = {WEIGHTS[b]: WEIGHTS[c] for b, c in zip(SYMBOLS[:4], COMPLEMENTS[:4], strict=True)}
    return F.get(F.array(*[F.lit(sum(p for w, p in partner.items() if m & w)) for m in range(16)]), mask)


def product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast(DECIMAL), lambda n, x: (n * x).cast(DECIMAL))


def _ranked(agents: DataFrame, key: str, name: str) -> DataFrame:
    return global_rank(agents, key).withColumnRenamed("rank", name)


def foldback_nodes(nicks: DataFrame, releases: DataFrame, request: FoldbackRequest, max_nodes: int) -> DataFrame:
    """The first nodes of boundary x nick x release x orientation, with ``ordinal`` and ``space_size``.

    ``nicks`` (nick_id, motif, native, cut) and ``releases`` (release_id, motif, top, bottom) hold one row an id.
    """
    spark = nicks.sparkSession
    left = _ranked(nicks.select("nick_id", F.col("motif").alias("nick_motif"), "native", "cut"), "nick_id", "nick_rank")
    right = _ranked(releases.select("release_id", F.col("motif").alias("release_motif"), "top", "bottom"), "release_id", "release_rank")
    sizes = nicks.agg(F.count(F.lit(1)).alias("_n")).crossJoin(releases.agg(F.count(F.lit(1)).alias("_r")))  # one row
    places = F.array(*[F.lit(b) for b in request.boundaries()])
    rest = F.floor(F.col("ordinal") / 2)
    nodes = (
        spark.range(max_nodes).select(F.col("id").alias("ordinal")).crossJoin(F.broadcast(sizes))
        .withColumn("space_size", F.size(places) * F.col("_n") * F.col("_r") * 2)
        .where(F.col("ordinal") < F.col("space_size"))
        .withColumn("orientation", F.when(F.col("ordinal") % 2 == 0, "forward").otherwise("reverse"))
        .withColumn("release_rank", rest % F.col("_r"))
        .withColumn("nick_rank", F.floor(rest / F.col("_r")) % F.col("_n"))
        .withColumn("boundary", F.get(places, F.floor(rest / (F.col("_r") * F.col("_n"))).cast("int")))
        .drop("_n", "_r")
    )
    return nodes.join(left, "nick_rank").join(right, "release_rank").drop("nick_rank", "release_rank")


def released_foldbacks(nodes: DataFrame, request: FoldbackRequest) -> DataFrame:
    """Each node's places, base sets by coordinate, choices by pair, exact sequence count and blockers.

    A coordinate holds what the nick motif and the release motif both allow; each pair then keeps the bases that have a
    partner on its other side.  Pairs share no coordinate, so one pass settles them.
    """
    nick = oriented_nick(F.col("nick_motif"), F.col("native"), F.col("cut"), F.lit(request.nicked))
    release = oriented_release(F.col("release_motif"), F.col("top"), F.col("bottom"), F.col("orientation"))
    arm = request.paired
    laid = nodes.withColumn("_n", nick).withColumn("_r", release).withColumns({
        "nick_start": F.col("boundary") - F.col("_n.cut"),
        "active_end": F.col("boundary") + 2 * arm + request.turn,
    })
    laid = laid.withColumn("release_start", F.col("active_end") - F.col(f"_r.{request.active}"))
    laid = laid.withColumns({
        "top_cut": F.col("release_start") + F.col("_r.top"),
        "bottom_cut": F.col("release_start") + F.col("_r.bottom"),
    }).withColumns({
        "precursor_nt": F.greatest("active_end", F.col("nick_start") + F.length("_n.motif"), F.col("release_start") + F.length("_r.motif"), "top_cut", "bottom_cut"),
        "_nm": masks(F.col("_n.motif")),
        "_rm": masks(F.col("_r.motif")),
    })

    def allowed(c: Column) -> Column:
        return F.coalesce(F.get("_nm", c - F.col("nick_start")), F.lit(ANY)).bitwiseAND(F.coalesce(F.get("_rm", c - F.col("release_start")), F.lit(ANY)))

    def narrowed(c: Column) -> Column:
        inside = (c >= F.col("boundary")) & (c < F.col("active_end"))
        offset = F.least(c - F.col("boundary"), F.col("active_end") - 1 - c)
        partner = F.get("_free", F.col("active_end") - 1 - (c - F.col("boundary")))
        own = F.get("_free", c)
        return F.when(inside & (offset < arm), own.bitwiseAND(paired_mask(partner))).otherwise(own)

    coordinates = F.sequence(F.lit(0), F.col("precursor_nt") - 1)
    laid = laid.withColumn("_free", F.transform(coordinates, allowed)).withColumn("domains", F.transform(coordinates, narrowed))
    pair_sizes = F.transform(F.sequence(F.lit(0), F.lit(arm - 1)), lambda o: F.bit_count(F.get("domains", F.col("boundary") + o)))
    right_side = lambda c: (c >= F.col("active_end") - arm) & (c < F.col("active_end"))
    axes = F.filter(coordinates, lambda c: ~right_side(c))  # a pair counts once, at its left coordinate
    conflict = F.exists("_free", lambda m: m == 0)
    partner_cut = F.col("top_cut" if request.active == "bottom" else "bottom_cut")
    tests = [
        F.col("nick_start") < 0,
        F.least("release_start", "top_cut", "bottom_cut") < 0,
        F.lit(request.downstream) & (F.col("release_start") < F.col("boundary")),
        F.lit(request.separated) & (partner_cut < F.col("active_end")),
        conflict,
        ~conflict & F.exists(pair_sizes, lambda n: n == 0),
    ]
    return laid.select(
        *nodes.columns, "nick_start", "release_start", "top_cut", "bottom_cut", "active_end", "precursor_nt", "domains",
        F.abs(F.col("boundary") - request.target).alias("displacement"),
        product(F.transform(axes, lambda c: F.bit_count(F.get("domains", c)))).alias("sequences"),
        F.array_compact(F.array(*[F.when(t, F.lit(b)) for t, b in zip(tests, BLOCKERS, strict=True)])).alias("blockers"),
    )


def foldback_search(nicks: DataFrame, releases: DataFrame, request: FoldbackRequest, max_nodes: int, max_hits: int) -> Search:
    """``examined`` holds every evaluated node; hits come exact boundary first, then by distance, boundary and ids."""
    rows = released_foldbacks(foldback_nodes(nicks, releases, request, max_nodes), request)
    order = [F.col("displacement"), F.col("boundary"), F.col("nick_id"), F.col("release_id"), F.col("orientation")]
    found = bounded_search(rows, "ordinal", F.col("blockers"), order, max_nodes, max_hits)
    size = F.coalesce(F.max("space_size"), F.lit(0))
    return Search(found.examined, found.hits, _summary(found.examined, size, max_nodes, max_hits))


def _summary(examined: DataFrame, size: Column, max_nodes: int, max_hits: int) -> DataFrame:
    counts = examined.agg(size.alias("space_size"), F.count(F.lit(1)).alias("examined"), F.count_if(F.size("blockers") == 0).alias("observed"))
    by_nodes, by_hits = F.col("space_size") > max_nodes, F.col("observed") > max_hits
    cut = F.array_join(F.array_compact(F.array(F.when(by_nodes, F.lit("nodes")), F.when(by_hits, F.lit("hits")))), ",")
    status = F.when(by_nodes | by_hits, "truncated").when(F.col("observed") > 0, "complete").otherwise("infeasible")
    return counts.withColumns({"status": status, "truncated_by": cut})


def precursors(geometries: DataFrame, template: Column, arm: int, max_nodes: int, max_hits: int) -> DataFrame:
    """Exact precursors of each geometry within a template of symbols, one symbol a coordinate.

    A geometry whose template leaves a coordinate or a pair without bases has one row with a blocker and no precursor.
    Axes are coordinates in order, a pair being one at its left coordinate; the last axis turns fastest.  Adds
    ``space_size``, ``examined``, ``ordinal`` (from 1), ``precursor``, ``blocker`` and ``truncated_by``.
    """
    coordinates = F.sequence(F.lit(0), F.col("precursor_nt") - 1)
    left = lambda c: (c >= F.col("boundary")) & (c < F.col("boundary") + arm)
    right = lambda c: (c >= F.col("active_end") - arm) & (c < F.col("active_end"))
    partner = lambda c: F.col("active_end") - 1 - (c - F.col("boundary"))
    met = F.zip_with("domains", masks(template), lambda d, t: F.coalesce(d, F.lit(0)).bitwiseAND(F.coalesce(t, F.lit(0))))
    narrowed = lambda c: F.when(left(c) | right(c), F.get("_met", c).bitwiseAND(paired_mask(F.get("_met", partner(c))))).otherwise(F.get("_met", c))
    bases = [b for b in SYMBOLS[:4]]
    letters = F.array(*[F.lit("".join(b for b in bases if m & WEIGHTS[b])) for m in range(16)])
    sized = (
        geometries.withColumn("_met", met)
        .withColumn("_choices", F.transform(coordinates, lambda c: F.when(right(c), F.lit("-")).otherwise(F.get(letters, narrowed(c)))))
        .withColumn("_sizes", F.transform("_choices", lambda s: F.length(s)))
        .withColumn("space_size", product(F.col("_sizes")))
    )
    examined = F.least(F.col("space_size"), F.lit(max_nodes)).cast("long")
    by_nodes, by_hits = F.col("space_size") > max_nodes, examined > max_hits
    cut = F.array_join(F.array_compact(F.array(F.when(by_nodes, F.lit("nodes")), F.when(by_hits, F.lit("hits")))), ",")
    # Stride of an axis: how many precursors share its choice and those before it.
    strides = F.transform(
        coordinates,
        lambda c: F.aggregate(F.slice("_sizes", c + 2, F.greatest(F.lit(0), F.size("_sizes") - c - 1)), F.lit(1).cast("long"), lambda n, x: F.least(n * x, F.lit(STRIDE_CAP))),
    )
    numbered = sized.withColumns({
        "examined": examined,
        "truncated_by": cut,
        "blocker": F.when(F.col("space_size") == 0, "caller_domain_conflict"),
        "_strides": strides,
        "ordinal": F.explode_outer(F.when(F.col("space_size") > 0, F.sequence(F.lit(1).cast("long"), F.least(examined, F.lit(max_hits))))),
    })

    def base(c: Column) -> Column:
        digit = F.floor((F.col("ordinal") - 1) / F.get("_strides", c)) % F.get("_sizes", c)
        return F.substring(F.get("_choices", c), digit.cast("int") + 1, F.lit(1))

    text = F.transform(coordinates, lambda c: F.when(right(c), reverse_complement(base(partner(c)))).otherwise(base(c)))
    return numbered.withColumn("precursor", F.when(F.col("ordinal").isNotNull(), F.array_join(text, ""))).drop("_met", "_choices", "_sizes", "_strides")


def scar_tests(scar: Column, template: Column, site: str) -> Column:
    """Why a four-base scar does not fit: a base outside its template, or a release site inside it."""
    outside = F.exists(F.zip_with(masks(scar), masks(template), lambda s, t: s.bitwiseAND(t)), lambda m: m == 0)
    held = scar.rlike(motif_pattern([site]))
    return F.array_compact(F.array(F.when(outside, F.lit("retained_scar_domain_conflict")), F.when(held, F.lit("retained_release_site_present"))))


def basal_routes(candidates: DataFrame, geometries: DataFrame, site: str, max_nodes: int, max_hits: int) -> Search:
    """Candidate x geometry pairs in order, candidates first; a pair with blockers is kept.

    ``candidates`` (scar) and ``geometries`` (geometry_id, template, nicked) hold distinct rows; hits follow the ordinal.
    """
    spark = candidates.sparkSession
    left = _ranked(candidates.select("scar"), "scar", "_c")
    right = _ranked(geometries.select("geometry_id", "template", "nicked"), "geometry_id", "_g")
    sizes = candidates.agg(F.count(F.lit(1)).alias("_m")).crossJoin(geometries.agg(F.count(F.lit(1)).alias("_n")))  # one row
    nodes = (
        spark.range(max_nodes).select(F.col("id").alias("ordinal")).crossJoin(F.broadcast(sizes))
        .withColumn("space_size", F.col("_m") * F.col("_n")).where(F.col("ordinal") < F.col("space_size"))
        .withColumns({"_c": F.floor(F.col("ordinal") / F.col("_n")), "_g": F.col("ordinal") % F.col("_n")})
    )
    pairs = nodes.join(left, "_c").join(right, "_g").drop("_c", "_g", "_m", "_n")
    rows = pairs.withColumn("surviving", strand_roles(F.col("nicked"))["active"])
    found = bounded_search(rows, "ordinal", scar_tests(F.col("scar"), F.col("template"), site), [F.col("ordinal")], max_nodes, max_hits)
    return Search(found.examined, found.hits, _summary(found.examined, F.coalesce(F.max("space_size"), F.lit(0)), max_nodes, max_hits))


def route_counts(candidates: DataFrame, geometries: DataFrame, site: str) -> DataFrame:
    """Pairs of the whole product by geometry and outcome, without making any: scars are counted by word, of which
    four bases give at most 256, and tested against each distinct template."""
    words = candidates.groupBy("scar").agg(F.count(F.lit(1)).alias("n"))
    templates = geometries.groupBy("template").agg(F.count(F.lit(1)).alias("geometries"))
    tested = templates.crossJoin(F.broadcast(words)).withColumn("blockers", scar_tests(F.col("scar"), F.col("template"), site))
    has = lambda b: F.sum(F.when(F.array_contains("blockers", b), F.col("n")).otherwise(0))
    by_template = tested.groupBy("template", "geometries").agg(
        F.sum("n").alias("pairs"),
        F.sum(F.when(F.size("blockers") == 0, F.col("n")).otherwise(0)).alias("compatible"),
        has("retained_scar_domain_conflict").alias("domain_conflicts"),
        has("retained_release_site_present").alias("release_sites"),
    )
    return by_template


def strand_join(precursor_rows: DataFrame, route_rows: DataFrame, active: str, surviving: str) -> DataFrame:
    """Precursor x route pairs by strand: those that meet on one strand, and those that do not, which stay reported.

    Both sides are counted by strand first, so at most four rows are joined.
    """
    left = precursor_rows.groupBy(F.col(active).alias("active")).agg(F.count(F.lit(1)).alias("precursors"))
    right = route_rows.groupBy(F.col(surviving).alias("surviving")).agg(F.count(F.lit(1)).alias("routes"))
    both = left.crossJoin(F.broadcast(right))
    blocker = F.when(F.col("active") != F.col("surviving"), "continuous_strand_mismatch")
    return both.select("active", "surviving", "precursors", "routes", (F.col("precursors") * F.col("routes")).alias("pairs"), blocker.alias("blocker"))


def pair_accounting(pairs: DataFrame, upstream: DataFrame, max_hits: int) -> DataFrame:
    """One row of examined precursor and route pairs (space_size, blocker): counts, and every reason why there may be more.

    ``upstream`` is one row: whether the precursors (_p) and the routes (_r) were cut.
    """
    found = pairs.agg(F.coalesce(F.max("space_size"), F.lit(0)).alias("available"), F.count(F.lit(1)).alias("examined"), F.count_if(F.col("blocker").isNull()).alias("observed"))
    both = found.crossJoin(F.broadcast(upstream)).withColumn("returned", F.least("observed", F.lit(max_hits)).cast("long"))
    tests = [
        ("released_precursors", F.col("_p")), ("basal_routes", F.col("_r")), ("max_search_nodes", F.col("examined") < F.col("available")), ("max_hits", F.col("observed") > max_hits),
    ]
    cut = F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])), ",")
    status = F.when(F.col("truncated_by") != "", "truncated").when(F.col("returned") > 0, "complete").otherwise("infeasible")
    return both.withColumn("truncated_by", cut).withColumn("status", status).drop("_p", "_r")
