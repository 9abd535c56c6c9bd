"""Queries over released foldbacks, precursors, junction routes and regional differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import iupac_view
from ..operators import difference, junction, pool
from ..operators.scan import distinct_words
from ..sources.shared import written
from .construction import ORACLE_SQL, QUERIES
from .pools import AXES, B, S, SELECTIONS, T
from .sequences import NICK_AGENTS, query, scan_nicking_sites
from .tables import IUPAC_SQL, document_dna, item_symbols, table

__all__ = ["ORACLE_SQL", "QUERIES"]

REQUESTS = {a: junction.FoldbackRequest(active=a, target=4, displacement=2, paired=2, turn=1) for a in ("bottom", "top")}
NODES, HITS = 3000, 40
TEMPLATE = "NNSWNN"
PRECURSORS, PRECURSOR_HITS = 64, 16
SITE = "RCY"
ROUTES, ROUTE_HITS = 5000, 100


def agents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The part catalogue as agents: types nick, names release; both catalogues are as small as their vocabularies."""
    parts = table(spark, sf_dir, "part")
    n = F.length("motif")
    nicks = parts.select(F.col("p_type").alias("nick_id"), iupac_view(F.col("p_type")).alias("motif")).distinct().where(n > 0)
    nicks = nicks.withColumns({"native": F.when(F.col("motif").rlike("[TG]"), "top").otherwise("bottom"), "cut": n + 1})
    releases = parts.select(F.col("p_name").alias("release_id"), iupac_view(F.col("p_name")).alias("motif")).distinct().where(n > 0)
    return nicks, releases.withColumns({"top": n + 2, "bottom": n + n % 3 * 2})


def view_sql(column: str) -> str:
    return IUPAC_SQL.replace("text", column)


def mask_sql(symbol: str) -> str:
    """Symbols in the order of their masks, 1 to 15."""
    return f"strpos('ACMGRSVTWYHKDBN', {symbol})"


def partner_sql(mask: str) -> str:
    return f"[0,8,4,12,2,10,6,14,1,9,5,13,3,11,7,15][{mask} + 1]"


COMPLEMENT = "reverse(translate({}, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN'))"


def foldback_sql(active: str) -> str:
    """Tables ``nodes`` (one row a node), ``dom`` (one row a coordinate) and ``told`` (one row a node, with blockers)."""
    r = REQUESTS[active]
    places = ", ".join(f"({i}, {b})" for i, b in enumerate(r.boundaries()))
    partner = "top_cut" if active == "bottom" else "bottom_cut"
    return f"""WITH k0 AS (SELECT DISTINCT p_type AS nick_id, {view_sql('p_type')} AS motif FROM part WHERE length({view_sql('p_type')}) > 0),
k AS (SELECT nick_id, row_number() OVER (ORDER BY nick_id) - 1 AS kr, CASE WHEN (CASE WHEN regexp_matches(motif, '[TG]') THEN 'top' ELSE 'bottom' END) = '{r.nicked}' THEN motif ELSE {COMPLEMENT.format('motif')} END AS nm,
 CASE WHEN (CASE WHEN regexp_matches(motif, '[TG]') THEN 'top' ELSE 'bottom' END) = '{r.nicked}' THEN length(motif) + 1 ELSE -1 END AS nc FROM k0),
l0 AS (SELECT DISTINCT p_name AS release_id, {view_sql('p_name')} AS motif FROM part WHERE length({view_sql('p_name')}) > 0),
l1 AS (SELECT release_id, row_number() OVER (ORDER BY release_id) - 1 AS lr, motif, length(motif) AS n, length(motif) + 2 AS t, length(motif) + length(motif) % 3 * 2 AS b FROM l0),
l AS (SELECT release_id, lr, 0 AS o, 'forward' AS orientation, motif AS rm, t, b FROM l1 UNION ALL SELECT release_id, lr, 1, 'reverse', {COMPLEMENT.format('motif')}, n - b, n - t FROM l1),
p(bo, boundary) AS (VALUES {places}),
n0 AS (SELECT ((bo * (SELECT count(*) FROM k) + kr) * (SELECT count(*) FROM l1) + lr) * 2 + o AS ordinal, nick_id, release_id, orientation, boundary, nm, rm, t, b,
 boundary - nc AS nick_start, boundary + {2 * r.paired + r.turn} AS active_end, boundary + {2 * r.paired + r.turn} - {active[0]} AS release_start FROM p, k, l),
nodes AS (SELECT *, release_start + t AS top_cut, release_start + b AS bottom_cut, abs(boundary - {r.target}) AS displacement,
 greatest(active_end, nick_start + length(nm), release_start + length(rm), release_start + t, release_start + b) AS precursor_nt FROM n0 WHERE ordinal < {NODES}),
c0 AS (SELECT *, unnest(range(0, precursor_nt)) AS c FROM nodes),
free AS (SELECT ordinal, c, boundary, active_end,
 (CASE WHEN c >= nick_start AND c < nick_start + length(nm) THEN {mask_sql('substr(nm, CAST(c - nick_start + 1 AS BIGINT), 1)')} ELSE 15 END)
 & (CASE WHEN c >= release_start AND c < release_start + length(rm) THEN {mask_sql('substr(rm, CAST(c - release_start + 1 AS BIGINT), 1)')} ELSE 15 END) AS free FROM c0),
dom AS (SELECT a.ordinal, a.c, a.boundary, a.active_end, a.free, z.free IS NOT NULL AS paired, z.free IS NOT NULL AND a.c >= a.active_end - {r.paired} AS far,
 CASE WHEN z.free IS NULL THEN a.free ELSE a.free & {partner_sql('z.free')} END AS m
 FROM free a LEFT JOIN free z ON a.ordinal = z.ordinal AND z.c = a.active_end - 1 - (a.c - a.boundary)
  AND least(a.c - a.boundary, a.active_end - 1 - a.c) BETWEEN 0 AND {r.paired - 1}),
counted AS (SELECT ordinal, CAST(product(CASE WHEN far THEN 1 ELSE bit_count(m) END) AS BIGINT) AS sequences, bool_or(free = 0) AS conflict, bool_or(paired AND m = 0) AS unpaired FROM dom GROUP BY ordinal),
told AS (SELECT nodes.*, sequences, concat_ws(',', CASE WHEN nick_start < 0 THEN 'nick_site_before_origin' END, CASE WHEN least(release_start, top_cut, bottom_cut) < 0 THEN 'release_site_before_origin' END,
 CASE WHEN release_start < boundary THEN 'release_site_not_downstream_of_nick' END, CASE WHEN {partner} < active_end THEN 'incomplete_downstream_separation' END,
 CASE WHEN conflict THEN 'processing_domain_conflict' END, CASE WHEN NOT conflict AND unpaired THEN 'foldback_pairing_domain_conflict' END) AS blockers FROM nodes JOIN counted USING (ordinal)),
hits AS (SELECT ordinal, row_number() OVER (ORDER BY displacement, boundary, nick_id, release_id, orientation) AS hit FROM told WHERE blockers = '' QUALIFY hit <= {HITS})
"""


def search(spark: SparkSession, sf_dir: str, active: str = "bottom"):
    nicks, releases = agents(spark, sf_dir)
    return junction.foldback_search(nicks, releases, REQUESTS[active], NODES, HITS)


def longs(df: DataFrame, *columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


@query(
    foldback_sql("bottom")
    + """SELECT ordinal, nick_id, release_id, orientation, CAST(boundary AS BIGINT) AS boundary, CAST(nick_start AS BIGINT) AS nick_start, CAST(release_start AS BIGINT) AS release_start,
 CAST(precursor_nt AS BIGINT) AS precursor_nt, sequences, blockers, hit FROM told LEFT JOIN hits USING (ordinal)"""
)
def released_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluated nick, release, orientation and boundary, with its blockers and its place among the hits."""
    found = search(spark, sf_dir)
    rows = found.examined.join(F.broadcast(found.hits.select("ordinal", "hit")), "ordinal", "left")  # at most HITS rows
    numbers = longs(rows, "boundary", "nick_start", "release_start", "precursor_nt", "sequences", "hit")
    return rows.select("ordinal", "nick_id", "release_id", "orientation", *numbers, F.array_join("blockers", ",").alias("blockers"))


@query(
    foldback_sql("bottom")
    + f"""SELECT (SELECT count(*) FROM n0) AS space_size, count(*) AS examined, count(*) FILTER (blockers = '') AS observed,
 CASE WHEN (SELECT count(*) FROM n0) > {NODES} OR count(*) FILTER (blockers = '') > {HITS} THEN 'truncated' WHEN count(*) FILTER (blockers = '') > 0 THEN 'complete' ELSE 'infeasible' END AS status,
 concat_ws(',', CASE WHEN (SELECT count(*) FROM n0) > {NODES} THEN 'nodes' END, CASE WHEN count(*) FILTER (blockers = '') > {HITS} THEN 'hits' END) AS truncated_by FROM told"""
)
def released_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, sf_dir).summary


def precursor_sql(active: str) -> str:
    return f"""{foldback_sql(active)},
m0 AS (SELECT d.*, m & {mask_sql(f"substr('{TEMPLATE}', CAST(c % {len(TEMPLATE)} + 1 AS BIGINT), 1)")} AS met FROM dom d JOIN hits USING (ordinal)),
m1 AS (SELECT a.ordinal, a.c, a.far, CASE WHEN a.paired THEN a.active_end - 1 - (a.c - a.boundary) END AS other, CASE WHEN a.paired THEN a.met & {partner_sql('z.met')} ELSE a.met END AS met
 FROM m0 a LEFT JOIN m0 z ON a.ordinal = z.ordinal AND a.paired AND z.c = a.active_end - 1 - (a.c - a.boundary)),
axes AS (SELECT *, CASE WHEN far THEN '-' ELSE concat(CASE WHEN met & 1 > 0 THEN 'A' END, CASE WHEN met & 2 > 0 THEN 'C' END, CASE WHEN met & 4 > 0 THEN 'G' END, CASE WHEN met & 8 > 0 THEN 'T' END) END AS choices FROM m1),
strided AS (SELECT *, CAST(least(1099511627776, coalesce(product(length(choices)) OVER (PARTITION BY ordinal ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS BIGINT) AS stride FROM axes),
spaces AS (SELECT ordinal, CAST(product(length(choices)) AS BIGINT) AS space_size FROM axes GROUP BY ordinal),
numbered AS (SELECT ordinal, space_size, unnest(range(0, least(space_size, {PRECURSORS}, {PRECURSOR_HITS}))) AS x FROM spaces),
near AS (SELECT n.ordinal, n.x, s.c, s.other, s.far, substr(choices, CAST((x // stride) % length(choices) + 1 AS BIGINT), 1) AS base FROM numbered n JOIN strided s ON n.ordinal = s.ordinal),
words AS (SELECT a.ordinal, a.x, string_agg(CASE WHEN a.far THEN translate(z.base, 'ACGT', 'TGCA') ELSE a.base END, '' ORDER BY a.c) AS precursor
 FROM near a LEFT JOIN near z ON a.far AND a.ordinal = z.ordinal AND a.x = z.x AND z.c = a.other GROUP BY a.ordinal, a.x)
"""


def found_precursors(spark: SparkSession, sf_dir: str, active: str) -> DataFrame:
    template = F.substring(F.repeat(F.lit(TEMPLATE), F.ceil(F.col("precursor_nt") / len(TEMPLATE)).cast("int")), F.lit(1), F.col("precursor_nt").cast("int"))
    return junction.precursors(search(spark, sf_dir, active).hits.drop("space_size"), template, REQUESTS[active].paired, PRECURSORS, PRECURSOR_HITS)


@query(
    precursor_sql("bottom")
    + f"""SELECT nick_id, release_id, orientation, CAST(boundary AS BIGINT) AS boundary, space_size, x + 1 AS ordinal, precursor, CASE WHEN space_size = 0 THEN 'caller_domain_conflict' END AS blocker,
 concat_ws(',', CASE WHEN space_size > {PRECURSORS} THEN 'nodes' END, CASE WHEN least(space_size, {PRECURSORS}) > {PRECURSOR_HITS} THEN 'hits' END) AS truncated_by
FROM spaces JOIN nodes USING (ordinal) LEFT JOIN words USING (ordinal)"""
)
def released_precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first exact precursors of each geometry within a caller's template."""
    rows = found_precursors(spark, sf_dir, "bottom")
    return rows.select("nick_id", "release_id", "orientation", *longs(rows, "boundary", "space_size", "ordinal"), "precursor", "blocker", "truncated_by")


SCARS_SQL = "SELECT DISTINCT substr(dna, start, 4) AS scar FROM (SELECT dna, unnest(range(1, length(dna) - 2)) AS start FROM (SELECT upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS dna FROM documents) WHERE length(dna) >= 4)"
#: A template is the first four symbols of an item; its number tells the nicked strand.
GEOMETRIES_SQL = f"SELECT item_id AS geometry_id, substr(seq, 1, 4) AS template, CASE WHEN item_id % 3 = 0 THEN 'top' ELSE 'bottom' END AS nicked FROM (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark) WHERE length(seq) >= 4"


def scars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words of four bases, at most 256; written, as searches read them several times."""
    return written(distinct_words(document_dna(spark, sf_dir), "dna", 4).withColumnRenamed("word", "scar"), "scars")


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_symbols(spark, sf_dir).where(F.length("seq") >= 4)
    return items.select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("geometry_id"), F.substring("seq", 1, 4).alias("template"), F.when(F.col("item_id") % 3 == 0, "top").otherwise("bottom").alias("nicked"))


CLASS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "N": "ACGT"}
TEMPLATE_SQL = "template"
for _s, _b in CLASS.items():
    if len(_b) > 1:
        TEMPLATE_SQL = f"replace({TEMPLATE_SQL}, '{_s}', '[{_b}]')"
SITE_SQL = "[AG]C[CT]|[AG]G[CT]"
PAIRS_SQL = f"""WITH s AS (SELECT scar, row_number() OVER (ORDER BY scar) - 1 AS i FROM ({SCARS_SQL})),
g AS (SELECT lpad(CAST(geometry_id AS VARCHAR), 12, '0') AS geometry_id, template, nicked, row_number() OVER (ORDER BY geometry_id) - 1 AS j FROM ({GEOMETRIES_SQL})),
q AS (SELECT i * (SELECT count(*) FROM g) + j AS ordinal, scar, geometry_id, template, nicked, NOT regexp_full_match(scar, {TEMPLATE_SQL}) AS outside, regexp_matches(scar, '{SITE_SQL}') AS held FROM s, g)
"""
ROUTES_SQL = f""", e AS (SELECT * FROM q WHERE ordinal < {ROUTES}), h AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS hit FROM e WHERE NOT outside AND NOT held QUALIFY hit <= {ROUTE_HITS})"""


def routes(spark: SparkSession, sf_dir: str):
    return junction.basal_routes(scars(spark, sf_dir), geometries(spark, sf_dir), SITE, ROUTES, ROUTE_HITS)


@query(
    PAIRS_SQL + ROUTES_SQL
    + """ SELECT ordinal, scar, geometry_id, CASE nicked WHEN 'top' THEN 'bottom' ELSE 'top' END AS surviving,
 concat_ws(',', CASE WHEN outside THEN 'retained_scar_domain_conflict' END, CASE WHEN held THEN 'retained_release_site_present' END) AS blockers, hit FROM e LEFT JOIN h USING (ordinal)"""
)
def route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basal pair by processing geometry: every examined pair with its blockers, hits numbered in order."""
    found = routes(spark, sf_dir)
    rows = found.examined.join(F.broadcast(found.hits.select("ordinal", "hit")), "ordinal", "left")  # at most ROUTE_HITS rows
    return rows.select("ordinal", "scar", "geometry_id", "surviving", F.array_join("blockers", ",").alias("blockers"), "hit")


@query(
    PAIRS_SQL
    + """SELECT template, count(DISTINCT geometry_id) AS geometries, count(DISTINCT scar) AS pairs, count(DISTINCT scar) FILTER (NOT outside AND NOT held) AS compatible,
 count(DISTINCT scar) FILTER (outside) AS domain_conflicts, count(DISTINCT scar) FILTER (held) AS release_sites FROM q GROUP BY template"""
)
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the whole product of pairs, by template; pairs are for one geometry of the template."""
    return junction.route_counts(scars(spark, sf_dir), geometries(spark, sf_dir), SITE)


def strand_precursors_sql() -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS active, count(precursor) AS precursors FROM ({precursor_sql(a)} SELECT * FROM words)" for a in REQUESTS) + ") WHERE precursors > 0"


@query(
    f"""WITH pre AS ({strand_precursors_sql()}), rts AS (SELECT CASE nicked WHEN 'top' THEN 'bottom' ELSE 'top' END AS surviving, count(*) AS routes FROM ({PAIRS_SQL}{ROUTES_SQL} SELECT * FROM e JOIN h USING (ordinal)) GROUP BY 1)
SELECT active, surviving, precursors, routes, precursors * routes AS pairs, CASE WHEN active <> surviving THEN 'continuous_strand_mismatch' END AS blocker FROM pre, rts"""
)
def strand_route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precursors by basal routes on one strand; pairs on different strands are counted with their blocker."""
    sides = [found_precursors(spark, sf_dir, a).where("precursor IS NOT NULL").select(F.lit(a).alias("active")) for a in REQUESTS]
    return junction.strand_join(sides[0].unionByName(sides[1]), routes(spark, sf_dir).hits.select("surviving"), "active", "surviving")


@query(
    f"""SELECT doc_id, agent_id, start, CASE nicked_strand WHEN 'top' THEN 'bottom' ELSE 'top' END AS active, nicked_strand AS retained, nicked_strand AS nicked
FROM ({ORACLE_SQL['scan_nicking_sites']}) WHERE agent_id = '{NICK_AGENTS[0][0]}'"""
)
def strand_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each strand after a nick."""
    sites = scan_nicking_sites(spark, sf_dir).where(F.col("agent_id") == NICK_AGENTS[0][0])
    return sites.select("doc_id", "agent_id", "start", F.inline(F.array(junction.strand_roles(F.col("nicked_strand")))))


@query(
    """WITH RECURSIVE pairs AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), u AS (SELECT DISTINCT x, y FROM pairs WHERE x <> y),
r AS (SELECT x, y, 0 AS d, list_transform(range(0, length(x) + 1), lambda i: CASE WHEN i = 0 THEN 0 END) AS c1, list_transform(range(0, length(x) + 1), lambda i: CAST(NULL AS INTEGER)) AS c2,
  list_transform(range(0, length(x) + 1), lambda i: CASE WHEN i = 0 THEN 1 END) AS w1, list_transform(range(0, length(x) + 1), lambda i: CAST(NULL AS INTEGER)) AS w2 FROM u
 UNION ALL
 SELECT x, y, d, c0, c1, list_transform(range(0, length(x) + 1), lambda i: CASE WHEN c0[i + 1] IS NULL THEN NULL ELSE least(2,
   CASE WHEN i > 0 AND d > i AND c2[i] + CAST(substr(x, i, 1) <> substr(y, d - i, 1) AS INTEGER) = c0[i + 1] THEN w2[i] ELSE 0 END
   + CASE WHEN i > 0 AND c1[i] + 1 = c0[i + 1] THEN w1[i] ELSE 0 END + CASE WHEN d > i AND c1[i + 1] + 1 = c0[i + 1] THEN w1[i + 1] ELSE 0 END) END), w1
 FROM (SELECT x, y, d + 1 AS d, c1, c2, w1, w2, list_transform(range(0, length(x) + 1), lambda i: CASE WHEN d + 1 < i OR d + 1 - i > length(y) THEN NULL ELSE least(
   CASE WHEN i > 0 AND d + 1 > i THEN c2[i] + CAST(substr(x, i, 1) <> substr(y, d + 1 - i, 1) AS INTEGER) END, CASE WHEN i > 0 THEN c1[i] + 1 END, CASE WHEN d + 1 > i THEN c1[i + 1] + 1 END) END) AS c0
  FROM r WHERE d < length(x) + length(y)))
SELECT p_partkey, CAST(length(pairs.y) - length(pairs.x) AS BIGINT) AS length_delta, CASE WHEN pairs.x = pairs.y THEN 'identical' WHEN w1[length(pairs.x) + 1] = 1 THEN 'unique_minimum_edit' ELSE 'ambiguous_minimum_edit' END AS correspondence,
 CAST(levenshtein(pairs.x, pairs.y) AS BIGINT) AS edits FROM pairs LEFT JOIN r ON r.x = pairs.x AND r.y = pairs.y AND r.d = length(r.x) + length(r.y)"""
)
def region_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next part's: whether one minimum edit explains the change."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("after"))
    told = parts.join(after, "p_partkey").withColumn("told", difference.region_difference(F.col("p_name"), F.col("after")))
    delta = F.length("after") - F.length("p_name")
    return told.select("p_partkey", delta.cast("long").alias("length_delta"), "told.correspondence", F.col("told.edits").cast("long").alias("edits"))


PINS = {"p_type": ["ECONOMY", "LARGE"], "band": ["low", "middle"]}
BAND_SQL = "CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 30 THEN 'middle' WHEN p_size < 45 THEN 'high' END"


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("band", F.expr(BAND_SQL))


@query(
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN p_type NOT IN ('ECONOMY', 'LARGE') THEN 'p_type:different' END, CASE WHEN band IS NULL THEN 'band:unassessed' WHEN band NOT IN ('low', 'middle') THEN 'band:different' END) AS reasons,
 coalesce(band IN ('low', 'middle'), false) AS open_type FROM (SELECT *, {BAND_SQL} AS band FROM part)"""
)
def variant_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options against pinned variants; ``open_type`` leaves out the pin of the region in focus."""
    focused = F.size(pool.pin_reasons(PINS, focus="p_type")) == 0
    return banded(spark, sf_dir).select("p_partkey", F.array_join(pool.pin_reasons(PINS), ",").alias("reasons"), focused.alias("open_type"))


def refined_sql(axis: str, others: str) -> str:
    return f"""SELECT '{axis}' AS axis, CAST({axis} AS VARCHAR) AS value, count(*) AS records, count(DISTINCT p_name) AS preparations, count(*) FILTER (same AND {others}) AS conditional_records,
 count(DISTINCT p_name) FILTER (same AND {others}) AS conditional_preparations FROM b GROUP BY {axis}"""


@query(
    f"""WITH b AS (SELECT *, coalesce(band = (SELECT band FROM (SELECT p_partkey, {BAND_SQL} AS band FROM part) WHERE p_partkey = 2), false) AS same FROM (SELECT *, {BAND_SQL} AS band FROM part))
SELECT *, CASE WHEN conditional_records > 0 THEN 'supported' WHEN preparations > 0 THEN 'supported_elsewhere' ELSE 'unresolved' END AS state FROM ({refined_sql('p_type', f'{S} AND {B}')} UNION ALL {refined_sql('p_size', f'{T} AND {B}')} UNION ALL {refined_sql('p_brand', f'{T} AND {S}')})"""
)
def refined_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets where only options with the reference's band are witnesses."""
    options = banded(spark, sf_dir)
    return pool.refine(options, AXES, SELECTIONS, "p_name", options.where("p_partkey = 2"), ["band"])
