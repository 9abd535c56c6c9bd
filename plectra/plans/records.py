"""Queries over navigators, learned exclusions, resumable batches, ancestry and junction routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import composition, junction, lineage, navigation, pool, ranks, scan, stops
from ..sources.shared import shared_folder, written
from ..streaming import batches, steps as resumable
from .assemblies import ORACLE_SQL, QUERIES
from .junctions import HITS, NODES, PAIRS_SQL, ROUTE_HITS, ROUTES, ROUTES_SQL, foldback_sql, found_precursors, precursor_sql, routes, search
from .pools import AXES, SELECTIONS, STEPS_SQL, T, steps
from .sequences import FRAGMENT_SQL, lineage_fragments, query, two_sets, words_sql
from .tables import DNA_SQL, document_dna, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]

PAGES, PAGE_SIZE, PAGE_NODES = 5, 12, 150
COORDINATES = ("p_type", "p_size", "p_brand")

RANKS_SQL = ", ".join(f"r{i} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS c{i} FROM (SELECT DISTINCT {c} FROM part))" for i, c in enumerate(COORDINATES))


def ranked_parts(spark: SparkSession, sf_dir: str) -> tuple[list[int], DataFrame]:
    """The sizes of the three axes, and the parts at each coordinate."""
    parts = table(spark, sf_dir, "part")
    sizes = []
    for i, c in enumerate(COORDINATES):
        axis = parts.select(c).where(F.col(c).isNotNull()).distinct()
        sizes.append(axis.count())
        parts = parts.join(ranks.rank_within(axis, c, f"c{i}"), c)
    held = parts.groupBy("c0", "c1", "c2").agg(F.min("p_partkey").alias("p_partkey"), F.count(F.lit(1)).alias("parts"))
    return sizes, written(held, "coordinates")  # each page reads it


@query(
    f"""WITH RECURSIVE {RANKS_SQL}, g AS (SELECT c0, c1, c2, min(p_partkey) AS p_partkey, count(*) AS parts FROM part JOIN r0 USING (p_type) JOIN r1 USING (p_size) JOIN r2 USING (p_brand) GROUP BY ALL),
n AS (SELECT c0, c1, c2, c0 + c1 + c2 AS wave, row_number() OVER (ORDER BY c0 + c1 + c2, c0, c1, c2) AS o FROM r0, r1, r2), h AS (SELECT * FROM n JOIN g USING (c0, c1, c2)), l AS (SELECT list(o ORDER BY o) AS hl, (SELECT count(*) FROM n) AS total FROM h),
p(page, low, high) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL
 SELECT page + 1, high, CASE WHEN len(x) = {PAGE_SIZE} THEN x[{PAGE_SIZE}] ELSE least(high + {PAGE_NODES}, total) END FROM (SELECT page, high, total, list_filter(hl, lambda v: v > high AND v <= high + {PAGE_NODES})[1:{PAGE_SIZE}] AS x FROM p, l WHERE page < {PAGES} AND high < total))
SELECT CAST(page AS BIGINT) AS page, wave, c0, c1, c2, p_partkey, parts FROM p JOIN h ON h.o > p.low AND h.o <= p.high WHERE page > 0"""
)
def navigator_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages over types, sizes and brands by displacement, each from the cursor of the one before; sizes and brands that
    no part has together are planes proven empty."""
    sizes, held = ranked_parts(spark, sf_dir)
    plane = ["c1", "c2"]
    every = spark.range(sizes[1]).withColumnRenamed("id", "c1").crossJoin(spark.range(sizes[2]).withColumnRenamed("id", "c2"))  # two catalogues
    empty = written(every.join(held.select(*plane).distinct(), plane, "left_anti"), "planes")
    cursor, out = None, None
    for page in range(1, PAGES + 1):
        found = navigation.scan_page(spark, sizes, held, empty, plane, cursor, PAGE_SIZE, PAGE_NODES)
        rows = found.rows.select(F.lit(page).cast("long").alias("page"), "wave", "c0", "c1", "c2", "p_partkey", "parts")
        out, cursor = rows if out is None else out.unionByName(rows), found.cursor
        if cursor is None:
            break
    return out


CONTEXT, FLANK = 6, "GATC"
MOTIFS = [("m1", "GANTC"), ("m2", "CCWGG"), ("m3", "RGATCY")]
CLASSES_SQL = "(VALUES " + ", ".join(f"('{i}', '{o}', '{w}')" for i, m in MOTIFS for o, w in (("forward", m), ("reverse", scan.reverse_motif(m)))) + ") t(motif_id, orientation, motif)"
PATTERN_CLASS = "{}"
for _symbol, _bases in (("R", "AG"), ("Y", "CT"), ("W", "AT"), ("N", "ACGT")):
    PATTERN_CLASS = f"replace({PATTERN_CLASS}, '{_symbol}', '[{_bases}]')"
EXCLUSION_SQL = f"""WITH m AS (SELECT motif_id, orientation, motif FROM {CLASSES_SQL}), w AS ({words_sql('benchmark', CONTEXT)}),
x AS (SELECT word, m.*, unnest(range(0, least({CONTEXT}, {CONTEXT + len(FLANK)} - length(motif) + 1))) AS start FROM w, m),
p AS (SELECT DISTINCT rpad(repeat('N', start) || substr(motif, 1, {CONTEXT} - start), {CONTEXT}, 'N') AS pattern, motif_id, orientation, start FROM x
 WHERE regexp_full_match(substr(word || '{FLANK}', start + 1, length(motif)), {PATTERN_CLASS.format('motif')})),
d AS ({words_sql('documents', CONTEXT)})
"""


def learned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Patterns learned from the items' words, and the documents' words."""
    motifs = spark.createDataFrame(MOTIFS, "motif_id string, motif string")
    seen, later = (scan.distinct_words(df, "dna", CONTEXT) for df in (item_dna(spark, sf_dir), document_dna(spark, sf_dir)))
    return navigation.site_patterns(seen, motifs, "word", FLANK), later


@query(EXCLUSION_SQL + "SELECT pattern, motif_id, orientation, start FROM p")
def learned_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a context must not look like, from the sites seen in the items' words before a fixed flank."""
    return learned(spark, sf_dir)[0]


@query(EXCLUSION_SQL + f"SELECT word FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE regexp_full_match(d.word, {PATTERN_CLASS.format('p.pattern')}))")
def surviving_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' words that no learned pattern rules out."""
    patterns, later = learned(spark, sf_dir)
    return navigation.without_patterns(later, "word", patterns)


FIRST_RUN, SECOND_RUN, BATCH = 60, 40, 25
COVERED_SQL = f"""WITH t AS (SELECT c_custkey AS ordinal FROM customer ORDER BY c_custkey LIMIT {FIRST_RUN + SECOND_RUN}), s AS ({STEPS_SQL})
SELECT ordinal, count(*) AS steps, CAST(sum(witness) AS BIGINT) AS witnesses, max(exhausted) AS exhausted, max(step) AS last_step, arg_max(event_id, step) AS last_event,
 CASE WHEN sum(witness) > 0 THEN 'supported' WHEN max(exhausted) = 1 THEN 'excluded' ELSE 'unresolved' END AS state FROM s JOIN t USING (ordinal) GROUP BY ordinal"""


def resumed(spark: SparkSession, sf_dir: str):
    """Customers as targets, their events as evaluations: two runs into one folder, the second from where the first stopped."""
    import uuid

    folder = f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"))
    log = steps(spark, sf_dir)
    evaluate = lambda own: resumable.coverage(log.join(own, "ordinal"))
    told = [batches.advance(targets, "ordinal", evaluate, folder, "coverage-1", BATCH, n) for n in (FIRST_RUN, SECOND_RUN)]
    return folder, targets, evaluate, told


@query(COVERED_SQL)
def resumed_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two budgeted runs committed; the number of targets is their budget."""
    folder, targets, evaluate, _ = resumed(spark, sf_dir)
    return batches.committed(spark, folder, evaluate(targets).schema)


@query(
    f"""WITH c AS ({COVERED_SQL}), n AS (SELECT least(count(*), {FIRST_RUN + SECOND_RUN}) AS targets FROM customer)
SELECT targets, CAST(ceil(least(targets, {FIRST_RUN}) / {BATCH}) + ceil(greatest(targets - {FIRST_RUN}, 0) / {BATCH}) AS BIGINT) AS batches, (SELECT count(*) FROM c) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected,
 CASE WHEN targets = {FIRST_RUN + SECOND_RUN} THEN 'evaluation_budget' ELSE 'exhausted_enumeration' END AS reason FROM n"""
)
def replay_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every committed batch checked against its manifest, and all of them against a new evaluation."""
    folder, targets, evaluate, told = resumed(spark, sf_dir)
    n = batches.verify(spark, folder)
    changed = batches.recomputed(targets, "ordinal", evaluate, folder)
    rows = batches.committed(spark, folder, evaluate(targets).schema).agg(F.count(F.lit(1)).alias("rows"))
    sides = changed.agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "unexpected").alias("unexpected"))
    facts = [F.lit(told[-1].targets).cast("long").alias("targets"), F.lit(n).cast("long").alias("batches")]
    return rows.crossJoin(sides).select(*facts, "rows", "missing", "unexpected", F.lit(told[-1].reason).alias("reason"))  # one row each


PARTS_SQL = "SELECT user_id % 4 AS part, 'a' AS request, 1 AS effort, user_id AS ordinal FROM events"
TYPES_SQL = "SELECT event_type AS part, 'a' AS request, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS effort, user_id AS ordinal FROM events"


def admission_sql(parts: str, targets: str) -> str:
    return f"""SELECT (SELECT count(DISTINCT part) FROM ({parts})) AS parts, count(*) FILTER (held > 1) AS overlaps, count(*) FILTER (d IS NULL) AS undeclared, count(*) FILTER (held IS NULL) AS missing,
 concat_ws(',', CASE WHEN (SELECT count(DISTINCT part) FROM ({parts})) < 2 THEN 'too_few' END, CASE WHEN (SELECT count(DISTINCT request) FROM ({parts})) > 1 THEN 'mixed_request' END, CASE WHEN (SELECT count(DISTINCT effort) FROM ({parts})) > 1 THEN 'mixed_effort' END,
  CASE WHEN count(*) FILTER (held > 1) > 0 THEN 'overlapping' END, CASE WHEN count(*) FILTER (d IS NULL) > 0 THEN 'undeclared' END, CASE WHEN count(*) FILTER (held IS NULL) > 0 THEN 'incomplete' END) AS refused
FROM (SELECT ordinal, 1 AS d FROM ({targets})) FULL JOIN (SELECT ordinal, count(DISTINCT part) AS held FROM ({parts}) GROUP BY ordinal) USING (ordinal)"""


USERS_SQL = "SELECT DISTINCT user_id AS ordinal FROM events"


@query(
    f"SELECT 'remainder' AS name, * FROM ({admission_sql(PARTS_SQL, USERS_SQL)}) UNION ALL SELECT 'type', * FROM ({admission_sql(TYPES_SQL, USERS_SQL)})"
    f" UNION ALL SELECT 'customers', * FROM ({admission_sql(PARTS_SQL, 'SELECT c_custkey AS ordinal FROM customer')})"
)
def partition_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways to part the users: by remainder, by type of event, and by remainder against the customers as declared targets."""
    events = table(spark, sf_dir, "events")
    users = events.select(F.col("user_id").alias("ordinal")).distinct()
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"))
    base = events.select(F.lit("a").alias("request"), F.col("user_id").alias("ordinal"), "event_type", F.lit(1).alias("effort"))
    by_rest = base.withColumn("part", F.col("ordinal") % 4)
    by_type = base.withColumn("part", F.col("event_type")).withColumn("effort", F.when(F.col("event_type") == "view", 2).otherwise(1))
    cases = (("remainder", by_rest, users), ("type", by_type, users), ("customers", by_rest, customers))
    told = [batches.admission(parts, targets).select(F.lit(name).alias("name"), "*") for name, parts, targets in cases]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query(f"WITH s AS ({STEPS_SQL}) SELECT ordinal % 4 AS part, count(DISTINCT ordinal) AS targets, count(*) AS steps FROM s GROUP BY ALL")
def partition_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of admitted partitions, put together."""
    rows = steps(spark, sf_dir).withColumn("part", F.col("ordinal") % 4)
    parts = rows.select("part", F.lit("a").alias("request"), F.lit(1).alias("effort"), "ordinal")
    whole = batches.united(parts, rows, rows.select("ordinal").distinct())
    return whole.groupBy("part").agg(F.countDistinct("ordinal").alias("targets"), F.count(F.lit(1)).alias("steps"))


#: Every second top fragment of an item is turned round; a base's origin is its place in the item.
ASSEMBLED_SQL = f"""WITH f AS (SELECT item_id, start, "end" AS stop, row_number() OVER (PARTITION BY item_id ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY item_id) AS n FROM ({FRAGMENT_SQL}) WHERE strand = 'top'),
o AS (SELECT *, unnest(range(start, stop)) AS origin FROM f), t AS (SELECT item_id, CASE WHEN k % 2 = 1 THEN start + stop - 1 - origin ELSE origin END AS index, origin, k, n, start, stop FROM o),
s AS (SELECT *, CASE WHEN abs(origin - lag(origin) OVER w) = 1 THEN origin - lag(origin) OVER w END AS step FROM t WINDOW w AS (PARTITION BY item_id ORDER BY index)),
r AS (SELECT *, sum(CASE WHEN step IS NULL OR (before IS NOT NULL AND before <> step) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY index) AS run FROM (SELECT *, lag(step) OVER (PARTITION BY item_id ORDER BY index) AS before FROM s))
"""


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, index, origin, k, n, start, stop) of the items' bases after every second top fragment is turned."""
    top = lineage_fragments(spark, sf_dir).where("strand = 'top'").select("item_id", F.col("start").cast("long"), F.col("end").cast("long").alias("stop"))
    numbered = ranks.rank_within(top, "start", "k", "item_id")
    sizes = top.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    bases = numbered.join(sizes, "item_id").withColumn("origin", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    index = F.when(F.col("k") % 2 == 1, F.col("start") + F.col("stop") - 1 - F.col("origin")).otherwise(F.col("origin"))
    return bases.select("item_id", index.alias("index"), "origin", "k", "n", "start", "stop")


@query(ASSEMBLED_SQL + "SELECT item_id, min(index) AS start, count(*) AS length, arg_min(origin, index) AS first_origin, CAST(sign(arg_max(origin, index) - arg_min(origin, index)) AS INTEGER) AS direction FROM r GROUP BY item_id, run")
def ancestry_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of an assembled item whose origins run on, forward or backward."""
    return lineage.islands(assembled(spark, sf_dir), ["item_id"], "index", "origin")


@query(
    ASSEMBLED_SQL
    + f""", a AS (SELECT DISTINCT item_id, spot AS first, spot + 3 AS last FROM (SELECT item_id, dna, unnest(range(0, length(dna) - 3)) AS spot FROM (SELECT item_id, {DNA_SQL} AS dna FROM benchmark) WHERE length(dna) >= 4) WHERE spot % 4 = 0)
SELECT item_id, first, last, least(x.index, y.index) AS start, greatest(x.index, y.index) + 1 AS stop, CAST(sign(y.index - x.index) AS INTEGER) AS direction
FROM a JOIN r x USING (item_id) JOIN r y USING (item_id) WHERE x.origin = first AND y.origin = last AND x.run = y.run AND abs(y.index - x.index) = 3"""
)
def span_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which quartets of an item's bases stand whole in the assembled one, turned round or not; a cut quartet has no place."""
    anchors = lineage.bases(item_dna(spark, sf_dir), ["item_id"], "dna").where("index % 4 = 0")
    long_enough = item_dna(spark, sf_dir).select("item_id", F.length("dna").alias("n_nt"))
    whole = anchors.join(long_enough, "item_id").where("index + 4 <= n_nt")
    spans = whole.select("item_id", F.col("index").cast("long").alias("first"), (F.col("index") + 3).cast("long").alias("last"))
    return lineage.span_locations(spans, assembled(spark, sf_dir), ["item_id"], "index", "origin")


@query(
    ASSEMBLED_SQL
    + """, b AS (SELECT item_id, origin AS index, origin FROM t), c AS (SELECT item_id, index, origin FROM t WHERE k < n - 1 OR n = 1 UNION ALL SELECT item_id, 1000000 + index, origin FROM t WHERE k = 0 AND n > 1),
x AS (SELECT item_id, origin, min(index) AS reference, count(*) AS n1 FROM b GROUP BY ALL), y AS (SELECT item_id, origin, min(index) AS target, count(*) AS n2 FROM c GROUP BY ALL),
z AS (SELECT item_id, origin, reference, target, CASE WHEN n2 IS NULL THEN 'unmapped_reference' WHEN n1 IS NULL THEN 'unmapped_target' WHEN n1 = 1 AND n2 = 1 THEN 'retained' ELSE 'repeated' END AS relation FROM x FULL JOIN y USING (item_id, origin))
SELECT item_id, origin, CASE WHEN relation = 'retained' THEN reference END AS reference, CASE WHEN relation = 'retained' THEN target END AS target, relation FROM z"""
)
def inspection_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's bases against its assembly without the last fragment and with the first one twice."""
    made = assembled(spark, sf_dir)
    before = made.select("item_id", F.col("origin").alias("index"), "origin")
    kept = made.where("k < n - 1 OR n = 1").select("item_id", "index", "origin")
    again = made.where("k = 0 AND n > 1").select("item_id", (F.col("index") + 1000000).alias("index"), "origin")
    return lineage.correspondence(before, kept.unionByName(again), ["item_id"], "index", "origin")


@query(f"WITH a AS ({words_sql('documents', 6)}), b AS ({words_sql('benchmark', 6)}) SELECT word, word IN (SELECT word FROM a) AS contained FROM b")
def set_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each word of the items, whether the documents' words contain it."""
    held, asked = two_sets(spark, sf_dir)
    return asked.join(held.withColumn("_held", F.lit(True)), "word", "left").select("word", F.coalesce("_held", F.lit(False)).alias("contained"))


@query(foldback_sql("bottom") + "SELECT code, count(*) AS nodes FROM (SELECT unnest(string_split(blockers, ',')) AS code FROM told WHERE blockers <> '') GROUP BY code")
def released_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examined geometries each blocker was given to."""
    rows = search(spark, sf_dir).examined.withColumn("_all", F.lit(0))
    return stops.rejections(rows, ["_all"], "blockers").select("code", "nodes")


JUNCTION_NODES, JUNCTION_HITS = 20_000, 500
PRECURSOR_KEY = "{0} || '|' || {1} || '|' || {2} || '|' || lpad(CAST({3} AS VARCHAR), 6, '0') || '|' || lpad(CAST({4} AS VARCHAR), 6, '0')"
JUNCTION_SQL = f"""WITH pre AS (SELECT {PRECURSOR_KEY.format('nick_id', 'release_id', 'orientation', 'boundary', 'x + 1')} AS precursor_key, precursor FROM ({precursor_sql('bottom')} SELECT nick_id, release_id, orientation, boundary, x, precursor FROM words JOIN nodes USING (ordinal)) WHERE precursor IS NOT NULL),
rts AS (SELECT hit, scar, geometry_id, CASE nicked WHEN 'top' THEN 'bottom' ELSE 'top' END AS surviving FROM ({PAIRS_SQL}{ROUTES_SQL} SELECT * FROM e JOIN h USING (ordinal))),
p AS (SELECT *, row_number() OVER (ORDER BY precursor_key) - 1 AS i FROM pre), n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM rts) AS nr),
x AS (SELECT i * nr + hit - 1 AS ordinal, precursor_key, precursor, hit AS route, scar, geometry_id, CASE WHEN surviving <> 'bottom' THEN 'continuous_strand_mismatch' END AS blocker FROM p, rts, n WHERE i * nr + hit - 1 < {JUNCTION_NODES})
"""


def junction_pairs(spark: SparkSession, sf_dir: str):
    """Precursors by basal routes in order, up to a node budget, and the states of both searches that feed them."""
    key = F.concat_ws("|", "nick_id", "release_id", "orientation", F.lpad(F.col("boundary").cast("string"), 6, "0"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
    every = found_precursors(spark, sf_dir, "bottom")
    pre = written(every.where("precursor IS NOT NULL").select(key.alias("precursor_key"), "precursor"), "precursors")
    found = routes(spark, sf_dir)
    basal = written(found.hits.select(F.col("hit").cast("long").alias("route"), "scar", "geometry_id", "surviving"), "routes")
    nodes = composition.product_nodes({"precursor_key": pre.select("precursor_key"), "route": basal.select("route")}, JUNCTION_NODES)
    pairs = nodes.join(pre, "precursor_key").join(basal, "route")
    blocker = F.when(F.col("surviving") != "bottom", "continuous_strand_mismatch")
    return pairs.withColumn("blocker", blocker), found


@query(JUNCTION_SQL + f"SELECT ordinal, precursor_key, precursor, route, scar, geometry_id, blocker, CASE WHEN blocker IS NULL AND place <= {JUNCTION_HITS} THEN place END AS hit FROM (SELECT *, row_number() OVER (PARTITION BY blocker IS NULL ORDER BY ordinal) AS place FROM x)")
def junction_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every examined pair of a precursor and a route, with its blocker; compatible ones are numbered up to the hit budget."""
    pairs, _ = junction_pairs(spark, sf_dir)
    numbered = ranks.rank_within(pairs.where("blocker IS NULL").select("ordinal"), "ordinal", "hit").where(F.col("hit") < JUNCTION_HITS)
    rows = pairs.join(numbered.withColumn("hit", F.col("hit") + 1), "ordinal", "left")
    return rows.select("ordinal", "precursor_key", "precursor", "route", "scar", "geometry_id", "blocker", F.col("hit").cast("long").alias("hit"))


@query(
    JUNCTION_SQL
    + f""", g AS ({foldback_sql('bottom')} SELECT (SELECT count(*) FROM n0) > {NODES} OR count(*) FILTER (blockers = '') > {HITS} AS cut FROM told), q AS ({PAIRS_SQL}{ROUTES_SQL} SELECT (SELECT count(*) FROM q) > {ROUTES} OR (SELECT count(*) FROM e WHERE NOT outside AND NOT held) > {ROUTE_HITS} AS cut),
c AS (SELECT (SELECT np * nr FROM n) AS available, count(*) AS examined, count(*) FILTER (blocker IS NULL) AS observed, least(count(*) FILTER (blocker IS NULL), {JUNCTION_HITS}) AS returned FROM x),
u AS (SELECT *, concat_ws(',', CASE WHEN (SELECT cut FROM g) THEN 'released_precursors' END, CASE WHEN (SELECT cut FROM q) THEN 'basal_routes' END, CASE WHEN examined < available THEN 'max_search_nodes' END, CASE WHEN observed > {JUNCTION_HITS} THEN 'max_hits' END) AS truncated_by FROM c)
SELECT *, CASE WHEN truncated_by <> '' THEN 'truncated' WHEN returned > 0 THEN 'complete' ELSE 'infeasible' END AS status FROM u"""
)
def junction_route_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both budgets, and whether what the pairs are made of was itself cut."""
    pairs, found = junction_pairs(spark, sf_dir)
    upstream = search(spark, sf_dir).summary.select((F.col("status") == "truncated").alias("_p")).crossJoin(found.summary.select((F.col("status") == "truncated").alias("_r")))
    return junction.pair_accounting(pairs, upstream, JUNCTION_HITS)


DOMAIN_PAGE = 20


@query(
    f"""WITH d AS (SELECT i AS value, i // {DOMAIN_PAGE} AS page FROM range(0, 61) t(i)), b AS (SELECT p_size AS value, ({T}) AS t, p_brand IN ({','.join(f"'{x}'" for x in SELECTIONS['p_brand']['values'])}) AS b FROM part),
f AS (SELECT value, count(*) FILTER (t AND b) AS matching, count(*) AS complete, concat_ws(',', CASE WHEN count(*) FILTER (NOT b) > 0 THEN 'p_brand' END, CASE WHEN count(*) FILTER (NOT t) > 0 THEN 'p_type' END) AS blocked_by FROM b GROUP BY value)
SELECT value, page, CASE WHEN matching > 0 THEN 'supported' WHEN complete > 0 THEN 'blocked_by_selections' ELSE 'no_complete_preparation_recorded' END AS status, coalesce(matching, 0) AS matching, coalesce(complete, 0) AS complete, coalesce(blocked_by, '') AS blocked_by FROM d LEFT JOIN f USING (value)"""
)
def parameter_domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every permitted size in pages, and whether parts support it under the other selections."""
    declared = spark.range(61).select(F.col("id").alias("value"), F.col("id").alias("rank"))
    return pool.parameter_page(table(spark, sf_dir, "part"), "p_size", declared, SELECTIONS, DOMAIN_PAGE)


@query(
    "WITH e AS (SELECT * FROM part WHERE " + T + f" AND p_size BETWEEN 5 AND 30 AND p_brand IN ({','.join(repr(x) for x in SELECTIONS['p_brand']['values'])})), "
    "o AS (SELECT DISTINCT 'p_type' AS axis, p_type AS value FROM e UNION SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM e UNION SELECT DISTINCT 'p_brand', p_brand FROM e), "
    "d AS (SELECT 'p_type' AS axis, x AS value FROM (VALUES ('ECONOMY'), ('SMALL'), ('LARGE')) t(x) UNION ALL SELECT 'p_size', CAST(i AS VARCHAR) FROM range(5, 31) t(i)), "
    "b AS (SELECT axis, value, o.value IS NOT NULL AS seen, d.value IS NOT NULL AS asked FROM o FULL JOIN d USING (axis, value)) "
    "SELECT a AS axis, count(*) FILTER (seen) AS observed, count(value) AS offered, count(value) > 1 AS varying, count(*) FILTER (seen) > 1 AS observed_variation, count(*) FILTER (asked) = 1 AS fixed_by_request, "
    "CASE WHEN count(*) FILTER (asked) > 0 THEN 'declared' ELSE 'observed_only' END AS domain_status FROM (VALUES ('p_type'), ('p_size'), ('p_brand')) t(a) LEFT JOIN b ON b.axis = a GROUP BY a"
)
def choice_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each axis offers: the values of passing parts and those that the request declares."""
    declared = [("p_type", t) for t in SELECTIONS["p_type"]["values"]] + [("p_size", str(i)) for i in range(5, 31)]
    return pool.choice_axes(table(spark, sf_dir, "part"), AXES, SELECTIONS, spark.createDataFrame(declared, "axis string, value string"))


@query(
    """WITH c AS (SELECT p_name, p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT p_name, string_agg(p_type || '|' || p_brand || '|' || n, ';' ORDER BY p_type, p_brand) AS f, count(*) AS features, CAST(sum(n) AS BIGINT) AS records,
 sum(CAST(('0x' || substr(sha256(p_type || '|' || p_brand || '|' || n), 1, 12)) AS BIGINT)) AS s FROM c GROUP BY p_name)
SELECT sha256(any_value(features) || '|' || any_value(s)) AS family_id, count(*) AS products, CAST(sum(records) AS BIGINT) AS records, min(p_name) AS first_product FROM p GROUP BY f"""
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the multiset of their types and brands."""
    return pool.feature_families(table(spark, sf_dir, "part"), "p_name", ["p_type", "p_brand"])
