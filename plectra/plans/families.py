"""Queries over rosters and their revisions, matching under one budget, edited declarations, located measures, product stages, flat files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import families, lineage
from ..sources.genbank import FEATURE, genbank_text
from ..sources.shared import written
from .contexts import ORACLE_SQL, QUERIES
from .records import ASSEMBLED_SQL, assembled
from .sequences import query
from .tables import DNA_SQL, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(
    """WITH base AS (SELECT p_brand, CAST(median_size AS BIGINT) AS size, kind FROM (SELECT p_brand, max(p_size) AS median_size, min(p_type) AS kind FROM part GROUP BY p_brand)),
roster AS (SELECT p_brand, p_name, CASE WHEN count(DISTINCT p_size) = 1 THEN CAST(min(p_size) AS BIGINT) END AS size, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS kind FROM part GROUP BY ALL),
x AS (SELECT p_brand, p_name, coalesce(r.size, b.size) AS size, coalesce(r.kind, b.kind) AS kind, (r.size IS NOT NULL)::INT + (r.kind IS NOT NULL)::INT AS "set" FROM roster r JOIN base b USING (p_brand)),
o AS (SELECT p_brand, p_size AS size, p_type AS kind, count(*) AS n, min(p_partkey) AS f FROM part WHERE p_partkey < (SELECT max(p_partkey) / 2 FROM part) GROUP BY ALL)
SELECT p_brand, p_name, x.size, x.kind, "set", coalesce(n, 0) AS outcomes, f AS "first", CASE WHEN n > 0 THEN 'found' ELSE 'missing' END AS status FROM x LEFT JOIN o USING (p_brand, size, kind)"""
)
def roster_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand with their own size and type where they have one of each, else the brand's, against the first half of the parts; missing ones stay."""
    parts = table(spark, sf_dir, "part").withColumns({"size": F.col("p_size").cast("long"), "kind": F.col("p_type")})
    only = lambda c: F.when(F.countDistinct(c) == 1, F.min(c)).alias(c)
    roster = parts.groupBy("p_brand", "p_name").agg(only("size"), only("kind"))
    base = parts.groupBy("p_brand").agg(F.max("size").alias("size"), F.min("kind").alias("kind"))
    half = parts.agg((F.max("p_partkey") / 2).alias("_half"))  # one row
    outcomes = parts.crossJoin(F.broadcast(half)).where("p_partkey < _half").select("p_brand", "size", "kind", "p_partkey")
    return families.with_outcomes(families.expanded(roster, base, "p_brand", "p_name"), outcomes, ["p_brand", "size", "kind"], "p_partkey")


FAMILY_BUDGET = 700


@query(
    f"""WITH ref AS (SELECT p_name AS rn, p_brand AS rb, p_type AS rt FROM part ORDER BY p_partkey LIMIT 1), c AS (SELECT p_name, p_partkey, (p_brand <> rb)::INT + (p_type <> rt)::INT AS d, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part, ref WHERE p_name <> rn),
s AS (SELECT p_name, count(*) AS recorded FROM c GROUP BY 1), q AS (SELECT p_name, recorded, greatest(0, least(recorded, {FAMILY_BUDGET} - coalesce(sum(recorded) OVER (ORDER BY p_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS evaluated FROM s)
SELECT p_name, recorded, CAST(evaluated AS BIGINT) AS evaluated, CAST(recorded - evaluated AS BIGINT) AS unexamined, count(*) FILTER (r <= evaluated AND d = 0) AS same, min(p_partkey) FILTER (r <= evaluated AND d = 0) AS first_same, CAST(coalesce(sum(d) FILTER (r <= evaluated), 0) AS BIGINT) AS differences FROM q JOIN c USING (p_name) GROUP BY p_name, recorded, evaluated"""
)
def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name but the first part's, each looking among its parts for that part's brand and type, all under one budget."""
    parts = table(spark, sf_dir, "part")
    first = parts.orderBy("p_partkey").limit(1)
    name = first.first().p_name
    return families.family_coverage(parts.select("p_name", "p_partkey", "p_brand", "p_type"), "p_name", "p_partkey", name, ["p_brand", "p_type"], first.select("p_brand", "p_type"), FAMILY_BUDGET)


def roster_sql(cut: str) -> str:
    return f"SELECT o_custkey, o_orderpriority AS member, min(o_orderstatus) AS request FROM orders WHERE o_orderdate < DATE '{cut}' GROUP BY ALL"


BEFORE, AFTER = "1997-01-01", "1997-07-01"


@query(
    f"""WITH a AS ({roster_sql(BEFORE)}), b AS ({roster_sql(AFTER)}), k AS (SELECT o_custkey, min(o_orderpriority) AS source, max_by(o_orderpriority, o_orderkey) AS target FROM orders WHERE o_orderdate < DATE '{AFTER}' GROUP BY 1),
j AS (SELECT o_custkey, member, a.request AS was, b.request AS asks, a.member IS NOT NULL AS old, b.member IS NOT NULL AS new FROM (SELECT *, member AS m FROM a) a FULL JOIN (SELECT *, member AS m FROM b) b USING (o_custkey, member)),
f AS (SELECT o_custkey, source, target, count(*) FILTER (old AND new AND was = asks) AS kept, bool_or(old AND member = source) AS known, bool_or((old AND NOT new) OR (new AND NOT old AND member <> target)) OR NOT bool_or(new AND member = target) AS lost,
 bool_or(old AND member = target) AS taken, bool_or(old AND new AND was <> asks) AS changed, max(was) FILTER (member = source) AS s, max(asks) FILTER (member = target) AS t FROM j JOIN k USING (o_custkey) GROUP BY ALL)
SELECT o_custkey, CASE WHEN source <> target THEN 'edit' ELSE 'continuation' END AS kind, kept, concat_ws(',', CASE WHEN NOT known THEN 'unknown_source' END, CASE WHEN lost THEN 'roster_not_kept' END, CASE WHEN source <> target AND taken THEN 'target_exists' END,
 CASE WHEN changed THEN 'changed_request' END, CASE WHEN source <> target AND known AND t IS NOT NULL AND s = t THEN 'unchanged_edit' END) AS faults FROM f"""
)
def family_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' priorities as rosters at two dates; each revision goes from the least priority to that of the latest order's number."""
    orders = table(spark, sf_dir, "orders").withColumn("member", F.col("o_orderpriority"))
    roster = lambda cut: orders.where(F.col("o_orderdate") < F.lit(cut).cast("date")).groupBy("o_custkey", "member").agg(F.min("o_orderstatus").alias("request"))
    asked = orders.where(F.col("o_orderdate") < F.lit(AFTER).cast("date")).groupBy("o_custkey").agg(F.min("member").alias("source"), F.max_by("member", "o_orderkey").alias("target"))
    return families.revisions(roster(BEFORE), roster(AFTER), asked, "o_custkey", "member", "request")


@query(
    """WITH p AS (SELECT p_brand, p_name, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_type <> 'ECONOMY' GROUP BY ALL), q AS (SELECT p_brand, p_name, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY ALL),
j AS (SELECT p_brand, p_name, greatest(p.lo, q.lo) AS l, least(p.hi, q.hi) AS g, q.lo IS NULL AS silent FROM p FULL JOIN q USING (p_brand, p_name))
SELECT p_brand, p_name, CAST(CASE WHEN l <= g THEN l END AS BIGINT) AS least, CAST(CASE WHEN l <= g THEN g END AS BIGINT) AS greatest, CASE WHEN silent THEN 'context' ELSE 'user_within_context' END AS provenance, l > g AS conflict FROM j"""
)
def narrowed_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a brand's names that two ranges of types both hold, with where each range comes from."""
    parts = table(spark, sf_dir, "part")
    sides = [parts.where(test).groupBy("p_brand", "p_name").agg(F.min("p_size").cast("long").alias("least"), F.max("p_size").cast("long").alias("greatest")) for test in ("p_type <> 'ECONOMY'", "p_type IN ('ECONOMY', 'SMALL')")]
    return families.narrowed(*sides, ["p_brand", "p_name"])


@query(
    """WITH d AS (SELECT p_brand, p_name AS path, CASE WHEN count(*) % 2 = 0 THEN 'choice' ELSE 'list' END AS kind, list_sort(list_distinct(list(p_type))) AS v FROM part WHERE p_partkey < (SELECT max(p_partkey) / 2 FROM part) GROUP BY ALL),
e AS (SELECT p_brand, p_name AS path, list_sort(list_distinct(list(p_type))) AS a FROM part WHERE p_partkey >= (SELECT max(p_partkey) / 2 FROM part) GROUP BY ALL),
o AS (SELECT p_brand, path, v, a, CASE WHEN kind IS NULL THEN 'not_declared' WHEN kind = 'choice' AND len(a) <> 1 THEN 'choose_one' WHEN v = a THEN 'same' ELSE 'changed' END AS outcome FROM e LEFT JOIN d USING (p_brand, path))
SELECT p_brand, path, array_to_string(v, ',') AS "before", array_to_string(CASE WHEN outcome = 'changed' THEN a ELSE v END, ',') AS "after", outcome FROM o"""
)
def edited_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that a brand's names have in the first half of the parts, edited to those of the second; names of an even count take one type."""
    parts = table(spark, sf_dir, "part")
    half = F.broadcast(parts.agg((F.max("p_partkey") / 2).alias("_half")))  # one row
    side = lambda test: parts.crossJoin(half).where(test).groupBy("p_brand", F.col("p_name").alias("path")).agg(F.collect_set("p_type").alias("values"), F.count(F.lit(1)).alias("n"))
    declared = side("p_partkey < _half").withColumn("kind", F.when(F.col("n") % 2 == 0, "choice").otherwise("list")).drop("n")
    return families.edited_declarations(declared, side("p_partkey >= _half").drop("n"), ["p_brand"])


@query(
    """WITH r AS (SELECT DISTINCT p_brand, p_name AS name FROM part UNION SELECT DISTINCT p_brand, 'no ' || p_type FROM part), c AS (SELECT p_name AS name, count(DISTINCT p_size % 2) AS n, min(p_size % 2) AS id FROM part WHERE p_retailprice < 920 GROUP BY 1),
b AS (SELECT DISTINCT p_brand, p_size % 2 AS id, true AS barred FROM part WHERE p_type = 'ECONOMY' AND p_size > 45),
o AS (SELECT p_brand, name, c.id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN barred THEN 'barred' ELSE 'resolved' END AS outcome FROM r LEFT JOIN c USING (name) LEFT JOIN b USING (p_brand, id))
SELECT p_brand, name, CAST(CASE WHEN outcome = 'resolved' THEN id END AS BIGINT) AS method_id, outcome FROM o"""
)
def resolved_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that brands ask for, as numbers of methods; cheap parts are the catalogue, large sizes of one type are barred."""
    parts = table(spark, sf_dir, "part").withColumn("method_id", F.col("p_size").cast("long") % 2)
    requests = parts.select("p_brand", F.explode(F.array("p_name", F.concat(F.lit("no "), "p_type"))).alias("name"))
    catalogue = parts.where("p_retailprice < 920").select(F.col("p_name").alias("name"), "method_id")
    barred = parts.where("p_type = 'ECONOMY' AND p_size > 45").select("p_brand", "method_id")
    return families.resolved_methods(requests, catalogue, barred, ["p_brand"])


STATES_SQL = ASSEMBLED_SQL + f""", sized AS (SELECT item_id, length({DNA_SQL}) AS m FROM benchmark), b AS (SELECT item_id, 'source' AS state, origin AS index, origin FROM t UNION ALL SELECT item_id, 'assembled', index, origin FROM t UNION ALL SELECT item_id, 'copied', m - 1 - origin, origin FROM t JOIN sized USING (item_id)
 UNION ALL SELECT item_id, 'copied', m + origin, origin FROM t JOIN sized USING (item_id) WHERE k = 0)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, state, index, origin, k, n, start, stop): items as they are, with fragments turned, and backwards with the first fragment once more behind."""
    rows = written(assembled(spark, sf_dir), "assembled")  # four states and their joins read it
    sizes = item_dna(spark, sf_dir).select("item_id", F.length("dna").cast("long").alias("m"))
    source = rows.withColumns({"state": F.lit("source"), "index": F.col("origin")})
    copied = rows.join(sizes, "item_id").withColumn("state", F.lit("copied"))
    back = copied.withColumn("index", F.col("m") - 1 - F.col("origin")).drop("m")
    again = copied.where("k = 0").withColumn("index", F.col("m") + F.col("origin")).drop("m")
    return source.unionByName(rows.withColumn("state", F.lit("assembled"))).unionByName(back).unionByName(again)


@query(
    STATES_SQL
    + """, ms AS (SELECT item_id, measure FROM (SELECT DISTINCT item_id FROM benchmark), (SELECT DISTINCT p_size AS measure FROM part)), ref AS (SELECT item_id, measure, b.origin FROM ms JOIN b USING (item_id) WHERE state = 'source' AND index BETWEEN 2 * measure AND 2 * measure + 4),
g AS (SELECT item_id, measure, state, count(*) AS places, min(index) AS first, max(index) AS last FROM ref JOIN b USING (item_id, origin) GROUP BY ALL)
SELECT item_id, CAST(measure AS BIGINT) AS measure, state, coalesce(places, 0) AS places, CAST(first AS BIGINT) AS "first", CAST(last AS BIGINT) AS "last" FROM ms LEFT JOIN g USING (item_id, measure)"""
)
def measure_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where five bases from twice a part's size on stand in every state of an item; measures beyond an item's end have no extent."""
    bases = states(spark, sf_dir).select("item_id", "state", "index", "origin")
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("measure")).distinct()
    # The catalogue of sizes, for each item.
    measures = item_dna(spark, sf_dir).select("item_id").distinct().crossJoin(sizes)
    places = measures.select("item_id", "measure", F.lit("source").alias("state"), F.explode(F.sequence(2 * F.col("measure"), 2 * F.col("measure") + 4)).alias("index"))
    return families.measure_occurrences(measures, places, bases, ["item_id"])


@query(
    STATES_SQL
    + """, cut AS (SELECT DISTINCT item_id, start - 1 AS before, start AS after FROM t WHERE start > 0), n AS (SELECT item_id, max(origin) AS e FROM t GROUP BY 1),
an AS (SELECT item_id, 'cut' || after AS anchor, before, after FROM cut UNION ALL SELECT DISTINCT item_id, 'end' || (stop - 1), stop - 1, CASE WHEN stop - 1 < e THEN stop END FROM t JOIN n USING (item_id) WHERE k = 0 UNION ALL SELECT item_id, 'begin0', NULL, 0 FROM n),
nb AS (SELECT l.item_id, l.state, r.index AS boundary, l.origin AS l, r.origin AS r FROM b l JOIN b r ON l.item_id = r.item_id AND l.state = r.state AND r.index = l.index + 1)
SELECT item_id, anchor, state, boundary, CASE WHEN l = before THEN 1 ELSE -1 END AS direction FROM an JOIN nb USING (item_id) WHERE (l = before AND r = after) OR (l = after AND r = before)"""
)
def boundary_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an item's cuts still lie between the same two bases; ends of the first fragments are told by their last base alone and take the cut beside it."""
    rows = states(spark, sf_dir)
    own = rows.where("state = 'source'")
    cuts = own.where("start > 0").select("item_id", (F.col("start") - 1).alias("before"), F.col("start").alias("after")).distinct()
    ends = own.where("k = 0").select("item_id", F.concat(F.lit("end"), F.col("stop") - 1).alias("anchor"), (F.col("stop") - 1).alias("before"), F.lit(None).cast("long").alias("after")).distinct()
    begins = own.select("item_id", F.lit("begin0").alias("anchor"), F.lit(None).cast("long").alias("before"), F.lit(0).cast("long").alias("after")).distinct()
    anchors = cuts.select("item_id", F.concat(F.lit("cut"), "after").alias("anchor"), "before", "after").unionByName(ends).unionByName(begins)
    return families.boundary_occurrences(anchors, cuts, rows.select("item_id", "state", "index", "origin"), ["item_id"])


@query(
    STATES_SQL
    + """, z AS (SELECT item_id, max(origin) + 1 AS m FROM t GROUP BY 1), po AS (SELECT item_id, origin, CASE WHEN index < m // 8 THEN 'open' WHEN index < 3 * m // 8 OR index >= 5 * m // 8 THEN 'stem' ELSE 'closing' END AS region FROM (SELECT item_id, index, origin FROM t UNION ALL SELECT item_id, 0, origin FROM t WHERE origin % 10 = 9) JOIN z USING (item_id)),
rg AS (SELECT item_id, origin, count(DISTINCT region) AS c, min(region) AS region FROM po GROUP BY ALL),
sd AS (SELECT item_id, 0 AS strand, origin AS index, origin FROM t UNION ALL SELECT item_id, 1, m - 1 - origin, origin FROM t JOIN z USING (item_id)),
pr AS (SELECT item_id, origin AS top, m - 1 - origin + CASE WHEN item_id % 5 = 4 AND origin = 3 THEN 1 ELSE 0 END AS bottom FROM t JOIN z USING (item_id) WHERE item_id % 5 <> 3),
fr AS (SELECT item_id, min(top + bottom) AS lo, max(top + bottom) AS hi FROM pr GROUP BY 1), pd AS (SELECT item_id, lo, CASE WHEN lo IS NULL THEN 'no_paired_duplex' WHEN lo <> hi THEN 'no_single_frame' END AS reason FROM z LEFT JOIN fr USING (item_id))
SELECT item_id, strand, index, CAST(CASE WHEN strand = 0 THEN index ELSE lo - index END AS BIGINT) AS "column", CASE WHEN c = 1 THEN region ELSE 'unmapped' END AS region, reason FROM sd JOIN pd USING (item_id) LEFT JOIN rg USING (item_id, origin) WHERE reason IS NULL
UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, reason FROM pd WHERE reason IS NOT NULL"""
)
def product_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of an item's duplex with the region of the assembled item they come from; every tenth base stands in two, some duplexes have no frame."""
    rows = written(assembled(spark, sf_dir).select("item_id", "index", "origin"), "assembled")
    sizes = rows.groupBy("item_id").agg((F.max("origin") + 1).alias("m"))
    whole = rows.join(sizes, "item_id")
    region = F.when(F.col("index") < F.floor(F.col("m") / 8), "open").when((F.col("index") < F.floor(3 * F.col("m") / 8)) | (F.col("index") >= F.floor(5 * F.col("m") / 8)), "stem").otherwise("closing")
    portrait = whole.unionByName(whole.where("origin % 10 = 9").withColumn("index", F.lit(0).cast("long"))).select("item_id", "origin", region.alias("region"))
    top = whole.select("item_id", F.lit(0).alias("strand"), F.col("origin").alias("index"), "origin")
    bottom = whole.select("item_id", F.lit(1).alias("strand"), (F.col("m") - 1 - F.col("origin")).alias("index"), "origin")
    shift = F.when((F.col("item_id") % 5 == 4) & (F.col("origin") == 3), 1).otherwise(0)
    pairs = whole.where("item_id % 5 <> 3").select("item_id", F.col("origin").alias("top"), (F.col("m") - 1 - F.col("origin") + shift).alias("bottom"))
    return families.product_stages(portrait, top.unionByName(bottom), pairs, "item_id")


@query(
    """WITH c AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 - c_custkey FROM customer), s AS (SELECT l_orderkey AS o_orderkey, l_linenumber, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS place FROM s), k AS (SELECT c.*, CASE WHEN o_orderstatus IS NULL THEN 'unknown' WHEN o_orderstatus IN ('F', 'P') THEN 'accepted' ELSE 'rejected' END AS outcome FROM c LEFT JOIN orders o USING (o_orderkey))
SELECT k.o_custkey, k.o_orderkey, outcome, l_linenumber, quantity, place FROM k LEFT JOIN r ON r.o_orderkey = k.o_orderkey AND outcome = 'accepted'"""
)
def chosen_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order, and one that nobody placed, as chosen routes: lines are the steps of a finished one."""
    orders = table(spark, sf_dir, "orders")
    latest = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    nobody = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (-1 - F.col("c_custkey")).alias("o_orderkey"))
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(F.sum("l_quantity").alias("quantity"))
    told = families.chosen_routes(latest.unionByName(nobody), orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), steps, "o_orderkey", "l_linenumber", ["F", "P"])
    return told.select("o_custkey", "o_orderkey", "outcome", "l_linenumber", "quantity", "place")


@query(
    f"""WITH d AS (SELECT item_id, {DNA_SQL} AS s FROM benchmark), f AS (SELECT item_id, s, [x for x in range(0, length(s) - 3) if substr(s, x + 1, 4) IN ('AATT', 'TTAA')] AS spots FROM d),
l AS (SELECT item_id, s, ['LOCUS       ' || rpad(item_id::VARCHAR, 16, ' ') || lpad(length(s)::VARCHAR, 12, ' ') || ' bp    ds-DNA     linear   SYN 01-JAN-1980', 'DEFINITION  ' || item_id || '.', 'ACCESSION   ' || left(sha256(s), 16), 'FEATURES             Location/Qualifiers']
 || CASE WHEN s <> '' THEN ['     source          1..' || length(s)] ELSE [] END
 || [CASE WHEN substr(s, x + 1, 4) = 'TTAA' THEN '     misc_feature    complement(' || (x + 1) || '..' || (x + 4) || ')' ELSE '     misc_feature    ' || (x + 1) || '..' || (x + 4) END || chr(10) || '                     /word="' || substr(s, x + 1, 4) || '"' for x in spots] || ['ORIGIN']
 || [lpad((i * 60 + 1)::VARCHAR, 9, ' ') || ' ' || array_to_string([lower(substr(s, i * 60 + j * 10 + 1, 10)) for j in range(0, 6) if i * 60 + j * 10 < length(s)], ' ') for i in range(0, (length(s) + 59) // 60)] || ['//'] AS lines FROM f)
SELECT item_id, length(s) AS n_nt, array_to_string(lines, chr(10)) AS record FROM l"""
)
def genbank_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as flat-file records, with two words as features of either strand."""
    items = item_dna(spark, sf_dir)
    n = F.length("dna")
    starts = F.when(n >= 4, F.sequence(F.lit(0), n - 4)).otherwise(F.array().cast("array<int>"))
    word = lambda i: F.substring(F.col("dna"), i + 1, F.lit(4))
    found = F.filter(starts, lambda i: word(i).isin("AATT", "TTAA"))
    features = F.transform(
        found, lambda i: F.struct(F.lit("misc_feature").alias("kind"), i.cast("bigint").alias("start"), (i + 4).cast("bigint").alias("stop"), (word(i) == "TTAA").alias("complement"), F.lit("word").alias("qualifier"), word(i).alias("value"))
    ).cast(f"array<{FEATURE}>")
    return items.select("item_id", n.cast("long").alias("n_nt"), genbank_text(F.col("item_id"), F.col("dna"), features).alias("record"))
