"""Queries over pools of options, routes, similarity and resumable steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import lineage, pool, similar
from ..streaming import steps as resumable
from .sequences import ORACLE_SQL, QUERIES, query
from .tables import DNA_SQL, document_dna, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]

SELECTIONS = {"p_type": {"values": ["ECONOMY", "SMALL", "LARGE"]}, "p_size": {"low": 5, "high": 30}, "p_brand": {"values": [f"Brand#{i}" for i in range(1, 13)]}}
AXES = ["p_type", "p_size", "p_brand"]
T, S, B = "p_type IN ('ECONOMY','SMALL','LARGE')", "p_size BETWEEN 5 AND 30", "p_brand IN (" + ",".join(f"'Brand#{i}'" for i in range(1, 13)) + ")"


def facet_sql(axis: str, others: str) -> str:
    return f"""SELECT '{axis}' AS axis, CAST({axis} AS VARCHAR) AS value, count(*) AS records, count(DISTINCT p_name) AS preparations,
 count(*) FILTER ({others}) AS conditional_records, count(DISTINCT p_name) FILTER ({others}) AS conditional_preparations FROM part GROUP BY {axis}"""


FACETS_SQL = " UNION ALL ".join([facet_sql("p_type", f"{S} AND {B}"), facet_sql("p_size", f"{T} AND {B}"), facet_sql("p_brand", f"{T} AND {S}")])


@query(FACETS_SQL)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.facets(table(spark, sf_dir, "part"), AXES, SELECTIONS, "p_name")


@query(
    f"""WITH f AS ({FACETS_SQL}), d(axis, value) AS (SELECT 'p_type', x FROM (VALUES ('ECONOMY'),('SMALL'),('LARGE'),('STANDARD'),('GIANT')) t(x) UNION ALL SELECT 'p_size', CAST(i AS VARCHAR) FROM range(0, 61) t(i))
SELECT axis, value, CASE WHEN conditional_records > 0 THEN 'supported' WHEN records > 0 THEN 'supported_elsewhere' ELSE 'unresolved' END AS state FROM d LEFT JOIN f USING (axis, value)"""
)
def facet_domain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = [("p_type", t) for t in ("ECONOMY", "SMALL", "LARGE", "STANDARD", "GIANT")]
    declared = spark.createDataFrame([*types, *[("p_size", str(i)) for i in range(61)]], "axis string, value string")
    return pool.domain_states(facet_counts(spark, sf_dir), declared, complete=False)


@query(
    f"""SELECT p_partkey, concat_ws(',', CASE WHEN NOT ({T}) THEN 'p_type:different' END, CASE WHEN NOT ({S}) THEN 'p_size:different' END, CASE WHEN NOT ({B}) THEN 'p_brand:different' END) AS reasons,
 ({T}) AND ({S}) AND ({B}) AS eligible FROM part"""
)
def variant_query_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pool.reasons(SELECTIONS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(said, ",").alias("reasons"), (F.size(said) == 0).alias("eligible"))


@query(
    f"""WITH x AS (SELECT 'p_size' AS key, CAST(p_size AS BIGINT) AS value, ({T}) AS ok FROM part UNION ALL SELECT 'price_band', CAST(floor(p_retailprice / 100) AS BIGINT), ({T}) FROM part),
c AS (SELECT key, value, count(*) AS recorded, count(*) FILTER (ok) AS eligible FROM x GROUP BY key, value)
SELECT key, value, recorded, eligible, CAST(coalesce(sum(CASE WHEN value IS NULL THEN recorded ELSE 0 END) OVER (PARTITION BY key), 0) AS BIGINT) AS missing,
 CAST(sum(recorded) OVER (PARTITION BY key) AS BIGINT) AS of_recorded, CAST(sum(eligible) OVER (PARTITION BY key) AS BIGINT) AS of_eligible FROM c WHERE value IS NOT NULL"""
)
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("price_band", F.floor(F.col("p_retailprice") / 100))
    return pool.distributions(parts, ["p_size", "price_band"], pool.accepts("p_type", SELECTIONS["p_type"]))


@query(
    """WITH g AS (SELECT p_brand, p_size, count(*) AS members, list_distinct(list(p_type)) AS present FROM part GROUP BY p_brand, p_size)
SELECT p_brand, p_size, members, array_to_string(list_filter(['ECONOMY','LARGE','SMALL'], lambda x: NOT list_contains(present, x)), ',') AS missing,
 len(list_filter(['ECONOMY','LARGE','SMALL'], lambda x: NOT list_contains(present, x))) = 0 AS whole FROM g"""
)
def option_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.option_sets(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_type", ["ECONOMY", "SMALL", "LARGE"])


@query(
    """WITH r AS (SELECT * FROM part WHERE p_partkey = 0) SELECT p.p_partkey, concat_ws(',', CASE WHEN p.p_type IS DISTINCT FROM r.p_type THEN 'p_type' END,
 CASE WHEN p.p_size IS DISTINCT FROM r.p_size THEN 'p_size' END, CASE WHEN p.p_name IS DISTINCT FROM r.p_name THEN 'p_name' END) AS changed FROM part p, r"""
)
def preserve_surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return pool.surroundings(parts, "p_partkey", parts.where("p_partkey = 0"), ["p_type", "p_size", "p_name", "p_brand"], "p_brand")


@query("SELECT p_type, p_brand, arg_min(p_partkey, sha256('seed-7:' || p_partkey)) AS p_partkey FROM part GROUP BY p_type, p_brand")
def sample_hash_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.hash_sample(table(spark, sf_dir, "part"), "p_partkey", "seed-7", ["p_type", "p_brand"])


@query(
    """WITH seen AS (SELECT * FROM part WHERE p_partkey < 40), m AS (SELECT p_partkey, CASE WHEN p_type NOT IN (SELECT p_type FROM seen) THEN 0 WHEN p_name NOT IN (SELECT p_name FROM seen) THEN 1 WHEN p_name <> (SELECT arg_max(p_name, p_partkey) FROM seen) THEN 2 ELSE 3 END AS tier FROM part)
SELECT p_partkey, tier FROM m ORDER BY tier, sha256('seed-3:' || p_partkey) LIMIT 1"""
)
def guided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option, as the feature is to propose the next one."""
    parts = table(spark, sf_dir, "part")
    return pool.guided_choice(parts, "p_partkey", "p_type", "p_name", parts.where("p_partkey < 40"), "seed-3")


@query(f"SELECT p_partkey, p_name FROM part WHERE {T} AND {S} AND {B} AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def member_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that pass the selections and are named by a list: those sold in large lots."""
    named = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return pool.matching(table(spark, sf_dir, "part"), "p_partkey", SELECTIONS, named).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice, p_partkey) - 1 AS stratum FROM part")
def stratified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.stratified_rank(table(spark, sf_dir, "part"), ["p_type", "p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_type", "stratum")


@query(f"WITH s AS (SELECT doc_id, sha256({DNA_SQL}) AS digest FROM documents) SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS canonical, min(doc_id) OVER (PARTITION BY digest) <> doc_id AS duplicate FROM s")
def canonical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.canonical_members(document_dna(spark, sf_dir), F.sha2("dna", 256), "doc_id").select("doc_id", "digest", "canonical", "duplicate")


@query(
    """WITH o AS (SELECT p_partkey, p_type, p_brand, p_size FROM part), g AS (
 SELECT a.p_partkey AS first, b.p_partkey AS second, CASE WHEN a.p_brand <> b.p_brand THEN 'brand_differs' WHEN a.p_size = b.p_size THEN 'same_size' ELSE 'accepted' END AS outcome
 FROM o a, o b WHERE a.p_type = 'ECONOMY' AND b.p_type = 'SMALL') SELECT outcome, count(*) AS sets FROM g GROUP BY outcome"""
)
def group_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of one option for each slot, by their first rejection, counted from grouped sizes."""
    options = table(spark, sf_dir, "part")
    side = lambda t, s: options.where(F.col("p_type") == t).groupBy(F.col("p_brand").alias(f"{s}b"), F.col("p_size").alias(f"{s}s")).agg(F.count(F.lit(1)).alias(f"{s}n"))
    # Distinct (brand, size) classes only: their number is bounded by the catalogue, not the options.
    pairs = side("ECONOMY", "a").crossJoin(F.broadcast(side("SMALL", "b")))
    outcome = F.when(F.col("ab") != F.col("bb"), "brand_differs").when(F.col("as") == F.col("bs"), "same_size").otherwise("accepted")
    return pairs.groupBy(outcome.alias("outcome")).agg(F.sum(F.col("an") * F.col("bn")).alias("sets"))


STEPS_SQL = "SELECT user_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS witness, CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS exhausted FROM events"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as append-only steps of targets."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ordinal"),
        F.row_number().over(order).alias("step"),
        "event_id",
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("witness"),
        F.when(F.col("event_type").isin("error", "view"), 1).otherwise(0).alias("exhausted"),
    )


@query(
    f"""WITH s AS ({STEPS_SQL}), c AS (SELECT ordinal % 10 AS value, ordinal % 3 AS partner, max(exhausted) AS e, sum(witness) AS w FROM s GROUP BY ALL)
SELECT value, count(*) FILTER (e = 1 AND w = 0) AS closed, count(*) FILTER (e = 1 AND w = 0) = 3 AS excluded FROM c GROUP BY value"""
)
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).select((F.col("ordinal") % 10).alias("value"), (F.col("ordinal") % 3).alias("partner"), "witness", "exhausted")
    return pool.excluded_values(rows, "value", "partner", 3)


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY cost, p_brand) - 1 AS i, cost, p_brand FROM (SELECT p_brand, min(p_retailprice) AS cost FROM part GROUP BY p_brand))
SELECT a.p_brand AS left_brand, b.p_brand AS right_brand, round(a.cost + b.cost, 4) AS cost, row_number() OVER (ORDER BY round(a.cost + b.cost, 4), a.i, b.i) AS place FROM r a, r b QUALIFY place <= 20"""
)
def best_first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 cheapest pairs of two cost-sorted factors: among the first 20 of each, as the k-th pair needs no later one."""
    costs = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("cost")).orderBy("cost", "p_brand").limit(20)
    ranked = costs.withColumn("i", F.row_number().over(Window.orderBy("cost", "p_brand")))  # 20 rows
    side = lambda s: ranked.select(F.col("p_brand").alias(f"{s}_brand"), F.col("cost").alias(f"{s}_cost"), F.col("i").alias(f"{s}_i"))
    pairs = side("left").crossJoin(F.broadcast(side("right"))).withColumn("cost", F.round(F.col("left_cost") + F.col("right_cost"), 4))
    order = Window.orderBy("cost", "left_i", "right_i")
    return pairs.withColumn("place", F.row_number().over(order)).where("place <= 20").select("left_brand", "right_brand", "cost", "place")


@query(f"WITH s AS ({STEPS_SQL}) SELECT ordinal, count(*) AS steps, CAST(sum(witness) AS BIGINT) AS witnesses, max(exhausted) AS exhausted, max(step) AS last_step, arg_max(event_id, step) AS last_event, CASE WHEN sum(witness) > 0 THEN 'supported' WHEN max(exhausted) = 1 THEN 'excluded' ELSE 'unresolved' END AS state FROM s GROUP BY ordinal")
def coverage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumable.coverage(steps(spark, sf_dir))


@query(f"WITH s AS ({STEPS_SQL}), n AS (SELECT *, coalesce(lag(step) OVER (PARTITION BY ordinal ORDER BY step), 0) AS before, coalesce(max(exhausted) OVER (PARTITION BY ordinal ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM s) SELECT ordinal, step, closed AS after_end FROM n WHERE step <> before + 1 OR closed = 1")
def step_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumable.violations(steps(spark, sf_dir))


@query(f"WITH s AS ({STEPS_SQL}), a AS (SELECT ordinal, step, witness FROM s), b AS (SELECT ordinal, step, CASE WHEN step = 3 AND ordinal % 7 = 0 THEN 9 ELSE witness END AS witness FROM s) SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log replayed with some altered witnesses."""
    rows = steps(spark, sf_dir).select("ordinal", "step", "witness")
    altered = F.when((F.col("step") == 3) & (F.col("ordinal") % 7 == 0), 9).otherwise(F.col("witness"))
    return resumable.replay(rows, rows.withColumn("witness", altered))


SIGNATURE_SQL = """WITH c AS (SELECT DISTINCT l_orderkey, CAST(least(l_partkey, l_suppkey) AS VARCHAR) || '-' || CAST(greatest(l_partkey, l_suppkey) AS VARCHAR) AS e FROM lineitem)
SELECT l_orderkey, sha256(string_agg(e, ';' ORDER BY e)) AS signature FROM c GROUP BY l_orderkey"""


@query(SIGNATURE_SQL)
def signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edge_signature(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "l_suppkey")


SIMILAR_SQL = f"""WITH r AS (SELECT item_id, {DNA_SQL} AS dna, length({DNA_SQL}) AS n_nt, length(regexp_replace({DNA_SQL}, '[^GC]', '', 'g')) AS gc FROM benchmark),
s AS (SELECT CAST(max(n_nt) - min(n_nt) AS DOUBLE) AS rn, CAST(max(gc) - min(gc) AS DOUBLE) AS rg FROM r),
d AS (SELECT a.item_id AS a, b.item_id AS b, round(((CASE WHEN (rn > 0) OR (rg > 0) THEN ((CASE WHEN rn > 0 THEN abs(a.n_nt - b.n_nt) / rn ELSE 0 END) + (CASE WHEN rg > 0 THEN abs(a.gc - b.gc) / rg ELSE 0 END)) / (CAST(rn > 0 AS INT) + CAST(rg > 0 AS INT)) ELSE 0 END)
 + least(1.0, greatest(0.0, (levenshtein(a.dna, b.dna) - abs(a.n_nt - b.n_nt)) / greatest(1, least(a.n_nt, b.n_nt))))) / 2, 9) AS distance
 FROM r a, r b, s WHERE a.item_id % 50 = 0 AND a.item_id <> b.item_id)"""


def preparations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gc = F.length(F.regexp_replace("dna", "[^GC]", ""))
    return item_dna(spark, sf_dir).select("item_id", "dna", F.length("dna").alias("n_nt"), gc.alias("gc"))


@query(SIMILAR_SQL + " SELECT a, b, distance FROM d")
def dissimilarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated references, ids divisible by 50, against all."""
    rows = preparations(spark, sf_dir)
    return similar.distances(rows.where("item_id % 50 = 0"), rows, "item_id", ["n_nt", "gc"], "dna").select("a", "b", "distance")


@query(SIMILAR_SQL + " SELECT a, b, distance, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS place FROM d QUALIFY place <= 5")
def neighbors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preparations(spark, sf_dir)
    return similar.neighbours(rows.where("item_id % 50 = 0"), rows, "item_id", ["n_nt", "gc"], "dna", 5).select("a", "b", "distance", "place")


@query("SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS classes, count(*) AS paths FROM orders GROUP BY ALL")
def diversity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.countDistinct("o_custkey").alias("classes"), F.count(F.lit(1)).alias("paths"))


@query("SELECT p_name AS sequence, p_type AS chemistry, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS roles, count(*) AS uses FROM part GROUP BY p_name, p_type")
def material_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.array_sort(F.collect_set("p_brand")), ",")
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("sequence"), F.col("p_type").alias("chemistry")).agg(roles.alias("roles"), F.count(F.lit(1)).alias("uses"))


@query(
    """WITH a AS (SELECT l_partkey AS k, count(*) AS before FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS after FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS l_partkey, before, after FROM a FULL JOIN b ON a.k = b.k WHERE before IS DISTINCT FROM after"""
)
def coordinate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    count = lambda flag: rows.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return pool.changed_keys(count("A"), count("R"), "l_partkey", "n")


@query("SELECT p_type, p_brand, CASE WHEN count(DISTINCT p_size) = 0 THEN 'unavailable' WHEN count(DISTINCT p_size) = 1 THEN 'fixed' ELSE 'variable' END AS neighborhood, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_type, p_brand")
def neighborhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.countDistinct("p_size")
    state = F.when(n == 0, "unavailable").when(n == 1, "fixed").otherwise("variable")
    return table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(state.alias("neighborhood"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query(
    """WITH q AS (SELECT DISTINCT p_size AS query, p_type FROM part), r AS (SELECT DISTINCT p_size AS query, p_brand FROM part),
p AS (SELECT p_type, p_brand, min(p_retailprice) >= 950 AS gone FROM part GROUP BY ALL),
t AS (SELECT query, count(*) AS targets, count(p.gone) AS n_ended, count(*) FILTER (p.gone) AS n_excluded
FROM q JOIN r USING (query) LEFT JOIN p USING (p_type, p_brand) GROUP BY query)
SELECT query, targets, n_excluded = targets AS excluded, n_ended < targets AS pending FROM t"""
)
def interface_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is settled of the types and brands that each size permits; pairs that occur have ended, dear ones are excluded."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("query"), F.col("p_type").alias("left"), F.col("p_brand").alias("right"), "p_retailprice")
    ended = rows.groupBy("left", "right").agg(F.min("p_retailprice").alias("least"))
    return pool.interface_status(rows.select("query", "left"), rows.select("query", "right"), ended, ended.where("least >= 950"))


@query("SELECT count(*) AS records, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents")
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resumable.storage(table(spark, sf_dir, "documents"), "text")
