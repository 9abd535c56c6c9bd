"""Queries over geometry, masks, levels, costs, audits and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import geometry, lineage, pool, scan
from ..operators.lineage import number_of
from .pools import ORACLE_SQL, QUERIES, STEPS_SQL, steps
from .sequences import query, words_sql
from .tables import DNA_SQL, document_dna, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(
    """WITH c AS (SELECT p_type, p_size, count(*) AS examined, count(*) FILTER (p_retailprice < 1000) AS accepted FROM part GROUP BY ALL),
r AS (SELECT *, CAST(sum(accepted) OVER (PARTITION BY p_type ORDER BY p_size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM c)
SELECT p_type, p_size, examined, accepted, so_far, CASE WHEN so_far - accepted >= 20 THEN 'unvisited' WHEN so_far >= 20 THEN 'quota_met' ELSE 'complete' END AS status FROM r"""
)
def level_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("ok", F.col("p_retailprice") < 1000)
    return geometry.level_summary(parts, "p_type", "p_size", "ok", 20)


@query(
    """WITH x AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)),
y AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS run FROM x)
SELECT l_orderkey, l_returnflag, count(DISTINCT run) AS regions, count(*) AS bases FROM y GROUP BY ALL"""
)
def construction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added regions as runs of one name along an order's lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("at"))
    runs = geometry.runs_by_name(rows, ["l_orderkey"], "at", "l_returnflag")
    return runs.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("regions"), F.sum("length").alias("bases"))


@query(
    """WITH l AS (SELECT p_brand, p_size, p_partkey, unnest([{'p': 'p_type', 'v': p_type}, {'p': 'p_name', 'v': p_name}]) AS x FROM part)
SELECT p_brand, p_size, x.p AS property, CASE WHEN count(*) < 2 OR count(x.v) < count(*) THEN 'unassessed' WHEN min(x.v) = max(x.v) THEN 'shared' ELSE 'different' END AS state, min(p_partkey) AS baseline FROM l GROUP BY ALL"""
)
def stage_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.controls(table(spark, sf_dir, "part"), ["p_brand", "p_size"], ["p_type", "p_name"], "p_partkey")


@query("SELECT l_suppkey, max(l_partkey - 500) AS low, min(l_partkey + 900) AS high, max(l_partkey - 500) > min(l_partkey + 900) AS conflict FROM lineitem GROUP BY l_suppkey")
def effective_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") - 500).alias("low"), (F.col("l_partkey") + 900).alias("high"))
    return geometry.effective_ranges(ranges, "l_suppkey")


@query(
    f"""WITH w AS ({words_sql('documents', 6)}), p AS ({words_sql('benchmark', 6)}), t AS (SELECT word, CASE WHEN word IN (SELECT word FROM p) THEN 0 ELSE 1 END AS tier FROM w)
SELECT word, tier, row_number() OVER (ORDER BY tier, word) - 1 AS place FROM t UNION ALL SELECT word, -1, NULL FROM p WHERE word NOT IN (SELECT word FROM w)"""
)
def context_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with those of the items first; an item's word that no document has is told."""
    every, first = (scan.distinct_words(df, "dna", 6) for df in (document_dna(spark, sf_dir), item_dna(spark, sf_dir)))
    return geometry.preferred_first(every, first, "word")


@query(f"WITH w AS ({words_sql('documents', 8)}) SELECT word FROM w WHERE NOT regexp_matches(word, 'GA[ACGT]TC|CC[AT]GG')")
def site_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all windows that hold no listed site, either way round."""
    words = scan.distinct_words(document_dna(spark, sf_dir), "dna", 8)
    return words.where(~F.col("word").rlike(scan.motif_pattern(["GANTC", "CCWGG"])))


@query(
    """WITH n AS (SELECT p_type, p_brand, p_name, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, p_brand, CAST(sum(n) AS BIGINT) AS rows, count(*) AS variants, sha256(count(*) || '|' || sum(CAST(('0x' || substr(sha256(p_name), 1, 12)) AS BIGINT))) AS structural_class FROM n GROUP BY p_type, p_brand"""
)
def structural_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by the set of their names, of which digests are summed and none is listed."""
    names = table(spark, sf_dir, "part").groupBy("p_type", "p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    said = F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(number_of("p_name")).cast("string"))
    return names.groupBy("p_type", "p_brand").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("variants"), F.sha2(said, 256).alias("structural_class"))


@query(f"WITH s AS (SELECT item_id, sha256({DNA_SQL}) AS d, length({DNA_SQL}) AS n FROM benchmark) SELECT item_id, '{{\"n\":' || n || ',\"sha\":\"' || d || '\"}}' AS body, sha256('{{\"n\":' || n || ',\"sha\":\"' || d || '\"}}' || chr(10)) AS digest FROM s")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of fields in key order, and the digest of it with a line end."""
    body = F.to_json(F.struct(F.length("dna").alias("n"), F.sha2("dna", 256).alias("sha")))
    return item_dna(spark, sf_dir).select("item_id", body.alias("body"), F.sha2(F.concat(body, F.lit("\n")), 256).alias("digest"))


@query(
    """WITH s AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT r_name AS material_id, min(n_nationkey) AS first_member, count(*) AS uses FROM s GROUP BY r_name) SELECT * FROM m"""
)
def set_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct materials with the member that first names each, and how often it is used."""
    members = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").hint("broadcast")), F.col("n_regionkey") == F.col("r_regionkey"))
    return members.groupBy(F.col("r_name").alias("material_id")).agg(F.min("n_nationkey").alias("first_member"), F.count(F.lit(1)).alias("uses"))


@query(f"WITH s AS ({STEPS_SQL}) SELECT ordinal, step, event_id, witness FROM s QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY step DESC) = 1")
def latest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = steps(spark, sf_dir).groupBy("ordinal").agg(F.max_by(F.struct("step", "event_id", "witness"), "step").alias("x"))
    return last.select("ordinal", "x.step", "x.event_id", "x.witness")


@query(f"WITH s AS ({STEPS_SQL}) SELECT ordinal, step, event_id FROM s ORDER BY ordinal, step LIMIT 50 OFFSET 100")
def steps_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page: the limit is the feature."""
    return steps(spark, sf_dir).select("ordinal", "step", "event_id").orderBy("ordinal", "step").offset(100).limit(50)


@query(f"WITH s AS ({STEPS_SQL}) SELECT ordinal, sha256(string_agg(event_id || ':' || witness, ',' ORDER BY step)) AS digest, count(*) AS steps FROM s GROUP BY ordinal")
def prefix_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each target's steps in order."""
    said = F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("witness").cast("string"))
    return lineage.ordered_digest(steps(spark, sf_dir).withColumn("said", said), "ordinal", "step", "said", "digest", "steps")


@query(
    """WITH s AS (SELECT * FROM part WHERE p_partkey = 0) SELECT p.p_partkey FROM part p, s WHERE p.p_type = s.p_type AND p.p_brand = s.p_brand AND p.p_name <> s.p_name"""
)
def loop_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options like the current one in all but the loop."""
    parts = table(spark, sf_dir, "part")
    kept = pool.surroundings(parts, "p_partkey", parts.where("p_partkey = 0"), ["p_type", "p_brand", "p_name"], "p_name").where("changed = ''")
    now = F.broadcast(parts.where("p_partkey = 0").select(F.col("p_name").alias("loop")))  # one row
    return kept.join(parts.select("p_partkey", "p_name"), "p_partkey").crossJoin(now).where("p_name <> loop").select("p_partkey")
