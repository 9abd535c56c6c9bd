"""Queries over shared variables, completions, release actions, compared routes, bounded matches, blocks and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import iupac_view, masks
from ..operators import contexts, populations, scan
from .assemblies import BUDGET, MEMBERS_SQL
from .catalogues import ORACLE_SQL, QUERIES
from .junctions import agents, mask_sql, partner_sql, view_sql
from .sequences import query, words_sql
from .tables import document_dna, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]


@query(
    f"""WITH q AS (SELECT DISTINCT {view_sql('p_name')} AS s, {view_sql('p_type')} AS a FROM part WHERE length({view_sql('p_name')}) > 0 AND length({view_sql('p_type')}) > 0),
p AS (SELECT s, a, i AS place, i AS variable, false AS complement, {mask_sql('substr(s, i + 1, 1)')} AS mask FROM (SELECT s, a, unnest(range(0, length(s))) AS i FROM q)
 UNION ALL SELECT s, a, length(s) + i, length(s) - 1 - i % length(s), true, {mask_sql('substr(a, i + 1, 1)')} FROM (SELECT s, a, unnest(range(0, length(a))) AS i FROM q)),
m AS (SELECT s, a, variable, bit_and(CASE WHEN complement THEN {partner_sql('mask')} ELSE mask END) AS met FROM p GROUP BY ALL),
z AS (SELECT s, a, CAST(round(exp(sum(CASE WHEN met > 0 THEN ln(bit_count(met)) ELSE 0 END))) AS BIGINT) AS size, min(variable) FILTER (met = 0) AS bad FROM m GROUP BY ALL)
SELECT s AS source, a AS arm, CAST(place AS BIGINT) AS place, CAST(variable AS BIGINT) AS variable, CAST(CASE WHEN complement THEN {partner_sql('met')} ELSE met END AS BIGINT) AS domain, CASE WHEN bad IS NULL THEN size ELSE 0 END AS size, CASE WHEN bad IS NOT NULL THEN 'no_base_for_' || bad END AS failure FROM p JOIN m USING (s, a, variable) JOIN z USING (s, a)"""
)
def shared_variable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names folded back on themselves: an arm of the type's symbols shows the name's places again, complemented and backwards."""
    pairs = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("source"), iupac_view(F.col("p_type")).alias("arm")).distinct().where("source <> '' AND arm <> ''")
    own = pairs.select("source", "arm", F.posexplode(masks(F.col("source"))).alias("place", "mask")).withColumns({"variable": F.col("place"), "complement": F.lit(False)})
    n = F.length("source")
    arm = pairs.select("source", "arm", F.posexplode(masks(F.col("arm"))).alias("i", "mask"))
    arm = arm.select("source", "arm", (n + F.col("i")).alias("place"), "mask", (n - 1 - F.col("i") % n).alias("variable"), F.lit(True).alias("complement"))
    told = contexts.shared_variables(own.unionByName(arm), ["source", "arm"])
    return told.select("source", "arm", *[F.col(c).cast("long").alias(c) for c in ("place", "variable", "domain", "size")], "failure")


MOTIFS, WIDTH = ["GATC", "CCA"], 4
SITES = scan.motif_pattern(MOTIFS)


@query(
    f"""WITH c AS ({words_sql('documents', WIDTH)}), s AS ({words_sql('benchmark', WIDTH)})
SELECT c.word, count(s.word) FILTER (NOT regexp_matches(c.word || s.word, '{SITES}')) AS completions FROM c, s GROUP BY c.word"""
)
def release_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts, the documents' words, with how many of the items' words complete them without a site."""
    before, behind = (scan.distinct_words(df, "dna", WIDTH) for df in (document_dna(spark, sf_dir), item_dna(spark, sf_dir)))
    return contexts.completions_of(before, "word", behind.withColumnRenamed("word", "suffix"), "suffix", MOTIFS).select("word", "completions")


@query(
    f"""WITH l AS (SELECT DISTINCT p_name AS release_id, {view_sql('p_name')} AS motif FROM part WHERE length({view_sql('p_name')}) > 0), n AS (SELECT release_id, length(motif) AS m, length(motif) + 2 AS t, length(motif) + length(motif) % 3 * 2 AS b FROM l),
o AS (SELECT release_id, 'forward' AS orientation, m, t, b FROM n UNION ALL SELECT release_id, 'reverse', m, m - b, m - t FROM n)
SELECT release_id, orientation, CAST(abs(b - t) AS BIGINT) AS overhang, CASE WHEN b = t THEN 'blunt' WHEN t < b THEN 'five_prime' ELSE 'three_prime' END AS end_kind, least(t, b) >= m OR greatest(t, b) <= 0 AS excised, b - t = 2 AS fits FROM o"""
)
def release_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What end each name leaves as a releasing agent, either way round, and whether it is a five-prime one of two bases."""
    told = contexts.release_actions(agents(spark, sf_dir)[1], 2)
    return told.withColumn("overhang", F.col("overhang").cast("long"))


REGIONS_SQL = "SELECT p_partkey, unnest(['name', 'brand', 'type', 'band']) AS region, unnest([p_name, p_brand, p_type, CASE WHEN p_size < 25 THEN 'small' END]) AS value FROM part"


@query(
    f"""WITH r AS (SELECT * FROM ({REGIONS_SQL}) WHERE region <> 'band' OR value IS NOT NULL), a AS (SELECT p_partkey AS k, region, value AS l FROM r WHERE p_partkey < (SELECT max(p_partkey) FROM part)), b AS (SELECT p_partkey - 1 AS k, region, value AS r FROM r WHERE p_partkey > (SELECT min(p_partkey) FROM part))
SELECT k AS p_partkey, region, l AS "left", r AS "right", CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN l IS NOT DISTINCT FROM r THEN 'same' ELSE 'changed' END AS relation FROM a FULL JOIN b USING (k, region)"""
)
def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the next one, region by region; large parts have no band."""
    parts = table(spark, sf_dir, "part")
    cells = {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "band": F.when(F.col("p_size") < 25, "small")}
    rows = parts.select("p_partkey", F.inline(F.array(*[F.struct(F.lit(n).alias("region"), c.alias("value")) for n, c in cells.items()]))).where("region <> 'band' OR value IS NOT NULL")
    ends = F.broadcast(parts.agg(F.min("p_partkey").alias("_low"), F.max("p_partkey").alias("_high")))  # one row
    left = rows.crossJoin(ends).where("p_partkey < _high")
    right = rows.crossJoin(ends).where("p_partkey > _low").withColumn("p_partkey", F.col("p_partkey") - 1)
    return contexts.compared_routes(left, right, ["p_partkey"], "region", "value")


MATCH_BUDGET = 30


@query(
    f"""WITH ref AS (SELECT p_brand, arg_max(p_name, p_partkey) AS n, arg_max(p_type, p_partkey) AS t FROM part GROUP BY p_brand), c AS (SELECT p_brand, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS total FROM part),
x AS (SELECT *, p_name = n AND p_type = t AS same FROM c JOIN ref USING (p_brand) WHERE r < {MATCH_BUDGET})
SELECT p_brand, coalesce(min(r) FILTER (same), max(r)) + 1 AS examined, min(p_partkey) FILTER (same) AS "match", CASE WHEN count(*) FILTER (same) = 0 AND any_value(total) > {MATCH_BUDGET} THEN max(p_partkey) END AS cursor FROM x GROUP BY p_brand"""
)
def family_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each brand that has the name and type of the brand's last one, within thirty candidates."""
    parts = table(spark, sf_dir, "part")
    reference = parts.groupBy("p_brand").agg(F.max_by("p_name", "p_partkey").alias("p_name"), F.max_by("p_type", "p_partkey").alias("p_type"))
    return contexts.bounded_matches(parts, "p_brand", "p_partkey", ["p_name", "p_type"], reference, MATCH_BUDGET)


@query(
    """SELECT event_id // 1000 AS block, min(event_id) AS first, max(event_id) AS last, count(*) AS rows, sha256(CAST(sum(CAST(('0x' || substr(sha256(event_id || '|' || user_id || '|' || coalesce(event_type, '-')), 1, 12)) AS BIGINT)) AS VARCHAR)) AS digest FROM events GROUP BY 1"""
)
def block_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in blocks of a thousand numbers, each with its digest."""
    return contexts.block_digests(table(spark, sf_dir, "events"), "event_id", 1000, ["user_id", "event_type"])


@query(
    """WITH x AS (SELECT 'p_size' AS axis, CAST(p_size AS DOUBLE) AS v, 5 AS lo, 30 AS hi FROM part UNION ALL SELECT 'p_retailprice', p_retailprice, 920, 960 FROM part)
SELECT axis, count(*) FILTER (v BETWEEN lo AND hi) AS inside, count(*) FILTER (NOT v BETWEEN lo AND hi) AS outside, count(*) FILTER (v IS NULL) AS unassessed, min(v) AS least, max(v) AS greatest FROM x GROUP BY axis"""
)
def parameter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parts achieved against requested sizes and prices."""
    return contexts.parameter_facts(table(spark, sf_dir, "part"), {"p_size": (5, 30), "p_retailprice": (920, 960)})


@query("WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) SELECT before, after, count(*) AS times FROM s GROUP BY ALL")
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one type of event follows another in a user's chronology."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return contexts.transitions(rows, "user_id", "at", "event_type")


@query(MEMBERS_SQL + "SELECT seq AS program, rank, rank % 3 AS part, source, adapter FROM m WHERE rank >= 2 AND rank < 12")
def program_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each name's solutions, dealt to three parts; none before the window is made."""
    names = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("program")).distinct().where("program <> ''")
    asked = names.withColumn("rank", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(11).cast("long"))))
    made = populations.member_at(asked, masks(F.col("program")), F.col("rank"), BUDGET).where("source IS NOT NULL")
    return made.select("program", "rank", (F.col("rank") % 3).alias("part"), "source", "adapter")


@query(
    """WITH f AS (SELECT p_name, count(*) AS foldbacks, min(p_partkey) AS first_foldback FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY p_name), b AS (SELECT p_name, count(*) AS basals, min(p_partkey) AS first_basal FROM part WHERE p_type = 'LARGE' GROUP BY p_name)
SELECT p_name AS payload, foldbacks, basals, first_foldback, first_basal FROM f JOIN b USING (p_name)"""
)
def local_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that both local domains hold, with each domain's rows."""
    parts = table(spark, sf_dir, "part")
    side = lambda df, n, first: df.groupBy(F.col("p_name").alias("payload")).agg(F.count(F.lit(1)).alias(n), F.min("p_partkey").alias(first))
    return side(parts.where(F.col("p_type").isin("ECONOMY", "SMALL")), "foldbacks", "first_foldback").join(side(parts.where("p_type = 'LARGE'"), "basals", "first_basal"), "payload").select(
        "payload", "foldbacks", "basals", "first_foldback", "first_basal"
    )
