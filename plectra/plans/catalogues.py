"""Queries over branches, permissions, placements, materials and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import dna_view, iupac_view, reverse_complement
from ..operators import branches, enumerate as domains, grouping, ranks, scan
from .assemblies import BRIEF, GROUP_SQL, SLOTS, options
from .junctions import COMPLEMENT, agents, mask_sql, view_sql
from .pools import SELECTIONS, STEPS_SQL, steps
from .processing import IUPAC_TABLE, ORACLE_SQL, QUERIES
from .searches import COMPOSED_SQL, composed
from .sequences import query, words_sql
from .tables import DNA_SQL, document_dna, item_dna, table

__all__ = ["ORACLE_SQL", "QUERIES"]

BRANCH_BUDGET = 40


@query(
    f"""WITH b AS (SELECT *, row_number() OVER (ORDER BY p_type || '|' || p_brand) - 1 AS ordinal FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_brand <> 'Brand#7')),
t AS (SELECT DISTINCT p_type, p_size // 10 AS band FROM part), o AS (SELECT DISTINCT p_type, p_brand, p_size // 10 AS band FROM part WHERE p_retailprice < 995),
m AS (SELECT b.p_type, b.p_brand, ordinal, count(t.band) AS targets, count(o.band) AS matched FROM b LEFT JOIN t ON t.p_type = b.p_type LEFT JOIN o ON o.p_type = b.p_type AND o.p_brand = b.p_brand AND o.band = t.band GROUP BY ALL)
SELECT p_type, p_brand, ordinal, targets, matched, CASE WHEN targets > 0 AND matched = targets THEN 'reused' WHEN sum(CAST(NOT (targets > 0 AND matched = targets) AS INT)) OVER (ORDER BY ordinal) <= {BRANCH_BUDGET} THEN 'evaluate' ELSE 'unexamined' END AS decision FROM m"""
)
def branch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permitted types and brands as branches, each type's size bands as their targets, cheap parts as recorded options."""
    parts = table(spark, sf_dir, "part").withColumn("band", F.floor(F.col("p_size") / 10))
    permitted = parts.where("p_brand <> 'Brand#7'").select("p_type", "p_brand").distinct()
    targets = permitted.join(parts.select("p_type", "band").distinct(), "p_type")
    return branches.branch_decisions(permitted, ["p_type", "p_brand"], targets, parts.where("p_retailprice < 995"), "band", BRANCH_BUDGET)


@query(
    """WITH d(field, value) AS (SELECT 'p_type', x FROM (VALUES ('ECONOMY'), ('SMALL'), ('LARGE')) t(x) UNION ALL SELECT 'p_size', CAST(i AS VARCHAR) FROM range(5, 31) t(i)),
c AS (SELECT p_partkey, 'p_type' AS field, p_type AS requested FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part)
SELECT p_partkey, field, requested, permitted FROM c JOIN (SELECT field, count(*) AS permitted FROM d GROUP BY field) USING (field) WHERE requested IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.field = c.field AND d.value = c.requested)"""
)
def member_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part asks for outside the permitted types and sizes; brands are not restricted."""
    values = [("p_type", t) for t in SELECTIONS["p_type"]["values"]] + [("p_size", str(i)) for i in range(5, 31)]
    return branches.member_conflicts(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand"), "p_partkey", spark.createDataFrame(values, "field string, value string"))


@query(
    f"""WITH d AS (SELECT DISTINCT 'p_type' AS key, p_type AS value FROM part WHERE p_retailprice < 905 UNION SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 30),
c AS (SELECT key, count(*) AS declared, count(*) FILTER (CASE key WHEN 'p_type' THEN value IN ('ECONOMY', 'SMALL', 'LARGE') ELSE CAST(value AS INTEGER) BETWEEN {SELECTIONS['p_size']['low']} AND {SELECTIONS['p_size']['high']} END) AS accepted FROM d GROUP BY key)
SELECT k AS key, coalesce(declared, 0) AS declared, coalesce(accepted, 0) AS accepted, coalesce(declared, 0) = 0 OR accepted > 0 AS permitted FROM (VALUES ('p_type'), ('p_size'), ('p_brand')) t(k) LEFT JOIN c ON c.key = k"""
)
def permitted_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selections the declared values leave possible."""
    parts = table(spark, sf_dir, "part")
    declared = parts.where("p_retailprice < 905").select(F.lit("p_type").alias("key"), F.col("p_type").alias("value")).unionByName(
        parts.where("p_size > 30").select(F.lit("p_size").alias("key"), F.col("p_size").cast("string").alias("value"))
    )
    return branches.predicates_permitted(SELECTIONS, declared)


@query(f"SELECT p_partkey, p_type AS nick_id, {view_sql('p_type')} AS motif, length({view_sql('p_type')}) + 1 AS cut FROM part WHERE length({view_sql('p_type')}) > 0")
def agents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agent that each part asks for by its type."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("nick_id")).where(F.length(iupac_view(F.col("nick_id"))) > 0)
    return branches.by_id(asked, agents(spark, sf_dir)[0], "nick_id").select("p_partkey", "nick_id", "motif", F.col("cut").cast("long").alias("cut"))


@query(
    f"""WITH k AS (SELECT DISTINCT p_type AS nick_id, {view_sql('p_type')} AS motif FROM part WHERE length({view_sql('p_type')}) > 0), n AS (SELECT *, CASE WHEN regexp_matches(motif, '[TG]') THEN 'top' ELSE 'bottom' END AS native, length(motif) + 1 AS cut FROM k),
s AS (SELECT item_id, length({DNA_SQL}) AS n_nt FROM benchmark), p AS (SELECT item_id, nick_id, strand, n_nt, n_nt // 4 AS boundary, native = strand AS fwd, n_nt // 4 - CASE WHEN native = strand THEN cut ELSE length(motif) - cut END AS start, length(motif) AS m FROM s, n, (VALUES ('top'), ('bottom')) t(strand))
SELECT item_id, nick_id, strand, CASE WHEN fwd THEN 'forward' ELSE 'reverse' END AS orientation, CAST(start AS BIGINT) AS start, CAST(start + m AS BIGINT) AS stop, start >= 0 AND start + m <= n_nt AS fits, CAST(n_nt - start - m AS BIGINT) AS mirrored_start, CAST(n_nt - boundary AS BIGINT) AS mirrored_boundary FROM p"""
)
def site_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each agent must lie to cut either strand of an item at its first quarter, and where that is on the turned item."""
    items = item_dna(spark, sf_dir).select("item_id", F.length("dna").alias("n_nt"), F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("strand"))
    pairs = items.crossJoin(agents(spark, sf_dir)[0])  # a catalogue
    pairs = pairs.withColumn("boundary", F.floor(F.col("n_nt") / 4))
    rows = branches.placed(pairs, F.col("strand"), F.col("boundary"), F.col("n_nt"))
    turned = branches.mirrored(rows.select("item_id", "nick_id", F.col("strand").alias("_own"), "strand", "orientation", "start", "boundary", "n_nt", "motif"), F.length("motif"), F.col("n_nt"))
    turned = turned.select("item_id", "nick_id", F.col("_own").alias("strand"), F.col("start").alias("mirrored_start"), F.col("boundary").alias("mirrored_boundary"))
    longs = [F.col(c).cast("long").alias(c) for c in ("start", "stop", "mirrored_start", "mirrored_boundary")]
    return rows.join(turned, ["item_id", "nick_id", "strand"]).select("item_id", "nick_id", "strand", "orientation", "fits", *longs)


ADMIT_MOTIFS, ADMIT_FLANK, RETAINED = ["CCA", "GATC"], "CA", 2


@query(
    f"""WITH RECURSIVE q AS (SELECT DISTINCT {view_sql('p_name')} AS seq FROM part WHERE length({view_sql('p_name')}) >= {RETAINED}), {IUPAC_TABLE},
e(seq, i, word) AS (SELECT seq, 0, '' FROM q UNION ALL SELECT seq, i + 1, word || b FROM (SELECT e.*, unnest(string_split(m.bases, '')) AS b FROM e JOIN m ON m.sym = substr(e.seq, e.i + 1, 1) WHERE e.i < length(e.seq))),
w AS (SELECT seq, word, word || '{ADMIT_FLANK}' AS joint FROM e WHERE i = length(seq))
SELECT seq AS template, substr(word, 1, {RETAINED}) AS retained, count(*) AS joint_words FROM w WHERE NOT regexp_matches(joint, '{scan.motif_pattern(ADMIT_MOTIFS)}') GROUP BY ALL"""
)
def admitted_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's joint words before a flank are checked whole for sites; what is retained of the admitted ones, and by how many."""
    names = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("template")).distinct().where(F.length("template") >= RETAINED)
    words = domains.expand(names.withColumn("seq", F.col("template")), ["template"], "seq", 1 << 20).withColumn("joint", F.concat("word", F.lit(ADMIT_FLANK)))
    kept = branches.admitted_words(words, "joint", ADMIT_MOTIFS, 1 << 20)
    return kept.groupBy("template", F.substring("word", 1, RETAINED).alias("retained")).agg(F.count(F.lit(1)).alias("joint_words"))


WINDOW = 4


@query(
    f"""WITH l AS (SELECT DISTINCT p_name AS release_id, {view_sql('p_name')} AS motif FROM part WHERE length({view_sql('p_name')}) > 0), n AS (SELECT *, length(motif) AS m, length(motif) + 2 AS t, length(motif) + length(motif) % 3 * 2 AS b FROM l),
o AS (SELECT release_id, 'forward' AS orientation, motif, m, t AS cut FROM n UNION ALL SELECT release_id, 'reverse', {COMPLEMENT.format('motif')}, m, m - b FROM n),
p AS (SELECT release_id, orientation, string_agg(CASE WHEN cut - {WINDOW} + i >= 0 AND cut - {WINDOW} + i < m THEN substr(motif, CAST(cut - {WINDOW} + i + 1 AS BIGINT), 1) ELSE 'N' END, '' ORDER BY i) AS pattern FROM o, range(0, {WINDOW}) r(i) GROUP BY ALL),
w AS ({words_sql('benchmark', WINDOW)}), c AS (SELECT release_id, orientation, pattern, word, bool_and(({mask_sql('substr(pattern, CAST(i + 1 AS BIGINT), 1)')} & {mask_sql('substr(word, CAST(i + 1 AS BIGINT), 1)')}) > 0) AS ok FROM p, w, range(0, {WINDOW}) r(i) GROUP BY ALL)
SELECT release_id, orientation, pattern, count(*) FILTER (ok) AS words, min(word) FILTER (ok) AS first_word FROM c GROUP BY ALL HAVING count(*) FILTER (ok) > 0"""
)
def release_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a product's end must look like for each releasing agent, and the items' words that do."""
    patterns = branches.release_windows(agents(spark, sf_dir)[1], WINDOW)
    words = scan.distinct_words(item_dna(spark, sf_dir), "dna", WINDOW)
    return branches.matching_words(words, "word", patterns).groupBy("release_id", "orientation", "pattern").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("first_word"))


@query(f"WITH w AS ({words_sql('documents', 6)}) SELECT right(word, 2) AS suffix, count(*) AS members, min(word) AS first_member, count(*) FILTER (NOT regexp_matches(word, '{scan.motif_pattern(ADMIT_MOTIFS)}')) AS admitted FROM w GROUP BY 1")
def completion_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts by the suffix that they must keep, and how many of each group hold no site."""
    words = scan.distinct_words(document_dna(spark, sf_dir), "dna", 6)
    clear = ~F.col("word").rlike(scan.motif_pattern(ADMIT_MOTIFS))
    return words.groupBy(F.expr("right(word, 2)").alias("suffix")).agg(F.count(F.lit(1)).alias("members"), F.min("word").alias("first_member"), F.count_if(clear).alias("admitted"))


@query(
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS prior, max(o_orderkey) AS now FROM orders GROUP BY o_custkey), l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS m FROM lineitem GROUP BY ALL),
a AS (SELECT o_custkey, l_linenumber, m AS a FROM f JOIN l ON l_orderkey = prior), b AS (SELECT o_custkey, l_linenumber, m AS b FROM f JOIN l ON l_orderkey = now)
SELECT o_custkey, count(*) FILTER (NOT coalesce(a = b, false)) AS changed, count(*) FILTER (coalesce(a = b, false)) AS reused FROM a FULL JOIN b USING (o_custkey, l_linenumber) GROUP BY o_custkey"""
)
def prior_material_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order against the last: lines are roles, parts are materials."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("prior"), F.max("o_orderkey").alias("now"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("material"))
    side = lambda c: orders.select("o_custkey", F.col(c).alias("l_orderkey")).join(lines, "l_orderkey")
    return branches.material_changes(side("prior"), side("now"), "o_custkey", "l_linenumber", "material")


@query(
    """WITH x AS (SELECT 'hairpin' AS stage, sha256(p_name) AS molecule, p_partkey FROM part UNION ALL SELECT 'endpoint', sha256(p_name || '|' || p_size), p_partkey FROM part)
SELECT stage, molecule, count(*) AS members, min(p_partkey) AS first_member FROM x GROUP BY ALL"""
)
def stage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by what they are at either stage: the name alone, or with the size."""
    stages = F.array(
        F.struct(F.lit("hairpin").alias("stage"), F.sha2("p_name", 256).alias("molecule")),
        F.struct(F.lit("endpoint").alias("stage"), F.sha2(F.concat_ws("|", "p_name", F.col("p_size").cast("string")), 256).alias("molecule")),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(stages))
    return rows.groupBy("stage", "molecule").agg(F.count(F.lit(1)).alias("members"), F.min("p_partkey").alias("first_member"))


@query(
    COMPOSED_SQL
    + """SELECT p_name, count(*) AS combinations, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'truncated') AS truncated, count(DISTINCT size) FILTER (status = 'accepted') AS geometry_groups, min(realization) FILTER (status = 'accepted') AS first_realization FROM o GROUP BY p_name"""
)
def foldback_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the examined composition: how their combinations came out, and the groups their realizations fall into."""
    ok = F.col("status") == "accepted"
    return composed(spark, sf_dir).groupBy("p_name").agg(
        F.count(F.lit(1)).alias("combinations"), F.count_if(ok).alias("accepted"), F.count_if(F.col("status") == "truncated").alias("truncated"),
        F.countDistinct(F.when(ok, F.col("size"))).alias("geometry_groups"), F.min(F.when(ok, F.col("realization"))).alias("first_realization"),
    )


@query(GROUP_SQL + """SELECT ordinal, l.band AS band, l.product AS left_product, r.product AS right_product FROM e JOIN l ON l.p_partkey = e."left" JOIN r ON r.p_partkey = e."right" WHERE reason IS NULL""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the members of each accepted set share, and its products."""
    pool = options(spark, sf_dir)
    sets = grouping.evaluated_sets(pool, BRIEF).where("reason IS NULL")
    side = lambda slot: pool.where(F.col("p_type") == SLOTS[slot]).select(F.col("p_partkey").alias(slot), F.col("product").alias(f"{slot}_product"), F.col("band").alias(f"{slot}_band"))
    both = sets.join(side("left"), "left").join(side("right"), "right")
    return both.select("ordinal", F.col("left_band").alias("band"), "left_product", "right_product")


@query(
    """WITH s AS (SELECT DISTINCT p_type || '-' || (p_size // 25) AS slot, p_type, p_size // 25 AS half FROM part WHERE p_retailprice < 930)
SELECT slot, count(p_partkey) AS labels, min(p_partkey) AS first_label FROM s LEFT JOIN (SELECT p_partkey, p_type, p_size // 25 AS half FROM part WHERE p_retailprice >= 930) USING (p_type, half) GROUP BY slot"""
)
def member_option_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that ask for a type and a half of the sizes, and the options that fit; a slot without any is kept."""
    parts = table(spark, sf_dir, "part").withColumn("half", F.floor(F.col("p_size") / 25))
    slots = parts.where("p_retailprice < 930").select(F.concat_ws("-", "p_type", F.col("half").cast("string")).alias("slot"), "p_type", "half").distinct()
    fits = parts.where("p_retailprice >= 930").select("p_partkey", "p_type", "half")
    return slots.join(fits, ["p_type", "half"], "left").groupBy("slot").agg(F.count("p_partkey").alias("labels"), F.min("p_partkey").alias("first_label"))


@query(f"SELECT item_id, CAST(coalesce(sum(n) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base, n AS bases FROM (SELECT item_id, length({DNA_SQL}) AS n FROM benchmark)")
def reindexed_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each item's bases begin once all items are joined end to end."""
    sizes = item_dna(spark, sf_dir).select("item_id", F.length("dna").cast("long").alias("bases"))
    return ranks.running_total(sizes, "item_id", "bases", "base").select("item_id", "base", "bases")


@query(
    f"""WITH p AS (SELECT DISTINCT {DNA_SQL.replace('text', 'p_name')} AS primer FROM part), t AS (SELECT item_id, {DNA_SQL} AS dna FROM benchmark),
b AS (SELECT item_id, primer, CASE WHEN starts_with(dna, primer) THEN 'prefix' WHEN ends_with(dna, reverse(translate(primer, 'ACGT', 'TGCA'))) THEN 'suffix' END AS binding FROM p, t WHERE primer <> '')
SELECT item_id, primer, binding FROM b WHERE binding IS NOT NULL"""
)
def primer_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names' bases as primers: which bind an item at its start, or turned round at its end."""
    primers = table(spark, sf_dir, "part").select(dna_view(F.col("p_name")).alias("primer")).distinct().where("primer <> ''")
    bound = branches.primer_binding(F.col("dna"), F.col("primer"))
    test = F.col("dna").startswith(F.col("primer")) | F.col("dna").endswith(reverse_complement(F.col("primer")))
    return item_dna(spark, sf_dir).join(primers, test).select("item_id", "primer", bound.alias("binding"))  # a catalogue's primers


@query(f"WITH s AS ({STEPS_SQL}), q AS (SELECT o_orderkey, o_custkey AS ordinal, o_orderkey % 20 + 1 AS step FROM orders) SELECT o_orderkey, ordinal, step, event_id FROM q JOIN s USING (ordinal, step)")
def step_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded step that each order asks for by target and number."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ordinal"), (F.col("o_orderkey") % 20 + 1).alias("step"))
    return asked.join(steps(spark, sf_dir).select("ordinal", F.col("step").cast("long").alias("step"), "event_id"), ["ordinal", "step"]).select("o_orderkey", "ordinal", "step", "event_id")


@query("SELECT n_nationkey, r_name AS material_id, CASE WHEN n_nationkey % 2 = 0 THEN 'source' ELSE 'primer' END AS role FROM nation JOIN region ON n_regionkey = r_regionkey")
def material_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a material by a member, beside its first use in ``set_materials``."""
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.col("r_name").alias("material_id"), F.when(F.col("n_nationkey") % 2 == 0, "source").otherwise("primer").alias("role"))
