"""Queries over searches that stop early, neighbour graphs, compositions and surveys of declared targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dna import dna_view, iupac_view
from ..operators import arms, composition, neighbour_graph as graphs, pool, stops
from .junctions import COMPLEMENT, ORACLE_SQL, QUERIES, mask_sql, view_sql
from .pools import STEPS_SQL, steps
from .sequences import query
from .tables import DNA_SQL, IUPAC_SQL, item_dna, item_symbols, table

__all__ = ["ORACLE_SQL", "QUERIES"]

LIMITS = arms.ArmLimits(replaced=2, least_terminal=3, most_run_of_thirds=2, protected=2, max_nodes=1500, max_hits=25)

ARMS_SQL = f"""WITH r AS (SELECT item_id, dna, length(dna) AS n, reverse(translate(dna, 'ACGT', 'TGCA')) AS exact FROM (SELECT item_id, {DNA_SQL} AS dna FROM benchmark) WHERE length(dna) > 0),
one AS (SELECT *, unnest(range(0, n)) AS p FROM r), two AS (SELECT *, unnest(range(p + 1, n)) AS q FROM one WHERE 9 * (p * (n - 1) - p * (p - 1) // 2) < {LIMITS.max_nodes}), d(d) AS (VALUES (0), (1), (2)),
x AS (SELECT item_id, exact, n, 0 AS ordinal, NULL AS p, NULL AS q, NULL AS a, NULL AS b FROM r
 UNION ALL SELECT item_id, exact, n, 1 + 3 * p + d, p, NULL, d, NULL FROM one, d
 UNION ALL SELECT item_id, exact, n, 1 + 3 * n + 9 * (p * (n - 1) - p * (p - 1) // 2 + q - p - 1) + 3 * a.d + b.d, p, q, a.d, b.d FROM two, d a, d b),
f AS (SELECT *, n - 1 - coalesce(q, p) AS f1, CASE WHEN q IS NOT NULL THEN n - 1 - p END AS f2, 1 + 3 * n + 9 * (n * (n - 1) // 2) AS space_size FROM x WHERE ordinal < {LIMITS.max_nodes}),
t AS (SELECT *, coalesce(f1 < {LIMITS.protected}, false) AS c2, coalesce(f1, n) < {LIMITS.least_terminal} AS c3,
 3 * CASE WHEN f1 IS NULL THEN n WHEN f2 IS NULL THEN greatest(f1, n - 1 - f1) ELSE greatest(f1, f2 - f1 - 1, n - 1 - f2) END > 2 * n AS c4 FROM f),
h AS (SELECT *, NOT (c2 OR c3 OR c4) AS ok, sum(CAST(NOT (c2 OR c3 OR c4) AS INT)) OVER (PARTITION BY item_id ORDER BY ordinal) AS so_far FROM t),
e AS (SELECT * FROM h WHERE so_far - CAST(ok AS INT) < {LIMITS.max_hits})
"""


def examined_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracts = item_dna(spark, sf_dir).where("dna <> ''")
    return stops.stopped_search(arms.arm_nodes(tracts, ["item_id"], "dna", LIMITS), ["item_id"], "ordinal", "codes", LIMITS.max_hits)


@query(
    ARMS_SQL
    + f"""SELECT item_id, any_value(space_size) AS space_size, count(*) AS examined, count(*) FILTER (ok) AS hits,
 CASE WHEN count(*) < any_value(space_size) THEN 'truncated' WHEN count(*) FILTER (ok) > 0 THEN 'complete' ELSE 'infeasible' END AS status,
 CASE WHEN count(*) < any_value(space_size) THEN CASE WHEN count(*) FILTER (ok) >= {LIMITS.max_hits} THEN 'max_hits' ELSE 'max_search_nodes' END END AS truncated_by,
 count(*) FILTER (c2) AS protected, count(*) FILTER (c3) AS terminal, count(*) FILTER (c4) AS uninterrupted FROM e GROUP BY item_id"""
)
def foldback_arm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of each whole item until enough are found: where the search stopped, why, and what it rejected up to there."""
    examined = examined_arms(spark, sf_dir)
    told = examined.groupBy("item_id").agg(*[F.count_if(F.array_contains("codes", c)).alias(n) for c, n in zip(arms.ARM_CODES, ("protected", "terminal", "uninterrupted"))])
    return stops.accounting(examined, ["item_id"], "codes", "space_size", LIMITS.max_nodes).join(told, "item_id")


@query(
    ARMS_SQL
    + """, s AS (SELECT *, substr(exact, p + 1, 1) AS po, substr(exact, q + 1, 1) AS qo FROM e WHERE ok),
v AS (SELECT *, CASE WHEN p IS NULL THEN exact ELSE substr(exact, 1, p) || substr(replace('ACGT', po, ''), a + 1, 1) || substr(exact, p + 2) END AS w FROM s)
SELECT item_id, ordinal, CASE WHEN q IS NULL THEN w ELSE substr(w, 1, q) || substr(replace('ACGT', qo, ''), b + 1, 1) || substr(w, q + 2) END AS arm FROM v"""
)
def foldback_arm_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.with_arms(examined_arms(spark, sf_dir).where(F.size("codes") == 0), "dna").select("item_id", "ordinal", "arm")


NAMES_SQL = f"SELECT DISTINCT dna FROM (SELECT {DNA_SQL.replace('text', 'p_name')} AS dna FROM part) WHERE dna <> ''"


@query(
    f"""WITH r AS (SELECT dna, length(dna) AS n, reverse(translate(dna, 'ACGT', 'TGCA')) AS exact FROM ({NAMES_SQL})), d(d) AS (VALUES (0), (1), (2)), one AS (SELECT *, unnest(range(0, n)) AS p FROM r), two AS (SELECT *, unnest(range(p + 1, n)) AS q FROM one),
x AS (SELECT dna, exact AS arm, 0 AS replaced, -1 AS p, -1 AS q, 0 AS a, 0 AS b FROM r
 UNION ALL SELECT dna, substr(exact, 1, p) || substr(replace('ACGT', substr(exact, p + 1, 1), ''), d + 1, 1) || substr(exact, p + 2), 1, p, -1, d, 0 FROM one, d
 UNION ALL SELECT dna, substr(exact, 1, p) || substr(replace('ACGT', substr(exact, p + 1, 1), ''), a.d + 1, 1) || substr(exact, p + 2, q - p - 1) || substr(replace('ACGT', substr(exact, q + 1, 1), ''), b.d + 1, 1) || substr(exact, q + 2), 2, p, q, a.d, b.d FROM two, d a, d b)
SELECT dna, arm, replaced, row_number() OVER (PARTITION BY dna ORDER BY replaced, p, q, a, b) - 1 AS rank FROM x"""
)
def foldback_arm_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms of each part name's bases with at most two replaced: the exact arm, then tier by tier."""
    tracts = table(spark, sf_dir, "part").select(dna_view(F.col("p_name")).alias("dna")).distinct().where("dna <> ''")
    every = arms.ArmLimits(replaced=2, least_terminal=0, most_run_of_thirds=3, protected=0, max_nodes=1 << 30, max_hits=1)
    nodes = arms.with_arms(arms.arm_nodes(tracts, [], "dna", every), "dna")
    return nodes.select("dna", "arm", F.size("places").alias("replaced"), F.col("ordinal").alias("rank"))


@query(
    f"""SELECT item_id, n AS bases, k AS replaced, CAST(1 + CASE WHEN k >= 1 THEN 3 * n ELSE 0 END + CASE WHEN k >= 2 THEN 9 * (n * (n - 1) // 2) ELSE 0 END + CASE WHEN k >= 3 THEN 27 * (n * (n - 1) * (n - 2) // 6) ELSE 0 END AS BIGINT) AS candidates
FROM (SELECT item_id, length({DNA_SQL}) AS n FROM benchmark), range(0, 4) t(k)"""
)
def arm_candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many arms of an item have at most k replaced bases, without making them."""
    n = F.length("dna")
    cells = F.array(*[F.struct(F.lit(k).cast("long").alias("replaced"), arms.arm_count(n, k).alias("candidates")) for k in range(4)])
    return item_dna(spark, sf_dir).select("item_id", n.cast("long").alias("bases"), F.inline(cells))


PRE_NODES, PRE_HITS, PRE_START, PRE_TRACT = 32, 20, 1, 8


def laid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's symbols as a template, with the motif of each part type laid on it."""
    motifs = table(spark, sf_dir, "part").select(F.col("p_type").alias("nick_id"), iupac_view(F.col("p_type")).alias("motif")).distinct().where("motif <> ''")
    items = item_symbols(spark, sf_dir).select("item_id", F.col("seq").alias("template"))
    # Part types are a vocabulary; Spark broadcasts them only below its own threshold.
    pairs = items.join(motifs, F.length("template") >= F.greatest(F.lit(PRE_START) + F.length("motif"), F.lit(PRE_TRACT)))
    return pairs.withColumns({"start": F.lit(PRE_START), "tract": F.lit(PRE_TRACT)})


PRE_SQL = f"""WITH m AS (SELECT DISTINCT p_type AS nick_id, {view_sql('p_type')} AS motif FROM part WHERE length({view_sql('p_type')}) > 0),
q AS (SELECT item_id, nick_id, motif, seq FROM (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark), m WHERE length(seq) >= greatest({PRE_START} + length(motif), {PRE_TRACT})),
c AS (SELECT *, unnest(range(0, length(seq))) AS i FROM q),
k AS (SELECT item_id, nick_id, i, {mask_sql('substr(seq, i + 1, 1)')} & CASE WHEN i >= {PRE_START} AND i < {PRE_START} + length(motif) THEN {mask_sql(f'substr(motif, i - {PRE_START} + 1, 1)')} ELSE 15 END AS mask FROM c),
o AS (SELECT *, concat(CASE WHEN mask & 1 > 0 THEN 'A' END, CASE WHEN mask & 2 > 0 THEN 'C' END, CASE WHEN mask & 4 > 0 THEN 'G' END, CASE WHEN mask & 8 > 0 THEN 'T' END) AS choices FROM k),
s AS (SELECT *, CAST(least(1e18, coalesce(product(length(choices)) OVER (PARTITION BY item_id, nick_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS BIGINT) AS stride FROM o),
z AS (SELECT item_id, nick_id, CAST(least(1e18, product(length(choices))) AS BIGINT) AS space_size FROM o GROUP BY ALL),
n AS (SELECT *, unnest(range(0, least(space_size, {PRE_NODES}))) AS ordinal FROM z),
w AS (SELECT item_id, nick_id, ordinal, string_agg(substr(choices, CAST((ordinal // stride) % length(choices) + 1 AS BIGINT), 1), '' ORDER BY i) AS precursor FROM n JOIN s USING (item_id, nick_id) GROUP BY ALL),
g AS (SELECT w.*, motif, {COMPLEMENT.format('motif')} AS turned, precursor || reverse(translate(substr(precursor, length(precursor) - {PRE_TRACT - 1}), 'ACGT', 'TGCA')) AS designed FROM w JOIN m USING (nick_id)),
y AS (SELECT DISTINCT motif, turned, length(motif) AS size, unnest(range(0, length(motif))) AS k FROM g),
l AS (SELECT item_id, nick_id, ordinal, motif, size_of, designed, unnest(range(0, length(designed) - size_of + 1)) AS spot FROM (SELECT *, length(motif) AS size_of FROM g)),
b AS (SELECT item_id, nick_id, ordinal, spot, bool_and(({mask_sql('substr(y.motif, k + 1, 1)')} & {mask_sql('substr(designed, spot + k + 1, 1)')}) > 0) AS fwd,
 bool_and(({mask_sql('substr(y.turned, k + 1, 1)')} & {mask_sql('substr(designed, spot + k + 1, 1)')}) > 0) AND any_value(y.motif <> y.turned) AS rev FROM l JOIN y USING (motif) GROUP BY ALL),
e AS (SELECT item_id, nick_id, ordinal, count(*) FILTER (fwd) + count(*) FILTER (rev) > 1 AS extra FROM b GROUP BY ALL)
"""


@query(
    PRE_SQL
    + f"""SELECT item_id, nick_id, space_size, count(ordinal) AS examined, count(*) FILTER (NOT extra) AS observed, count(*) FILTER (extra) AS extra_site, CAST(space_size = 0 AS BIGINT) AS domain_conflict,
 least(count(*) FILTER (NOT extra), {PRE_HITS}) AS returned, CASE WHEN count(ordinal) < space_size OR count(*) FILTER (NOT extra) > {PRE_HITS} THEN 'truncated' WHEN count(*) FILTER (NOT extra) > 0 THEN 'complete' ELSE 'infeasible' END AS status,
 concat_ws(',', CASE WHEN count(ordinal) < space_size THEN 'max_search_nodes' END, CASE WHEN count(*) FILTER (NOT extra) > {PRE_HITS} THEN 'max_hits' END) AS truncated_by
FROM z LEFT JOIN e USING (item_id, nick_id) GROUP BY item_id, nick_id, space_size"""
)
def precursor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precursors within each item's template that hold one site alone: rejections by code, and both budgets."""
    return arms.precursor_search(arms.precursor_nodes(laid_requests(spark, sf_dir), ["item_id", "nick_id"], PRE_NODES), ["item_id", "nick_id"], PRE_NODES, PRE_HITS)


@query(PRE_SQL + f"SELECT item_id, nick_id, ordinal, designed FROM g JOIN e USING (item_id, nick_id, ordinal) WHERE NOT extra QUALIFY row_number() OVER (PARTITION BY item_id, nick_id ORDER BY ordinal) <= {PRE_HITS}")
def precursor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits that are returned, in order of their words: of a group's few nodes the first without another site."""
    from pyspark.sql import Window

    nodes = arms.precursor_nodes(laid_requests(spark, sf_dir), ["item_id", "nick_id"], PRE_NODES).where(F.size("codes") == 0)
    place = F.row_number().over(Window.partitionBy("item_id", "nick_id").orderBy("ordinal"))
    return nodes.withColumn("_place", place).where(F.col("_place") <= PRE_HITS).select("item_id", "nick_id", "ordinal", "designed")


COMPARED = graphs.Comparison("p_partkey", ("p_size", "band"), ("p_name",), ("p_brand", "p_type"), (2.0, 1.0, 1.0))
SETTINGS = graphs.Settings(candidates=256)
COMPARED_SQL = f"""WITH r AS (SELECT p_partkey, p_size, CAST(floor(p_retailprice / 10) AS BIGINT) AS band, p_name, p_brand, p_type FROM part),
s AS (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) AS r1, CAST(max(band) - min(band) AS DOUBLE) AS r2 FROM r),
c AS (SELECT p_partkey, sha256(coalesce(CAST(p_size AS VARCHAR), '-') || '|' || coalesce(CAST(band AS VARCHAR), '-')) AS structural_class FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY structural_class ORDER BY sha256('{SETTINGS.seed}:' || p_partkey)) AS turn FROM c),
q AS (SELECT p_partkey, structural_class FROM t ORDER BY turn, sha256('{SETTINGS.seed}:' || structural_class), p_partkey LIMIT {SETTINGS.audited}),
d AS (SELECT a.p_partkey AS a, b.p_partkey AS b, round((2.0 * ((CASE WHEN r1 > 0 THEN abs(a.p_size - b.p_size) / r1 ELSE 0 END) + (CASE WHEN r2 > 0 THEN abs(a.band - b.band) / r2 ELSE 0 END)) / greatest(1, CAST(r1 > 0 AS INT) + CAST(r2 > 0 AS INT))
 + least(1.0, greatest(0.0, (levenshtein(a.p_name, b.p_name) - abs(length(a.p_name) - length(b.p_name))) / greatest(1, least(length(a.p_name), length(b.p_name)))))
 + (CAST(a.p_brand <> b.p_brand AS DOUBLE) + CAST(a.p_type <> b.p_type AS DOUBLE)) / 2) / (CASE WHEN r1 > 0 OR r2 > 0 THEN 4.0 ELSE 2.0 END), 9) AS distance
 FROM q JOIN r a USING (p_partkey), r b, s WHERE a.p_partkey <> b.p_partkey),
n AS (SELECT a, count(*) AS wanted, max(distance) AS bound FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= {SETTINGS.neighbours}) GROUP BY a)
"""


def part_graph(spark: SparkSession, sf_dir: str) -> graphs.Graph:
    parts = table(spark, sf_dir, "part").withColumn("band", F.floor(F.col("p_retailprice") / 10))
    return graphs.exact_graph(parts, COMPARED, SETTINGS)


@query(COMPARED_SQL + "SELECT a AS p_partkey, structural_class, wanted, bound, CAST(1.0 AS DOUBLE) AS recall FROM n JOIN q ON q.p_partkey = n.a")
def neighbor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the graph for a stratified sample: with 15 neighbours, 0.95 leaves no room for a missing one."""
    return part_graph(spark, sf_dir).audit.select(F.col("a").alias("p_partkey"), "structural_class", "wanted", "bound", "recall")


@query(COMPARED_SQL + f"SELECT (SELECT count(*) FROM r) AS signatures, (SELECT count(DISTINCT structural_class) FROM c) AS structural_classes, (SELECT count(*) FROM q) AS audited, (SELECT count(*) * least(count(*) - 1, {SETTINGS.neighbours}) FROM r) AS edges, true AS recall_met, true AS candidates_bounded")
def neighbor_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's receipt: what was compared, kept and audited."""
    parts = table(spark, sf_dir, "part").withColumn("band", F.floor(F.col("p_retailprice") / 10))
    found = part_graph(spark, sf_dir)
    rows = parts.agg(F.count(F.lit(1)).alias("signatures"), F.countDistinct(graphs.structural_class(COMPARED.shape)).alias("structural_classes"))
    audit = found.audit.agg(F.count(F.lit(1)).alias("audited"), (F.min("recall") >= SETTINGS.recall).alias("recall_met"))
    bounded = found.candidates <= SETTINGS.bound
    edges = found.edges.agg(F.count(F.lit(1)).alias("edges"))
    return rows.crossJoin(audit).crossJoin(edges).withColumn("candidates_bounded", F.lit(bounded))  # one row each


COMBINATIONS, REALIZATIONS = 6000, 300


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name by brand by type, each combination against the parts that realize it."""
    parts = table(spark, sf_dir, "part")
    axes = {c: parts.select(c).where(F.col(c).isNotNull()).distinct() for c in ("p_name", "p_brand", "p_type")}
    realized = parts.groupBy(*axes).agg(
        F.count(F.lit(1)).alias("programs"), F.min("p_partkey").alias("realization"), F.min("p_retailprice").alias("price"), F.min_by("p_size", "p_partkey").alias("size")
    )
    rows = composition.product_nodes(axes, COMBINATIONS).join(realized, list(axes), "left")
    reason = (
        F.when(F.col("programs").isNull(), "no_preparation").when(F.col("programs") > 1, "program_budget").when(F.col("price") >= 990, "scaffold_outside_request")
    )
    status = F.when(reason.isNull(), composition.ACCEPTED).when(reason == "program_budget", composition.TRUNCATED).otherwise(composition.REJECTED)
    return composition.dispositions(rows.withColumn("reason", reason).withColumn("status", status), REALIZATIONS)


COMPOSED_SQL = f"""WITH a AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i FROM (SELECT DISTINCT p_name FROM part)), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS j FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part)),
x AS (SELECT (i * (SELECT count(*) FROM b) + j) * (SELECT count(*) FROM c) + k AS ordinal, p_name, p_brand, p_type FROM a, b, c),
g AS (SELECT p_name, p_brand, p_type, count(*) AS programs, min(p_partkey) AS realization, min(p_retailprice) AS price, arg_min(p_size, p_partkey) AS size FROM part GROUP BY ALL),
e AS (SELECT x.*, programs, realization, size, CASE WHEN programs IS NULL THEN 'no_preparation' WHEN programs > 1 THEN 'program_budget' WHEN price >= 990 THEN 'scaffold_outside_request' END AS reason FROM x LEFT JOIN g USING (p_name, p_brand, p_type) WHERE ordinal < {COMBINATIONS}),
f AS (SELECT *, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'program_budget' THEN 'truncated' ELSE 'rejected' END AS status, coalesce(sum(CAST(reason IS NULL AS INT)) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM e),
o AS (SELECT * FROM f WHERE earlier < {REALIZATIONS})
"""


@query(
    COMPOSED_SQL
    + """SELECT ordinal, p_name, p_brand, p_type, status, reason, CASE WHEN status = 'accepted' THEN realization END AS realization, CASE WHEN status = 'accepted' THEN 'size-' || size END AS geometry_group,
 CASE WHEN status = 'accepted' THEN sha256(p_name || '|' || size) END AS product_group, CASE WHEN status = 'accepted' THEN length(p_name) ELSE 0 END AS source_nt, coalesce(programs, 0) AS programs FROM o"""
)
def composition_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a combination in order, with its realization, groups and sizes; what is not accepted has none."""
    ok = F.col("status") == composition.ACCEPTED
    return composed(spark, sf_dir).select(
        "ordinal", "p_name", "p_brand", "p_type", "status", "reason",
        F.when(ok, F.col("realization")).alias("realization"),
        F.when(ok, F.concat(F.lit("size-"), F.col("size").cast("string"))).alias("geometry_group"),
        F.when(ok, F.sha2(F.concat_ws("|", "p_name", F.col("size").cast("string")), 256)).alias("product_group"),
        F.when(ok, F.length("p_name")).otherwise(0).cast("long").alias("source_nt"),
        F.coalesce("programs", F.lit(0)).alias("programs"),
    )


@query(
    COMPOSED_SQL
    + f""", n AS (SELECT (SELECT count(*) FROM x) AS nominal, count(*) AS examined, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'truncated') AS truncated FROM o),
m AS (SELECT *, CASE WHEN accepted >= {REALIZATIONS} AND examined < least(nominal, {COMBINATIONS}) THEN 'max_realizations' WHEN examined < nominal THEN 'max_combinations' END AS truncated_by FROM n)
SELECT *, CASE WHEN truncated_by IS NOT NULL OR truncated > 0 THEN 'truncated' WHEN accepted > 0 THEN 'complete' ELSE 'infeasible' END AS state FROM m"""
)
def composition_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition.composition_summary(composed(spark, sf_dir), COMBINATIONS, REALIZATIONS)


SURVEY_SQL = f"""WITH t AS (SELECT c_custkey AS ordinal, c_nationkey AS left_word, c_mktsegment AS right_word FROM customer), s AS (SELECT ordinal, sum(witness) AS w, max(exhausted) AS e FROM ({STEPS_SQL}) GROUP BY ordinal),
j AS (SELECT t.*, s.ordinal IS NOT NULL AS seen, coalesce(w, 0) > 0 AS supported, coalesce(w, 0) = 0 AND coalesce(e, 0) = 1 AS excluded FROM t LEFT JOIN s USING (ordinal))
SELECT count(*) AS targets, count(*) FILTER (seen) AS examined, count(*) FILTER (supported) AS supported, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT supported AND NOT excluded) AS unresolved, count(*) FILTER (NOT seen) AS unexamined,
 count(DISTINCT left_word) FILTER (supported) AS left_words, count(DISTINCT right_word) FILTER (supported) AS right_words, (SELECT count(*) FROM s WHERE ordinal NOT IN (SELECT ordinal FROM t)) AS undeclared FROM j"""


@query(SURVEY_SQL)
def survey_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are the declared targets, events their steps: what is known of each, and what is not."""
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_nationkey").alias("left_word"), F.col("c_mktsegment").alias("right_word"))
    return pool.survey_coverage(targets, steps(spark, sf_dir))
