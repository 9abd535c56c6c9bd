"""Queries over whole foldbacks, released states, paired domains, programs, processing geometry and design spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dna import cardinality, dna_view, iupac_view, masks, reverse_complement
from ..operators import composition, enumerate as domains, geometry, partitions, pool, populations, processing, ranks
from .assemblies import BUDGET, MEMBERS_SQL, PARTITION_SQL
from .junctions import COMPLEMENT, agents, mask_sql, view_sql
from .pools import B, S, SELECTIONS, T
from .records import ORACLE_SQL, QUERIES
from .sequences import query
from .tables import DNA_SQL, IUPAC_SQL, item_dna, item_symbols, table

__all__ = ["ORACLE_SQL", "QUERIES"]

FOLD = {"max_mismatches": 2, "terminal_min": 2, "terminal_max": 12, "max_run": 12, "max_added": 24, "turn_nt": 40}
EXTENSION = "AC"


@query(
    f"""WITH s AS (SELECT item_id, dna, length(dna) // 3 AS k FROM (SELECT item_id, {DNA_SQL} AS dna FROM benchmark) WHERE length(dna) >= 12),
a AS (SELECT *, substr(dna, 1, k) AS tract, CASE WHEN item_id % 2 = 0 THEN reverse(translate(substr(dna, 1, k), 'ACGT', 'TGCA')) ELSE right(dna, k) END AS arm FROM s),
f AS (SELECT *, list_filter(range(0, k), lambda i: substr(tract, i + 1, 1) <> substr(reverse(translate(arm, 'ACGT', 'TGCA')), i + 1, 1)) AS faults FROM a),
e AS (SELECT *, list_concat(list_concat([-1], faults), [k]) AS e FROM f), r AS (SELECT *, list_transform(range(1, len(e)), lambda j: e[j + 1] - e[j] - 1) AS runs, length(dna) - k + {len(EXTENSION)} AS turn_nt, {len(EXTENSION)} + k AS added_nt FROM e)
SELECT item_id, CAST(len(faults) AS BIGINT) AS mismatches, CAST(runs[1] AS BIGINT) AS terminal, CAST(list_max(runs) AS BIGINT) AS longest, CAST(added_nt AS BIGINT) AS added_nt, CAST(turn_nt AS BIGINT) AS turn_nt, sha256(dna || '{EXTENSION}' || arm) AS designed,
 concat_ws(',', CASE WHEN len(faults) > {FOLD['max_mismatches']} THEN 'FOLD-001' END, CASE WHEN len(list_filter(faults, lambda i: i >= 1 AND i < 4)) > 0 THEN 'FOLD-002' END, CASE WHEN runs[1] NOT BETWEEN {FOLD['terminal_min']} AND {FOLD['terminal_max']} THEN 'FOLD-003' END,
  CASE WHEN list_max(runs) > {FOLD['max_run']} THEN 'FOLD-004' END, CASE WHEN added_nt > {FOLD['max_added']} THEN 'FOLD-005' END, CASE WHEN turn_nt <> {FOLD['turn_nt']} THEN 'FOLD-006' END) AS codes FROM r"""
)
def foldback_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole item folded back on its first third: exact arms for even items, the item's own end for odd ones; all faults at once."""
    items = item_dna(spark, sf_dir).where(F.length("dna") >= 12).withColumnRenamed("dna", "precursor")
    k = F.floor(F.length("precursor") / 3).cast("int")
    tract = F.substring(F.col("precursor"), F.lit(1), k)
    arm = F.when(F.col("item_id") % 2 == 0, reverse_complement(tract)).otherwise(F.substring(F.col("precursor"), F.length("precursor") - k + 1, k))
    rows = items.withColumns({"start": F.lit(0), "stop": k, "extension": F.lit(EXTENSION), "arm": arm, "protected_start": F.lit(1), "protected_stop": F.lit(4)})
    told = processing.evaluated_foldback(rows, FOLD)
    numbers = [F.col(c).cast("long").alias(c) for c in ("terminal", "longest", "added_nt", "turn_nt")]
    return told.select("item_id", F.size("faults").cast("long").alias("mismatches"), *numbers, F.sha2("designed", 256).alias("designed"), F.array_join("codes", ",").alias("codes"))


STATE_SQL = f"""{PARTITION_SQL}, v AS (SELECT item_id, min(boundary) FILTER (strand = 'top') AS nt, min(boundary) FILTER (strand = 'bottom') AS nb, max(boundary) FILTER (strand = 'top') AS top_cut, max(boundary) FILTER (strand = 'bottom') AS bottom_cut FROM x GROUP BY item_id),
g AS (SELECT item_id, 'bottom' AS active, nt AS nick, top_cut, bottom_cut, bottom_cut AS own, top_cut AS other FROM v UNION ALL SELECT item_id, 'top', nb, top_cut, bottom_cut, top_cut, bottom_cut FROM v),
c1 AS (SELECT g.*, s.dna, s.n, concat_ws(',', CASE WHEN nick <= 0 OR nick >= s.n THEN 'nick_outside_precursor' END, CASE WHEN least(top_cut, bottom_cut) < 0 OR greatest(top_cut, bottom_cut) > s.n THEN 'cut_outside_precursor' END,
 CASE WHEN own <= nick THEN 'cut_not_downstream_of_nick' END, CASE WHEN other < own THEN 'incomplete_separation' END) AS codes FROM g JOIN s USING (item_id) WHERE nick IS NOT NULL AND top_cut IS NOT NULL AND bottom_cut IS NOT NULL)
"""


@query(
    STATE_SQL
    + """SELECT item_id, active, codes, CASE WHEN codes = '' THEN CASE active WHEN 'top' THEN substr(dna, nick + 1, own - nick) ELSE reverse(translate(substr(dna, nick + 1, own - nick), 'ACGT', 'TGCA')) END END AS active_product,
 CASE WHEN codes = '' THEN CASE active WHEN 'top' THEN reverse(translate(substr(dna, 1, nick), 'ACGT', 'TGCA')) ELSE substr(dna, 1, nick) END END AS retained_partner,
 CASE WHEN codes = '' THEN CASE active WHEN 'top' THEN nick ELSE own - 1 END END AS first_origin, CASE WHEN codes = '' THEN CASE active WHEN 'top' THEN own - 1 ELSE nick END END AS last_origin FROM c1"""
)
def released_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items nicked at their first site of a strand and cut at the last of both: what becomes of each strand, base by base."""
    sources = item_dna(spark, sf_dir).where("dna <> ''")
    sites = partitions.nick_sites(sources, agents(spark, sf_dir)[0].withColumnRenamed("nick_id", "agent_id"), "item_id", "dna")
    edge = lambda f, s, name: f(F.when(F.col("strand") == s, F.col("boundary"))).alias(name)
    ends = sites.groupBy("item_id").agg(edge(F.min, "top", "_nt"), edge(F.min, "bottom", "_nb"), edge(F.max, "top", "top_cut"), edge(F.max, "bottom", "bottom_cut"))
    cases = F.inline(F.array(F.struct(F.lit("bottom").alias("active"), F.col("_nt").alias("nick")), F.struct(F.lit("top").alias("active"), F.col("_nb").alias("nick"))))
    rows = ends.select("item_id", "top_cut", "bottom_cut", cases).where("nick IS NOT NULL AND top_cut IS NOT NULL AND bottom_cut IS NOT NULL")
    told = processing.released_state(rows.join(sources.withColumnRenamed("dna", "precursor"), "item_id"))
    return told.select(
        "item_id", "active", F.array_join("codes", ",").alias("codes"), "active_product", "retained_partner",
        F.get("active_origins", F.lit(0)).alias("first_origin"), F.element_at("active_origins", -1).alias("last_origin"),
    )


PARTNER_LIST = "[" + ",".join(str(sum(1 << i for i in range(4) if any((m >> b) & 1 and (processing.PARTNERS[True][1 << b] >> i) & 1 for b in range(4)))) for m in range(16)) + "]"


@query(
    f"""WITH q AS (SELECT DISTINCT {view_sql('p_name')} AS name, {view_sql('p_type')} AS kind FROM part), p AS (SELECT *, unnest(range(0, length(name))) AS i FROM q WHERE length(name) = length(kind)),
m AS (SELECT name, kind, i, {mask_sql('substr(name, i + 1, 1)')} & {PARTNER_LIST}[{mask_sql('substr(kind, i + 1, 1)')} + 1] AS s, {mask_sql('substr(kind, i + 1, 1)')} & {PARTNER_LIST}[{mask_sql('substr(name, i + 1, 1)')} + 1] AS a FROM p),
g AS (SELECT name, kind, string_agg(substr('-ACMGRSVTWYHKDBN', CAST(s + 1 AS BIGINT), 1), '' ORDER BY i) AS source_domain, string_agg(substr('-ACMGRSVTWYHKDBN', CAST(a + 1 AS BIGINT), 1), '' ORDER BY i) AS adapter_domain, min(i) FILTER (s = 0) AS bad FROM m GROUP BY ALL)
SELECT name, kind, source_domain, adapter_domain, CASE WHEN length(name) <> length(kind) THEN 'lengths_differ' WHEN bad IS NOT NULL THEN 'no_pair_at_' || bad END AS failure FROM q LEFT JOIN g USING (name, kind) WHERE name <> ''"""
)
def paired_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against types, place by place: the bases that can still pair, or why there are none."""
    pairs = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("name"), iupac_view(F.col("p_type")).alias("kind")).distinct().where("name <> ''")
    return processing.paired_domains(pairs, "name", "kind", True)


@query(
    f"""WITH k AS (SELECT DISTINCT p_type AS nick_id, {view_sql('p_type')} AS nick_motif FROM part WHERE length({view_sql('p_type')}) > 0), l AS (SELECT DISTINCT p_name AS release_id, {view_sql('p_name')} AS release_motif FROM part WHERE length({view_sql('p_name')}) > 0),
o AS (SELECT *, unnest(['forward', 'reverse']) AS orientation FROM k), a AS (SELECT 'single' AS kind, nick_id, orientation, NULL AS release_id FROM o
 UNION ALL SELECT 'two', nick_id, orientation, release_id FROM o, l WHERE length(release_motif) >= 2 AND NOT contains(release_motif, nick_motif) AND (orientation = 'forward' OR length(nick_motif) > 1))
SELECT row_number() OVER (ORDER BY (CASE kind WHEN 'single' THEN '0' ELSE '1' END) || '|' || nick_id || '|' || orientation || '|' || coalesce(release_id, '')) - 1 AS ordinal, kind, nick_id, orientation, release_id FROM a"""
)
def enzyme_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as nicking agents, alone and with each name that may release after them, in canonical order."""
    nicks, releases = agents(spark, sf_dir)
    clear = ~F.contains("release_motif", "nick_motif") & (F.length("release_motif") >= 2)
    return processing.programs(nicks, releases, clear & ((F.col("orientation") == "forward") | (F.length("nick_motif") > 1)))


@query(
    """WITH r AS (SELECT p_type, p_size, CASE WHEN p_retailprice >= 990 THEN 'price' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand' END AS reason FROM part),
c AS (SELECT p_type, p_size, count(*) AS examined, count(*) FILTER (reason IS NULL) AS accepted, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM r WHERE p_size BETWEEN 0 AND 60 GROUP BY ALL),
g AS (SELECT r.p_type, CAST(i AS INTEGER) AS p_size, coalesce(examined, 0) AS examined, coalesce(accepted, 0) AS accepted, coalesce(reasons, '') AS reasons FROM (SELECT DISTINCT p_type FROM r) CROSS JOIN range(0, 61) t(i) LEFT JOIN c ON c.p_type = r.p_type AND c.p_size = i),
s AS (SELECT *, CAST(sum(accepted) OVER (PARTITION BY p_type ORDER BY p_size) AS BIGINT) AS so_far FROM g)
SELECT *, CASE WHEN so_far - accepted >= 40 THEN 'unvisited' WHEN so_far >= 40 THEN 'quota_met' WHEN examined = 0 THEN 'empty' ELSE 'complete' END AS status FROM s""".replace("(SELECT DISTINCT p_type FROM r) CROSS", "(SELECT DISTINCT p_type FROM r) r CROSS")
)
def basal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every size from 0 to 60 as a level of each type, until forty parts are accepted."""
    reason = F.when(F.col("p_retailprice") >= 990, "price").when(F.col("p_brand").isin("Brand#1", "Brand#2"), "brand")
    return processing.integer_levels(table(spark, sf_dir, "part").withColumn("reason", reason), "p_type", "p_size", "reason", 60, 40)


POST = "RYNN"
GEOMETRY_SQL = f"""WITH k AS (SELECT DISTINCT p_type AS nick_id, {view_sql('p_type')} AS motif FROM part WHERE length({view_sql('p_type')}) > 0), l AS (SELECT motif, row_number() OVER (ORDER BY release_id) - 1 AS r FROM (SELECT DISTINCT p_name AS release_id, {view_sql('p_name')} AS motif FROM part WHERE length({view_sql('p_name')}) > 0)),
s AS (SELECT item_id, seq, length(seq) AS n, length(seq) // 2 AS t, nick_id, k.motif AS nm, l.motif AS rm FROM (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark) CROSS JOIN k JOIN l ON l.r = item_id % (SELECT count(*) FROM l) WHERE length(seq) > 0),
y AS (SELECT item_id, nick_id, 0 AS start, seq AS word FROM s UNION ALL SELECT item_id, nick_id, t - length(nm) - 1, nm FROM s UNION ALL SELECT item_id, nick_id, -length(rm), rm FROM s UNION ALL SELECT item_id, nick_id, t, '{POST}' FROM s),
e AS (SELECT item_id, nick_id, start + i AS c, bit_and({mask_sql('substr(word, i + 1, 1)')}) AS mask FROM (SELECT *, unnest(range(0, length(word))) AS i FROM y) GROUP BY ALL),
g AS (SELECT item_id, nick_id, count(*) AS coordinates, count(*) FILTER (mask = 0) AS conflicts, round(sum(CASE WHEN mask > 0 THEN log2(bit_count(mask)) ELSE 0 END), 6) AS log2_choices FROM e GROUP BY ALL),
b AS (SELECT g.*, concat_ws(',', CASE WHEN conflicts > 0 THEN 'base_domain_conflict' END, CASE WHEN t - length(nm) - 1 < -length(rm) THEN 'nick_site_before_release_site' END, CASE WHEN t + {len(POST)} > n THEN 'post_nick_template_outside' END) AS blockers FROM g JOIN s USING (item_id, nick_id))
"""


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole item with each nicking agent cutting at its middle, a release site before it and a template behind the nick."""
    nicks, releases = agents(spark, sf_dir)
    ranked = ranks.rank_within(releases.select("release_id", F.col("motif").alias("rm")), "release_id", "r")
    items = item_symbols(spark, sf_dir).where("seq <> ''").withColumn("r", F.col("item_id") % F.lit(releases.count()))
    laid = items.join(ranked.select("r", "rm"), "r").crossJoin(nicks.select("nick_id", F.col("motif").alias("nm")))  # a catalogue
    laid = laid.withColumn("t", F.floor(F.length("seq") / 2).cast("int"))
    keys, layer = ["item_id", "nick_id"], lambda word, at: geometry.coordinate_masks(laid.withColumn("_w", word), ["item_id", "nick_id"], "_w", at)
    layers = layer(F.col("seq"), F.lit(0))
    for word, at in ((F.col("nm"), F.col("t") - F.length("nm") - 1), (F.col("rm"), -F.length("rm")), (F.lit(POST), F.col("t"))):
        layers = layers.unionByName(layer(word, at))
    met = geometry.intersected(layers, keys).join(laid, keys)
    tests = [
        ("base_domain_conflict", F.col("conflicts") > 0),
        ("nick_site_before_release_site", F.col("t") - F.length("nm") - 1 < -F.length("rm")),
        ("post_nick_template_outside", F.col("t") + len(POST) > F.length("seq")),
    ]
    return met.withColumn("blockers", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


@query(GEOMETRY_SQL + "SELECT item_id, nick_id, coordinates, conflicts, log2_choices, blockers FROM b")
def processing_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers of base sets on signed coordinates, intersected, with what forbids the agent."""
    return processed(spark, sf_dir).select("item_id", "nick_id", "coordinates", "conflicts", "log2_choices", F.array_join("blockers", ",").alias("blockers"))


AGENT_NODES, AGENT_HITS = 4, 2


@query(
    GEOMETRY_SQL
    + f""", o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY nick_id) - 1 AS ordinal FROM b), p AS (SELECT *, sum(CAST(blockers = '' AS INT)) OVER (PARTITION BY item_id ORDER BY ordinal) AS place FROM o WHERE ordinal < {AGENT_NODES})
SELECT item_id, nick_id, ordinal, blockers, CASE WHEN blockers = '' AND place <= {AGENT_HITS} THEN CAST(place AS BIGINT) END AS hit FROM p"""
)
def basal_processing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first agents by id for each item: what forbids each, and the hits in the same order."""
    found = processing.bounded_agents(processed(spark, sf_dir).select("item_id", "nick_id", "blockers"), ["item_id"], "nick_id", AGENT_NODES, AGENT_HITS)
    return found.select("item_id", "nick_id", F.col("ordinal").cast("long").alias("ordinal"), F.array_join("blockers", ",").alias("blockers"), F.col("hit").cast("long").alias("hit"))


SITE_HITS, REACH, TURN = 3, 15, 4


@query(
    f"""{PARTITION_SQL}, q AS (SELECT x.item_id, x.agent_id, strand, boundary, abs(boundary - n // 2) AS displacement, n - boundary AS turn FROM x JOIN s USING (item_id) JOIN (SELECT agent_id, row_number() OVER (ORDER BY agent_id) AS i FROM k) USING (agent_id) WHERE i <= {AGENT_NODES})
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY displacement, boundary, agent_id, strand) AS place, agent_id, strand, CAST(boundary AS BIGINT) AS boundary, CAST(displacement AS BIGINT) AS displacement FROM q WHERE displacement <= {REACH} AND turn >= {TURN} QUALIFY place <= {SITE_HITS}"""
)
def nicking_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first agents by id on each item: their sites nearest to its middle, exact ones first, with a turn behind them."""
    sources = item_dna(spark, sf_dir).where("dna <> ''")
    nicks = agents(spark, sf_dir)[0].withColumnRenamed("nick_id", "agent_id")
    first = nicks.orderBy("agent_id").limit(AGENT_NODES)
    sites = partitions.nick_sites(sources, first, "item_id", "dna").join(sources.select("item_id", F.length("dna").alias("n")), "item_id")
    near = sites.withColumn("displacement", F.abs(F.col("boundary") - F.floor(F.col("n") / 2)).cast("long"))
    near = near.where((F.col("displacement") <= REACH) & (F.col("n") - F.col("boundary") >= TURN))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("displacement", "boundary", "agent_id", "strand"))
    return near.withColumn("place", place).where(F.col("place") <= SITE_HITS).select("item_id", "place", "agent_id", "strand", F.col("boundary").cast("long").alias("boundary"), "displacement")


SYMBOL_RUN = "[ACGTRYSWKMBDHVNacgtryswkmbdhvn]+"
IUPAC_TABLE = "m(sym, bases) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('S','CG'),('W','AT'),('K','GT'),('M','AC'),('B','CGT'),('D','AGT'),('H','ACT'),('V','ACG'),('N','ACGT'))"


@query(
    f"""WITH RECURSIVE r0 AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{SYMBOL_RUN}') AS w FROM benchmark), r AS (SELECT item_id, i, upper(w[i]) AS seq FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM r0)), {IUPAC_TABLE},
d AS (SELECT seq, product(length(bases)) AS size FROM (SELECT seq, unnest(string_split(seq, '')) AS sym FROM (SELECT DISTINCT seq FROM r)) JOIN m USING (sym) GROUP BY seq),
e(seq, i, word) AS (SELECT seq, 0, '' FROM d WHERE size <= 256 UNION ALL SELECT seq, i + 1, word || b FROM (SELECT e.*, unnest(string_split(m.bases, '')) AS b FROM e JOIN m ON m.sym = substr(e.seq, e.i + 1, 1) WHERE e.i < length(e.seq))),
f AS (SELECT seq, word, row_number() OVER (PARTITION BY seq ORDER BY word) AS v FROM e WHERE i = length(seq))
SELECT item_id, r.i AS run, item_id || '-' || r.i || CASE WHEN size = 1 OR size > 256 THEN '' ELSE '-v' || lpad(CAST(v AS VARCHAR), 4, '0') END AS payload_id, CASE WHEN size > 256 THEN 'over_budget' ELSE 'expanded' END AS status, word FROM r JOIN d USING (seq) LEFT JOIN f USING (seq)"""
)
def iupac_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbolic run of each item as exact words with their ids; an exact run is itself, one over 256 words is told as such."""
    runs = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({SYMBOL_RUN})"), F.lit(1)), F.upper)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(runs).alias("_i", "seq")).withColumn("run", (F.col("_i") + 1).cast("long"))
    words = domains.expand(rows.withColumn("_n", cardinality(F.col("seq"))), ["item_id", "run", "_n"], "seq", 256)
    suffix = F.when((F.col("_n") == 1) | (F.col("_n") > 256), "").otherwise(F.concat(F.lit("-v"), F.lpad((F.col("variant") + 1).cast("string"), 4, "0")))
    return words.select("item_id", "run", F.concat(F.concat_ws("-", F.col("item_id").cast("string"), F.col("run").cast("string")), suffix).alias("payload_id"), "status", "word")


PLAN_BUDGET = 4000
OVERHANGS = ("GATC", "GTCT")


@query(
    f"""WITH a AS (SELECT item_id, dna, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT item_id, {DNA_SQL} AS dna FROM benchmark)), f AS (SELECT arm, row_number() OVER (ORDER BY arm) - 1 AS j FROM (SELECT DISTINCT {DNA_SQL.replace('text', 'p_name')} AS arm FROM part)),
b AS (SELECT basal, row_number() OVER (ORDER BY basal) - 1 AS k FROM (SELECT DISTINCT {DNA_SQL.replace('text', 'p_type')} AS basal FROM part)), r(overhang, l) AS (VALUES ('GATC', 0), ('GTCT', 1)), n AS (SELECT (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM b) AS nb),
x AS (SELECT ((i * nf + j) * nb + k) * 2 + l AS ordinal, item_id, arm, basal, overhang, basal || dna || arm || overhang AS final, length(dna) >= 6 AND position('GGCC' IN dna || arm) = 0 AS feasible FROM a, f, b, r, n WHERE ((i * nf + j) * nb + k) * 2 + l < {PLAN_BUDGET})
SELECT ordinal, item_id, arm, basal, overhang, sha256(final) AS final, feasible, count(*) OVER (PARTITION BY sha256(final)) AS copies FROM x"""
)
def design_space_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items by the names' arms, the types' ends and two overhangs, up to a budget; equal sequences are counted."""
    parts = table(spark, sf_dir, "part")
    items = item_dna(spark, sf_dir)
    axes = {
        "item_id": items.select("item_id"),
        "arm": parts.select(dna_view(F.col("p_name")).alias("arm")).distinct(),
        "basal": parts.select(dna_view(F.col("p_type")).alias("basal")).distinct(),
        "overhang": spark.createDataFrame([(o,) for o in OVERHANGS], "overhang string"),
    }
    rows = composition.product_nodes(axes, PLAN_BUDGET).join(items, "item_id")
    feasible = (F.length("dna") >= 6) & ~F.concat("dna", "arm").contains("GGCC")
    made = rows.withColumn("final", F.sha2(F.concat("basal", "dna", "arm", "overhang"), 256)).withColumn("feasible", feasible)
    copies = made.groupBy("final").agg(F.count(F.lit(1)).alias("copies"))
    return made.join(copies, "final").select("ordinal", "item_id", "arm", "basal", "overhang", "final", "feasible", "copies")


@query(
    """WITH a AS (SELECT p_brand, max(p_retailprice) < 999 AS whole FROM part GROUP BY p_brand), t AS (SELECT DISTINCT p_type FROM part), r AS (SELECT p_brand, p_type, min(p_size) AS least, count(*) AS rows, arg_min(p_partkey, (p_size, p_partkey)) AS first_id FROM part WHERE p_retailprice < 930 GROUP BY p_brand, p_type)
SELECT p_brand, p_type, least, coalesce(rows, 0) AS rows, first_id, CASE WHEN rows IS NOT NULL THEN 'found' WHEN whole THEN 'infeasible' ELSE 'unknown' END AS status FROM a CROSS JOIN t LEFT JOIN r USING (p_brand, p_type)"""
)
def min_overhead_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of brands and types; a missing cell is infeasible where the brand's search is complete, else unknown."""
    parts = table(spark, sf_dir, "part")
    searched = parts.groupBy("p_brand").agg((F.max("p_retailprice") < 999).alias("whole"))
    return pool.overhead_matrix(searched, parts.select("p_type").distinct(), parts.where("p_retailprice < 930"), "p_brand", "p_type", "p_size", "p_partkey")


@query(
    f"""WITH e AS (SELECT p_name, p_partkey, p_type, ({T}) AS t, ({S}) AND ({B}) AS rest FROM part)
SELECT p_name AS product, count(*) FILTER (t AND rest) AS eligible, count(*) FILTER (NOT (t AND rest)) AS excluded, min(p_partkey) FILTER (t AND rest) AS first_option, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (rest), '') AS focus_variants FROM e GROUP BY p_name"""
)
def query_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a query: what passes, what does not, and which types are open once the type's own selection is set aside."""
    return pool.query_groups(table(spark, sf_dir, "part"), "p_name", "p_partkey", SELECTIONS, "p_type")


@query(
    f"""WITH RECURSIVE q AS (SELECT DISTINCT {view_sql('p_name')} AS seq FROM part WHERE length({view_sql('p_name')}) > 0), {IUPAC_TABLE},
e(seq, i, word, said) AS (SELECT seq, 0, '', '' FROM q UNION ALL SELECT seq, i + 1, word || b, CASE WHEN length(bases) = 1 THEN said WHEN said = '' THEN (i + 1) || '=' || b ELSE said || '; ' || (i + 1) || '=' || b END
 FROM (SELECT e.*, m.bases, unnest(string_split(m.bases, '')) AS b FROM e JOIN m ON m.sym = substr(e.seq, e.i + 1, 1) WHERE e.i < length(e.seq)))
SELECT seq AS template, row_number() OVER (PARTITION BY seq ORDER BY word) AS design, word, said AS assignments FROM e WHERE i = length(seq)"""
)
def design_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every design of each name's template, with the bases that its variable places were given."""
    names = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("template")).distinct().where("template <> ''")
    words = domains.expand(names.withColumn("seq", F.col("template")), ["template"], "seq", 1 << 20)
    return words.select("template", (F.col("variant") + 1).cast("long").alias("design"), "word", domains.assignment_text(F.col("template"), F.col("word")).alias("assignments"))


@query("SELECT p_type, p_name AS word, count(DISTINCT p_brand) AS programs FROM part GROUP BY p_type, p_name")
def program_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each type once, with the brands that support them; more than a thousand would be an error."""
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", F.col("p_name").alias("word"))
    return processing.supported_union(rows, "p_type", "p_brand", "word", 1000)


@query(
    """WITH a AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS i FROM (SELECT DISTINCT p_name FROM part)), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS j FROM (SELECT DISTINCT p_brand FROM part)),
c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, (i * (SELECT count(*) FROM b) + j) * (SELECT count(*) FROM c) + k AS ordinal FROM part JOIN a USING (p_name) JOIN b USING (p_brand) JOIN c USING (p_type)"""
)
def preparation_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which combination of the composition each part realizes: the inverse of the product's order."""
    parts = table(spark, sf_dir, "part")
    axes = {c: parts.select(c).where(F.col(c).isNotNull()).distinct() for c in ("p_name", "p_brand", "p_type")}
    return composition.addresses(parts, axes).select("p_partkey", "ordinal")


@query(
    MEMBERS_SQL
    + """, w AS (SELECT DISTINCT seq, source, adapter, rank FROM m WHERE rank IN (0, cardinality // 2, cardinality - 1)), t AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY rank) - 1 AS turn FROM w)
SELECT seq AS placement, source, adapter, row_number() OVER (ORDER BY turn, seq) - 1 AS rank FROM t"""
)
def target_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, middle and last member of each name's population, taken in turn over the names."""
    names = table(spark, sf_dir, "part").select(iupac_view(F.col("p_name")).alias("placement")).distinct().where("placement <> ''")
    sets = masks(F.col("placement"))
    size = populations.cardinality(populations.completions(sets, BUDGET), BUDGET)
    asked = names.withColumn("_n", size).where("_n > 0").withColumn("at", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("_n") / 2), F.col("_n") - 1))))
    members = populations.member_at(asked, sets, F.col("at"), BUDGET)
    return domains.interleave(members.select("placement", "at", "source", "adapter"), "placement", "at").select("placement", "source", "adapter", "rank")


@query("SELECT p_partkey, p_size, p_type, row_number() OVER (ORDER BY lpad(CAST(p_size AS VARCHAR), 6, '0') || '|' || p_type || '|' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) - 1 AS place FROM part WHERE p_size <= 20 AND p_brand <> 'Brand#3'")
def local_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered parts by size and type; ties keep the order of the source."""
    kept = table(spark, sf_dir, "part").where("p_size <= 20 AND p_brand <> 'Brand#3'")
    key = F.concat_ws("|", F.lpad(F.col("p_size").cast("string"), 6, "0"), "p_type", F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    return ranks.rank_within(kept.withColumn("_key", key), "_key", "place").select("p_partkey", "p_size", "p_type", "place")
