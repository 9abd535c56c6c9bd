"""Queries over sequences: normalisation, scans, enumeration, sets, searches and lineage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import dna
from ..operators import bounded, enumerate as domains, lineage, pool, scan
from ..operators.composition import product_nodes
from .tables import DNA_SQL, IUPAC_SQL, document_dna, item_dna, item_symbols, table

NICK_AGENTS = [("nick-a", "GAGTC", "top", 6), ("nick-b", "CCTAGG", "top", 1), ("nick-c", "GCNATC", "bottom", 2)]
RELEASE_AGENTS = [("rel-a", "GGTCTC", 7, 11), ("rel-b", "RGATCY", 1, 5)]
MOTIF = "CATNAC"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: Places and counts are longs in results.
LONGS = ("start", "end", "n_nt", "nick_boundary", "top_cut", "bottom_cut", "n_bases", "variant", "positions", "rank",
         "paired", "hit", "stratum", "place", "step", "last_step")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int" and c in LONGS})

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def motif_regex(motif: str) -> str:
    return "".join(f"[{dna.BASES[s]}]" for s in motif)


def site_sql(agents: list[tuple], columns: str) -> str:
    """Both orientations of (id, motif, first, second), by regular expression over every window."""
    rows = []
    for agent_id, motif, first, second in agents:
        n = len(motif)
        rows.append(f"('{agent_id}', 'forward', '{motif_regex(motif)}', {n}, {first}, {second})")
        rows.append(f"('{agent_id}', 'reverse', '{motif_regex(scan.reverse_motif(motif))}', {n}, {n - second}, {n - first})")
    return f"""
WITH d AS (SELECT doc_id, {DNA_SQL} AS dna FROM documents),
a(agent_id, orientation, pattern, m, f, s) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, dna, a.*, unnest(range(0, length(dna) - m + 1)) AS start FROM d, a WHERE length(dna) >= m),
h AS (SELECT DISTINCT doc_id, agent_id, orientation, start, start + f AS x, start + s AS y FROM w
      WHERE regexp_full_match(substr(dna, start + 1, m), pattern)
        AND least(start + f, start + s) >= 0 AND greatest(start + f, start + s) <= length(dna))
SELECT doc_id, agent_id, orientation, start, {columns} FROM h"""


NATIVE_SQL = "CASE agent_id " + " ".join(f"WHEN '{i}' THEN '{s}'" for i, _, s, _ in NICK_AGENTS) + " END"


def words_sql(table_name: str, size: int) -> str:
    """The distinct words of all windows of a table's sequences."""
    return f"SELECT DISTINCT substr(dna, start, {size}) AS word FROM (SELECT dna, unnest(range(1, length(dna) - {size - 2})) AS start FROM (SELECT {DNA_SQL} AS dna FROM {table_name}) WHERE length(dna) >= {size})"


@query(
    site_sql(
        [(i, m, c, c) for i, m, _, c in NICK_AGENTS],
        f"x AS nick_boundary, CASE WHEN (orientation = 'forward') = (({NATIVE_SQL}) = 'top') THEN 'top' ELSE 'bottom' END AS nicked_strand",
    )
)
def scan_nicking_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_nicks(document_dna(spark, sf_dir), ["doc_id"], "dna", NICK_AGENTS)


@query(site_sql(RELEASE_AGENTS, "x AS top_cut, y AS bottom_cut"))
def scan_release_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_releases(document_dna(spark, sf_dir), ["doc_id"], "dna", RELEASE_AGENTS)


@query(f"SELECT doc_id, {DNA_SQL} AS dna, length({DNA_SQL}) AS n_nt FROM documents")
def dna_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_dna(spark, sf_dir).withColumn("n_nt", F.length("dna"))


@query(
    f"""SELECT doc_id, reverse(translate(dna, 'ACGT', 'TGCA')) AS reverse_complement, translate(dna, 'ACGT', 'TGCA') AS complement
FROM (SELECT doc_id, {DNA_SQL} AS dna FROM documents)"""
)
def dna_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("dna")
    return document_dna(spark, sf_dir).select("doc_id", dna.reverse_complement(c).alias("reverse_complement"), dna.complement(c).alias("complement"))


@query(
    r"""SELECT p_partkey, upper(regexp_replace(p_name, '\s', '', 'g')) AS normalized,
  array_to_string(list_sort(list_distinct(string_split(regexp_replace(upper(regexp_replace(p_name, '\s', '', 'g')), '[ACGT]', '', 'g'), ''))), '') AS offending
FROM part"""
)
def alphabet_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", dna.normalized(F.col("p_name")).alias("normalized"), dna.offending(F.col("p_name")).alias("offending"))


def presence_sql(motif: str) -> str:
    def classes(within: bool) -> str:
        out = []
        for m in sorted({motif, scan.reverse_motif(motif)}):
            part = ""
            for s in m:
                want = set(dna.BASES[s])
                part += "[" + "".join(x for x, b in dna.BASES.items() if (set(b) <= want if within else set(b) & want)) + "]"
            out.append(part)
        return "|".join(out)

    return f"""SELECT item_id, CASE WHEN regexp_matches(seq, '{classes(True)}') THEN 'guaranteed'
  WHEN regexp_matches(seq, '{classes(False)}') THEN 'possible' ELSE 'absent' END AS status
FROM (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark)"""


@query(presence_sql(MOTIF))
def motif_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.motif_presence(item_symbols(spark, sf_dir), ["item_id"], "seq", MOTIF)


@query(
    f"""SELECT DISTINCT symbol, bases, length(bases) AS n_bases FROM (SELECT unnest(string_split({IUPAC_SQL}, '')) AS symbol FROM benchmark) JOIN (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('S','CG'),('W','AT'),
('K','GT'),('M','AC'),('B','CGT'),('D','AGT'),('H','ACT'),('V','ACG'),('N','ACGT')) t(symbol, bases) USING (symbol)"""
)
def iupac_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of every symbol that the items use."""
    symbols = item_symbols(spark, sf_dir).select(F.explode(F.array_distinct(F.split("seq", ""))).alias("symbol")).where("symbol <> ''").distinct()
    bases = F.array_join(domains.bases_of(F.get(dna.masks(F.col("symbol")), 0)), "")
    return symbols.select("symbol", bases.alias("bases"), F.length(bases).alias("n_bases"))


@query(
    f"""WITH s AS (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark)
SELECT item_id, length(seq) AS positions, CAST(sum_2 AS BIGINT) AS log2_size, (sum_2 > 8) AS blocked
FROM (SELECT item_id, seq, length(regexp_replace(seq, '[^RY]', '', 'g')) + 2 * length(regexp_replace(seq, '[^N]', '', 'g')) AS sum_2 FROM s)"""
)
def space_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact size as a power of two, as R and Y hold two bases and N four; blocked above 256."""
    bits = F.aggregate(dna.masks(F.col("seq")), F.lit(0), lambda n, m: n + F.bit_count(m) - 1 - (F.bit_count(m) == 4).cast("int"))
    size = F.when(F.length("seq") == 0, 0).otherwise(bits)
    return item_symbols(spark, sf_dir).select("item_id", F.length("seq").alias("positions"), size.cast("long").alias("log2_size"), (size > 8).alias("blocked"))


@query(f"SELECT dna, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {DNA_SQL} AS dna FROM documents) GROUP BY dna")
def dedupe_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.dedupe(document_dna(spark, sf_dir), "dna", "doc_id")


PROFILE_SQL = f"""
WITH s AS (SELECT item_id, {DNA_SQL} AS dna FROM benchmark), e AS (
  SELECT item_id, substr(dna, 1, 4) AS l, substr(reverse(dna), 1, 4) AS r FROM s WHERE length(dna) >= 8),
p AS (SELECT item_id, i, CASE WHEN substr(l, i, 1) || substr(r, i, 1) IN ('AT','TA','CG','GC') THEN 'M'
        WHEN substr(l, i, 1) || substr(r, i, 1) IN ('GT','TG') THEN 'W' ELSE 'X' END AS k FROM e, range(1, 5) t(i)),
q AS (SELECT item_id, string_agg(k, '' ORDER BY i) AS profile, count(*) FILTER (k = 'M') + 0.5 * count(*) FILTER (k = 'W') AS support,
        count(*) FILTER (k = 'X') + 0.5 * count(*) FILTER (k = 'W') AS disruption, count(*) FILTER (k = 'X' AND i IN (2, 3)) AS middle FROM p GROUP BY item_id)"""


def pair_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pairs of the outer ends: M paired, W wobble, X mismatched."""
    ends = item_dna(spark, sf_dir).where(F.length("dna") >= 8).select("item_id", F.substring("dna", 1, 4).alias("l"), F.substring(F.reverse("dna"), 1, 4).alias("r"))
    kinds = F.zip_with(
        F.split("l", ""), F.split("r", ""),
        lambda a, b: F.when(dna.pair_kind(a, b) == "watson_crick", "M").when(dna.pair_kind(a, b) == "gt_wobble", "W").otherwise("X"),
    )
    count = lambda k: F.size(F.filter("k", lambda x: x == k))
    middle = F.size(F.filter(F.slice("k", 2, 2), lambda x: x == "X"))
    return ends.select("item_id", kinds.alias("k")).select(
        "item_id",
        F.array_join("k", "").alias("profile"),
        (count("M") + 0.5 * count("W")).cast("double").alias("support"),
        (count("X") + 0.5 * count("W")).cast("double").alias("disruption"),
        middle.cast("long").alias("middle"),
    )


@query(PROFILE_SQL + " SELECT item_id, profile, CAST(support AS DOUBLE) AS support, CAST(disruption AS DOUBLE) AS disruption, middle FROM q")
def pair_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_profiles(spark, sf_dir)


@query(
    PROFILE_SQL
    + """ SELECT item_id, profile, CASE WHEN middle = 2 THEN 'reject' WHEN support >= 3 THEN 'active' WHEN disruption > 3 THEN 'reject' WHEN support >= 1.5 THEN 'reserve' ELSE 'reject' END AS status,
 CASE WHEN middle = 2 THEN 'middle_mismatches' WHEN support >= 3 THEN 'supported' WHEN disruption > 3 THEN 'disrupted' WHEN support >= 1.5 THEN 'weak' ELSE 'unsupported' END AS reason FROM q"""
)
def pair_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered cascade: the first rule that holds decides."""
    rules = [(F.col("middle") == 2, "reject", "middle_mismatches"), (F.col("support") >= 3, "active", "supported"),
             (F.col("disruption") > 3, "reject", "disrupted"), (F.col("support") >= 1.5, "reserve", "weak")]
    status, reason = F, F
    for test, s, r in rules:
        status, reason = status.when(test, s), reason.when(test, r)
    return pair_profiles(spark, sf_dir).select("item_id", "profile", status.otherwise("reject").alias("status"), reason.otherwise("unsupported").alias("reason"))


@query(
    f"""WITH s AS (SELECT doc_id, {DNA_SQL} AS dna FROM documents),
p AS (SELECT doc_id, i, substr(dna, i, 1) || substr(dna, length(dna) + 1 - i, 1) IN ('AT','TA','CG','GC') AS wc, length(dna) // 2 AS n
      FROM (SELECT doc_id, dna, unnest(range(1, length(dna) // 2 + 1)) AS i FROM s)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM p WHERE wc),
r AS (SELECT doc_id, island, count(*) AS run, max(i) AS last, any_value(n) AS n FROM g GROUP BY doc_id, island)
SELECT p.doc_id, count(*) AS pairs, count(*) FILTER (NOT wc) AS non_wc, coalesce(any_value(m.longest), 0) AS longest, coalesce(any_value(m.terminal), 0) AS terminal
FROM p LEFT JOIN (SELECT doc_id, max(run) AS longest, coalesce(max(run) FILTER (last = n), 0) AS terminal FROM r GROUP BY doc_id) m USING (doc_id) GROUP BY p.doc_id"""
)
def pairing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence folded on its middle: pairs, those not Watson-Crick, the longest run and the one at the turn."""
    half = F.floor(F.length("dna") / 2).cast("int")
    folded = document_dna(spark, sf_dir).where(F.length("dna") >= 2).select(
        "doc_id",
        F.zip_with(
            F.split(F.substring(F.col("dna"), F.lit(1), half), ""),
            F.split(F.substring(F.reverse("dna"), F.lit(1), half), ""),
            lambda a, b: F.concat(a, b).isin("AT", "TA", "CG", "GC"),
        ).alias("wc"),
    )
    runs = F.aggregate(
        "wc",
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("bad")),
        lambda acc, ok: F.struct(
            F.when(ok, acc["now"] + 1).otherwise(0).alias("now"),
            F.greatest(acc["best"], F.when(ok, acc["now"] + 1).otherwise(0)).alias("best"),
            (acc["bad"] + (~ok).cast("int")).alias("bad"),
        ),
    )
    return folded.select("doc_id", F.size("wc").alias("pairs"), runs.alias("r")).select(
        "doc_id", F.col("pairs").cast("long"), F.col("r.bad").cast("long").alias("non_wc"), F.col("r.best").cast("long").alias("longest"), F.col("r.now").cast("long").alias("terminal")
    )


@query(
    f"""WITH d AS (SELECT doc_id, {DNA_SQL} AS dna FROM documents), w AS (
 SELECT doc_id, start, length(dna) AS n FROM (SELECT doc_id, dna, unnest(range(0, length(dna) - 3)) AS start FROM d WHERE length(dna) >= 4) WHERE substr(dna, start + 1, 4) = 'AAGC'),
p AS (SELECT doc_id, start + 1 AS boundary, abs(start + 1 - n // 2) AS displacement, n FROM w),
b AS (SELECT *, displacement > 20 AS far, boundary < 4 AS short FROM p)
SELECT doc_id, count(*) AS examined, count(*) FILTER (NOT far AND NOT short) AS hits, count(*) FILTER (far) AS blocked_far, count(*) FILTER (short) AS blocked_short,
 CASE WHEN count(*) FILTER (NOT far AND NOT short) > 0 THEN 'complete' ELSE 'infeasible' END AS status, min(displacement) FILTER (NOT far AND NOT short) AS nearest FROM b GROUP BY doc_id"""
)
def nick_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements near each sequence's middle; every placement gets all reasons against it."""
    words = scan.word_table(spark, [("nick", "AAGC", 1, 1)]).where("orientation = 'forward'")
    sequences = document_dna(spark, sf_dir)
    hits = scan.windows(sequences, ["doc_id"], "dna", [4], "AAGC").join(words, ["size", "word"])
    boundary = F.col("start") + F.col("first")
    placed = hits.select("doc_id", F.abs(boundary - F.floor(F.col("n_nt") / 2)).cast("long").alias("displacement"), boundary.alias("boundary"))
    blockers = F.array_compact(F.array(F.when(F.col("displacement") > 20, F.lit("far")), F.when(F.col("boundary") < 4, F.lit("short"))))
    ok = F.size("b") == 0
    count = lambda c: F.sum(c.cast("long"))
    return placed.withColumn("b", blockers).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("examined"),
        count(ok).alias("hits"),
        count(F.array_contains("b", "far")).alias("blocked_far"),
        count(F.array_contains("b", "short")).alias("blocked_short"),
        F.when(count(ok) > 0, "complete").otherwise("infeasible").alias("status"),
        F.min(F.when(ok, F.col("displacement"))).alias("nearest"),
    )


def candidate_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left arms, the words of four bases of the items, against right arms, the part names of four bases, in order."""
    left = scan.distinct_words(item_dna(spark, sf_dir), "dna", 4).withColumnRenamed("word", "left_arm")
    right = table(spark, sf_dir, "part").select(dna.dna_view(F.col("p_name")).alias("right_arm")).where(F.length("right_arm") == 4).distinct()
    return product_nodes({"left_arm": left, "right_arm": right}, 1 << 30).drop("space_size")  # 4 ** 4 words a side at most


CANDIDATE_SQL = f"""
WITH li AS (SELECT word AS left_arm, row_number() OVER (ORDER BY word) - 1 AS i FROM ({words_sql('benchmark', 4)})),
r AS (SELECT right_arm, row_number() OVER (ORDER BY right_arm) - 1 AS j FROM (SELECT DISTINCT {DNA_SQL.replace('text', 'p_name')} AS right_arm FROM part) WHERE length(right_arm) = 4),
s AS (SELECT i * (SELECT count(*) FROM r) + j AS ordinal, left_arm, right_arm FROM li, r),
e AS (SELECT *, (SELECT count(*) FROM range(1, 5) t(k) WHERE substr(left_arm, k, 1) || substr(reverse(right_arm), k, 1) IN ('AT','TA','CG','GC')) AS paired FROM s WHERE ordinal < 400),
h AS (SELECT *, paired >= 2 AS ok FROM e)"""


def candidates(spark: SparkSession, sf_dir: str) -> bounded.Search:
    paired = F.size(
        F.filter(F.zip_with(F.split("left_arm", ""), F.split(F.reverse("right_arm"), ""), lambda a, b: F.concat(a, b)), lambda x: x.isin("AT", "TA", "CG", "GC"))
    )
    space = candidate_space(spark, sf_dir).withColumn("paired", paired)
    blockers = F.array_compact(F.array(F.when(F.col("paired") < 2, F.lit("pairing"))))
    return bounded.bounded_search(space, "ordinal", blockers, [F.col("paired").desc(), F.col("left_arm"), F.col("right_arm")], 400, 10)


@query(CANDIDATE_SQL + " SELECT left_arm, right_arm, paired, hit FROM (SELECT *, row_number() OVER (ORDER BY paired DESC, left_arm, right_arm) AS hit FROM h WHERE ok) WHERE hit <= 10")
def basal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).hits.select("left_arm", "right_arm", "paired", "hit")


@query(CANDIDATE_SQL + " SELECT (SELECT count(*) FROM s) AS space_size, count(*) AS examined, count(*) FILTER (ok) AS observed,"
    " CASE WHEN (SELECT count(*) FROM s) > 400 OR count(*) FILTER (ok) > 10 THEN 'truncated' WHEN count(*) FILTER (ok) > 0 THEN 'complete' ELSE 'infeasible' END AS status,"
    " concat_ws(',', CASE WHEN (SELECT count(*) FROM s) > 400 THEN 'nodes' END, CASE WHEN count(*) FILTER (ok) > 10 THEN 'hits' END) AS truncated_by FROM h")
def search_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).summary


@query(f"WITH s AS (SELECT DISTINCT {DNA_SQL} AS dna FROM documents) SELECT DISTINCT substr(dna, 3, 6) AS word FROM s WHERE length(dna) >= 8")
def window_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.window_words(document_dna(spark, sf_dir), "dna", 2, 8)


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of six bases in the documents and in the benchmark items."""
    return scan.distinct_words(document_dna(spark, sf_dir), "dna", 6), scan.distinct_words(item_dna(spark, sf_dir), "dna", 6)


SETS_SQL = f"WITH a AS ({words_sql('documents', 6)}), b AS ({words_sql('benchmark', 6)}) "


@query(SETS_SQL + "SELECT word FROM a UNION SELECT word FROM b")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.union(b).distinct()


@query(SETS_SQL + "SELECT word FROM a INTERSECT SELECT word FROM b")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.intersect(b)


@query(SETS_SQL + "SELECT word FROM a EXCEPT SELECT word FROM b")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.subtract(b)


@query(f"WITH s AS (SELECT DISTINCT {DNA_SQL} AS word FROM documents) SELECT word, row_number() OVER (ORDER BY word) - 1 AS rank FROM s")
def rank_unrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.global_rank(document_dna(spark, sf_dir).select(F.col("dna").alias("word")).distinct(), "word")


@query(
    f"""WITH s AS ({words_sql('documents', 8)}), d AS (SELECT word, CAST((SELECT count(*) FROM range(1, 5) t(i) WHERE substr(word, i, 1) <> substr('ACGT', i, 1)) AS INTEGER) AS distance FROM s)
SELECT word, distance, row_number() OVER (ORDER BY distance, word) - 1 AS rank FROM d"""
)
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.seeded_order(scan.distinct_words(document_dna(spark, sf_dir), "dna", 8), "word", "ACGT")


@query(
    f"""WITH s AS ({words_sql('documents', 8)}), r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS rank FROM s), q AS (SELECT DISTINCT l_partkey AS rank FROM lineitem)
SELECT rank, word FROM q LEFT JOIN r USING (rank)"""
)
def member_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words at the ranks that a table names."""
    ranks = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rank")).distinct()
    return domains.member_at(scan.distinct_words(document_dna(spark, sf_dir), "dna", 8), "word", ranks)


@query(f"WITH s AS ({words_sql('documents', 8)}), r AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS rank FROM s) SELECT word, rank, rank % 7 AS part FROM r WHERE rank >= 1000 AND rank < 9000")
def rank_window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of ranks, dealt to seven parts."""
    return domains.rank_parts(scan.distinct_words(document_dna(spark, sf_dir), "dna", 8), "word", 1000, 9000, 7)


@query(
    """WITH n AS (SELECT count(DISTINCT p_size) AS i, count(DISTINCT p_brand) AS j, count(DISTINCT p_type) AS k FROM part), x AS (SELECT unnest(range(0, i)) AS a FROM n), y AS (SELECT unnest(range(0, j)) AS b FROM n), z AS (SELECT unnest(range(0, k)) AS c FROM n)
SELECT a AS c0, b AS c1, c AS c2, a + b + c AS total, row_number() OVER (ORDER BY a + b + c, a, b, c) - 1 AS rank FROM x, y, z"""
)
def grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the parts' sizes, brands and types, by displacement."""
    sizes = table(spark, sf_dir, "part").agg(*[F.countDistinct(c) for c in ("p_size", "p_brand", "p_type")]).first()
    return domains.grid(spark, list(sizes))


@query("SELECT event_type, event_id, row_number() OVER (ORDER BY turn, event_type) - 1 AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events)")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.interleave(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id").select("event_type", "event_id", "rank")


@query(
    """WITH b AS (SELECT DISTINCT p_type, p_brand AS x FROM part)
SELECT p_type, x AS members FROM b UNION ALL SELECT a.p_type, a.x || ',' || b.x FROM b a JOIN b USING (p_type) WHERE a.x < b.x
UNION ALL SELECT a.p_type, a.x || ',' || b.x || ',' || c.x FROM b a JOIN b USING (p_type) JOIN b c USING (p_type) WHERE a.x < b.x AND b.x < c.x"""
)
def subset_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_type", "p_brand")
    return domains.subsets(items, "p_type", "p_brand", 3).select("p_type", F.array_join("members", ",").alias("members"))


@query(
    """WITH i AS (SELECT l_suppkey AS k, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem),
m AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -100) + 1 THEN 1 ELSE 0 END AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k AS l_suppkey, min(lo) AS low, max(hi) AS high FROM g GROUP BY k, island"""
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return domains.merged_intervals(rows, "l_suppkey", "lo", "hi").select("l_suppkey", "low", "high")


@query(
    """WITH d AS (SELECT p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type)
SELECT DISTINCT p_type, CAST(lo + (hi - lo) * i // 6 AS BIGINT) AS mark FROM d, range(0, 7) t(i)"""
)
def domain_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    marks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor((F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * i / 6))).cast("long")))
    return ends.select("p_type", F.explode(marks).alias("mark"))


@query(
    f"""WITH s AS (SELECT item_id, seq, unnest(range(0, length(seq))) AS i FROM (SELECT item_id, {IUPAC_SQL} AS seq FROM benchmark)), m(sym, bases) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('N','ACGT')),
c AS (SELECT item_id, i, bases, CAST(least(1e18, coalesce(product(length(bases)) OVER (PARTITION BY item_id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS BIGINT) AS stride FROM s JOIN m ON m.sym = substr(seq, i + 1, 1)),
r AS (SELECT item_id, unnest(range(20, CAST(least(30, product(length(bases))) AS BIGINT))) AS rank FROM c GROUP BY item_id)
SELECT item_id, rank, string_agg(substr(bases, CAST((rank // stride) % length(bases) + 1 AS BIGINT), 1), '' ORDER BY i) AS word FROM r JOIN c USING (item_id) GROUP BY item_id, rank"""
)
def domain_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words that each whole item stands for: the page of ten from rank 20."""
    items = item_symbols(spark, sf_dir).where("seq <> ''").withColumn("_size", dna.cardinality(F.substring(F.reverse("seq"), 1, 40)))  # more than 30 words are as good as any
    page = items.where("_size > 20").withColumn("rank", F.explode(F.sequence(F.lit(20).cast("long"), F.least(F.col("_size"), F.lit(30)).cast("long") - 1)))
    return page.select("item_id", "rank", domains.unrank(dna.masks(F.col("seq")), F.col("rank")).alias("word"))


FRAGMENT_SQL = f"""
WITH s AS (SELECT item_id, {DNA_SQL} AS dna FROM benchmark WHERE length({DNA_SQL}) > 0),
c AS (SELECT item_id, strand, 0 AS b FROM s, (VALUES ('top'), ('bottom')) t(strand) UNION SELECT item_id, strand, length(dna) FROM s, (VALUES ('top'), ('bottom')) t(strand)
  UNION SELECT item_id, 'top', start + 1 FROM (SELECT item_id, dna, unnest(range(0, length(dna) - 1)) AS start FROM s WHERE length(dna) >= 2) WHERE substr(dna, start + 1, 2) = 'CA'
  UNION SELECT item_id, 'bottom', start + 1 FROM (SELECT item_id, dna, unnest(range(0, length(dna) - 1)) AS start FROM s WHERE length(dna) >= 2) WHERE substr(dna, start + 1, 2) = 'TG'),
f AS (SELECT item_id, strand, b AS start, lead(b) OVER (PARTITION BY item_id, strand ORDER BY b) AS stop FROM c)
SELECT item_id, strand, start, stop AS "end", CASE WHEN strand = 'top' THEN substr(dna, start + 1, stop - start) ELSE reverse(translate(substr(dna, start + 1, stop - start), 'ACGT', 'TGCA')) END AS sequence
FROM f JOIN s USING (item_id) WHERE stop IS NOT NULL"""


@query(FRAGMENT_SQL)
def lineage_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = item_dna(spark, sf_dir).where("dna <> ''")
    sites = scan.scan_nicks(items, ["item_id"], "dna", [("cut", "CA", "top", 1)])
    return lineage.fragments(items, sites.select("item_id", F.col("nicked_strand").alias("strand"), F.col("nick_boundary").alias("boundary")), "item_id", "dna")


@query(
    f"""WITH s AS (SELECT item_id, {DNA_SQL} AS dna FROM benchmark), x AS (SELECT item_id, dna, CAST(unnest(range(0, length(dna))) AS INTEGER) AS i FROM s)
SELECT item_id, i AS index, CASE WHEN i < 6 THEN item_id + 1000 ELSE item_id END AS root_id, CASE WHEN i < 6 THEN 5 - i ELSE i END AS root_index,
 CASE WHEN i < 6 THEN 'bottom' ELSE 'top' END AS root_strand FROM x"""
)
def ancestry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six bases of an item are copied from the other strand of a primer; the rest are its own."""
    products = lineage.bases(item_dna(spark, sf_dir), ["item_id"], "dna").select(
        F.col("item_id").alias("product_id"), "index", F.col("item_id").alias("origin_id"), F.col("index").alias("origin_index"), F.lit("top").alias("strand")
    )
    origins = products.where("index < 6").select("origin_id", "origin_index", (F.col("origin_id") + 1000).alias("up_id"), (5 - F.col("origin_index")).alias("up_index"), F.lit("bottom").alias("up_strand"))
    return lineage.one_hop(products, origins).withColumnRenamed("product_id", "item_id")
