"""Populations, end words and signatures against plain enumeration."""

import itertools
import random

from pyspark.sql import functions as F

from plectra.functions.dna import BASES, masks
from plectra.operators import lineage, populations

PAIRS = {"A": "T", "C": "G", "G": "CT", "T": "AG"}


def members(template, budget):
    found = []
    for source in itertools.product(*[BASES[s] for s in template]):
        for partners in itertools.product(*[PAIRS[b] for b in source]):
            if sum(p == {"G": "T", "T": "G"}.get(b) for b, p in zip(source, partners)) <= budget:
                found.append(("".join(source), "".join(partners)[::-1]))
    return sorted(found)


def test_members_and_ranks(spark):
    for budget in (0, 1, 3):
        for template in ("N", "RYN", "TTGT", "GKNAS"):
            want = members(template, budget)
            df = spark.createDataFrame([(template,)], "seq string")
            got = populations.all_members(df, masks(F.col("seq")), budget, 1 << 20)
            rows = populations.rank_of(got.withColumnRenamed("rank", "asked"), masks(F.col("seq")), "source", "adapter", budget).orderBy("asked").collect()
            assert [(r.source, r.adapter) for r in rows] == want
            assert [r["rank"] for r in rows] == list(range(len(want))) and {r.cardinality for r in rows} == {len(want)}


def test_ranks_of_a_large_population(spark):
    """Far more members than could be made: the counts alone find a member, and its rank again."""
    df = spark.createDataFrame([("N" * 26, r) for r in (0, 12345678901, 4 * 10**15)], "seq string, r long")
    at = populations.member_at(df, masks(F.col("seq")), F.col("r"), 2)
    rows = populations.rank_of(at, masks(F.col("seq")), "source", "adapter", 2).collect()
    assert all(r["rank"] == r.r and len(r.source) == 26 for r in rows)


def test_no_such_member(spark):
    df = spark.createDataFrame([("RN", -1, "AA", "TT"), ("RN", 10**6, "CA", "TG"), ("RN", 0, "GT", "GT"), ("RN", 3, "G", "C")], "seq string, r long, s string, a string")
    rows = populations.rank_of(populations.member_at(df, masks(F.col("seq")), F.col("r"), 1), masks(F.col("seq")), "s", "a", 1).collect()
    assert [r.source for r in rows if r.r in (-1, 10**6)] == [None, None]
    got = {r.s: r["rank"] for r in rows}
    assert got["CA"] is None and got["G"] is None and got["GT"] is None  # outside the set, too short, two mismatches
    assert got["AA"] == members("RN", 1).index(("AA", "TT"))


def test_end_pairs(spark):
    rng = random.Random(6)
    cases = [("".join(rng.choice("ACGTRYN") for _ in range(rng.randrange(1, 5))), "".join(rng.choice("ACGTRYN") for _ in range(rng.randrange(1, 5)))) for _ in range(25)]
    df = spark.createDataFrame(sorted(set(cases)), "s string, a string").withColumns({"_s": masks(F.col("s")), "_a": masks(F.col("a"))})
    match = {"AT", "TA", "CG", "GC"}
    for width, budget in ((1, 0), (2, 1), (2, 2)):
        got = {(r.s, r.a, r.left_word, r.right_word): r.cost for r in populations.end_pairs(df, ["s", "a"], "_s", "_a", width, budget).collect()}
        want = {}
        for s, a in set(cases):
            n = min(len(s), len(a))
            if n < width:
                continue
            for x in itertools.product(*[BASES[c] for c in s[:n]]):
                for y in itertools.product(*[BASES[c] for c in a[:n]]):
                    cost = sum(p + q not in match for p, q in zip(x, y))
                    key = (s, a, "".join(x[:width]), "".join(y[:width])[::-1])
                    if cost <= budget:
                        want[key] = min(cost, want.get(key, 9))
        assert got == want


def test_signatures_ignore_names(spark):
    graph = [("a", "b", "p"), ("b", "c", "p"), ("c", "d", "q"), ("d", "a", "p")]
    names = dict(zip("abcd", ["w9", "k", "zz", "0"]))
    other = [("a", "b", "p"), ("b", "c", "q"), ("c", "d", "q"), ("d", "a", "p")]
    cases = {"plain": graph, "renamed": [(names[b], names[a], k) for a, b, k in reversed(graph)], "kind": other, "twice": graph + graph, "less": graph[:3]}
    edges = spark.createDataFrame([(g, *e) for g, rows in cases.items() for e in rows], "g string, a string, b string, kind string")
    labels = edges.select("g", F.col("a").alias("v")).union(edges.select("g", "b")).withColumn("label", F.lit("strand"))
    got = {r.g: r for r in lineage.refined_signature(edges, labels, "g").collect()}
    assert got["plain"].signature == got["renamed"].signature == got["twice"].signature
    assert len({got[g].signature for g in ("plain", "kind", "less")}) == 3
    assert (got["plain"].vertices, got["plain"].contacts) == (4, 4)
    marked = labels.withColumn("label", F.when(F.col("v") == "a", "end").otherwise(F.col("label")))
    assert {r.g: r.signature for r in lineage.refined_signature(edges, marked, "g").collect()}["plain"] != got["plain"].signature


def test_a_hub_is_summed(spark):
    """A third of all contacts meet in one vertex; its colour comes from a sum."""
    edges = spark.range(3000).selectExpr("1 AS g", "'hub' AS a", "concat('v', id) AS b", "'k' AS kind")
    labels = edges.selectExpr("g", "b AS v", "'leaf' AS label").unionByName(edges.selectExpr("g", "a AS v", "'hub' AS label"))
    assert lineage.refined_signature(edges, labels, "g").first().contacts == 3000


def test_two_sided_signatures(spark):
    """Sums within partitions give what joins give, hubs and repeated contacts included, with one exchange."""
    rows = [(g, f"p{i * 7 % (3 + g)}", f"s{i % (1 + g)}", "NRA"[i % 3]) for g in range(6) for i in range(4 + 3 * g)] * 2 + [(9, "p1", f"s{i}", "N") for i in range(300)]
    edges = spark.createDataFrame(rows, "g int, a string, b string, kind string")
    labels = edges.selectExpr("g", "a AS v", "'part' AS label").unionByName(edges.selectExpr("g", "b AS v", "'supplier' AS label"))
    found = lineage.two_sided_signature(edges, "g", "part", "supplier")
    plan = found._jdf.queryExecution().executedPlan().toString()  # not yet run
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lineage.refined_signature(edges, labels, "g").collect()))
