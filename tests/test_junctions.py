"""Released foldbacks, precursors, routes, differences and pins on small inputs, against plain enumeration."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from plectra.functions.dna import BASES
from plectra.operators import difference, junction, pool

PAIRS = {"AT", "TA", "CG", "GC"}


def scripts(before, after):
    """All minimum scripts, by plain search over prefixes."""
    best = {(0, 0): (0, {""})}
    for i in range(len(before) + 1):
        for j in range(len(after) + 1):
            if i == j == 0:
                continue
            ways = []
            if i and j:
                c, s = best[i - 1, j - 1]
                same = before[i - 1] == after[j - 1]
                ways.append((c + (not same), {x + ("=" if same else "X") for x in s}))
            if i:
                c, s = best[i - 1, j]
                ways.append((c + 1, {x + "D" for x in s}))
            if j:
                c, s = best[i, j - 1]
                ways.append((c + 1, {x + "I" for x in s}))
            least = min(c for c, _ in ways)
            best[i, j] = least, set().union(*(s for c, s in ways if c == least))
    return best[len(before), len(after)]


def test_region_difference(spark):
    texts = ["".join(w) for n in range(4) for w in product("AC", repeat=n)] + ["GATTACA", "GATACA", "TTGATTACA"]
    pairs = [(a, b) for a in texts for b in texts] + [(None, "A"), ("A" * 300, "C" * 300), ("A" * 70000, ""), ("A" * 60000, "")]
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    got = {r.i: r.d for r in df.select("i", difference.region_difference(F.col("p.a"), F.col("p.b")).alias("d")).collect()}
    for i, (a, b) in enumerate(pairs):
        if a is None:
            assert got[i].correspondence == "unassessed"
        elif (len(a) + 1) * (len(b) + 1) > 65_536:
            assert got[i].correspondence == "unresolved_budget" and got[i].script is None
        elif len(a) > 1000:
            assert got[i].correspondence == "unique_minimum_edit" and got[i].script == "D" * len(a)
        else:
            cost, all_scripts = scripts(a, b)
            assert got[i].edits == cost
            if a == b:
                assert got[i].correspondence == "identical" and got[i].script == "=" * len(a)
            elif len(all_scripts) == 1:
                assert (got[i].correspondence, got[i].script) == ("unique_minimum_edit", next(iter(all_scripts)))
            else:
                assert (got[i].correspondence, got[i].script) == ("ambiguous_minimum_edit", None)


NICKS = [("n1", "AAGC", "top", 3), ("n2", "GNC", "bottom", 1), ("n3", "TW", "top", 2)]
RELEASES = [("r1", "CCAA", 1, 0), ("r2", "RGY", 4, 5)]


def agents(spark):
    return spark.createDataFrame(NICKS, "nick_id string, motif string, native string, cut int"), spark.createDataFrame(RELEASES, "release_id string, motif string, top int, bottom int")


def members(row, arm, nicked="top"):
    """All exact precursors of a node, by testing every word."""
    nick = next(n for n in NICKS if n[0] == row.nick_id)
    n = row.precursor_nt
    allowed = [set("ACGT") for _ in range(n)]
    turned = lambda m: m[::-1].translate(str.maketrans("ACGTRYWN", "TGCAYRWN"))
    motif = nick[1] if nick[2] == nicked else turned(nick[1])
    release = next(r for r in RELEASES if r[0] == row.release_id)[1]
    release = release if row.orientation == "forward" else turned(release)
    for start, m in ((row.nick_start, motif), (row.release_start, release)):
        for i, s in enumerate(m):
            if start + i >= 0:
                allowed[start + i] &= set(BASES[s])
    return [w for w in map("".join, product(*[sorted(a) for a in allowed])) if all(w[row.boundary + o] + w[row.active_end - 1 - o] in PAIRS for o in range(arm))]


@pytest.mark.parametrize("active", ["bottom", "top"])
def test_foldback_counts_equal_enumeration(spark, active):
    request = junction.FoldbackRequest(active=active, target=2, displacement=3, paired=2, turn=0, downstream=False, separated=False)
    nicks, releases = agents(spark)
    assert request.boundaries() == [2, 1, 3, 0, 4, 5]
    found = junction.foldback_search(nicks, releases, request, 10_000, 5)
    rows = found.examined.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(6 * 3 * 2 * 2))
    for r in rows:
        if r.precursor_nt <= 9:
            assert int(r.sequences) == len(members(r, 2, request.nicked))
    assert any(r.precursor_nt <= 9 and r.sequences > 0 for r in rows)
    told = found.summary.first()
    assert (told.space_size, told.examined, told.status, told.truncated_by) == (72, 72, "truncated", "hits")
    cut = junction.foldback_search(nicks, releases, request, 7, 100).summary.first()
    assert (cut.space_size, cut.examined, "nodes" in cut.truncated_by) == (72, 7, True)


def test_precursors_equal_enumeration(spark):
    request = junction.FoldbackRequest(active="bottom", target=2, displacement=1, paired=2, turn=0, downstream=False, separated=False)
    nicks, releases = agents(spark)
    rows = junction.foldback_search(nicks, releases, request, 1000, 1000).hits.where("precursor_nt <= 8").drop("space_size")
    every = junction.precursors(rows, F.repeat(F.lit("N"), F.col("precursor_nt").cast("int")), 2, 1 << 20, 1 << 20)
    made = {}
    for r in every.select("ordinal", "precursor", "hit").collect():
        made.setdefault(r.hit, []).append(r.precursor)
    assert made
    for r in rows.collect():
        assert sorted(made[r.hit]) == members(r, 2)
        assert len(set(made[r.hit])) == int(r.sequences)
    none = junction.precursors(rows, F.repeat(F.lit("A"), F.col("precursor_nt").cast("int")), 2, 10, 10).collect()
    assert {(r.blocker, r.precursor, r.examined) for r in none} == {("caller_domain_conflict", None, 0)}


def test_empty_catalogue_and_routes(spark):
    nicks, releases = agents(spark)
    request = junction.FoldbackRequest(active="top", target=0, displacement=0, paired=1, turn=0)
    found = junction.foldback_search(nicks.where("false"), releases, request, 10, 10)
    assert found.examined.count() == 0 and found.summary.first().status == "infeasible"
    scars = spark.createDataFrame([("ACGT",), ("GATC",), ("TTTT",)], "scar string")
    places = spark.createDataFrame([("g1", "NNNN", "top"), ("g2", "RNNN", "bottom")], "geometry_id string, template string, nicked string")
    routes = junction.basal_routes(scars, places, "GATC", 100, 100)
    told = {(r.scar, r.geometry_id): list(r.blockers) for r in routes.examined.collect()}
    assert told["GATC", "g1"] == ["retained_release_site_present"] and told["TTTT", "g2"] == ["retained_scar_domain_conflict"]
    assert [(r.scar, r.geometry_id, r.surviving) for r in routes.hits.orderBy("hit").collect()] == [("ACGT", "g1", "bottom"), ("ACGT", "g2", "top"), ("TTTT", "g1", "bottom")]
    counts = {r.template: (r.pairs, r.compatible, r.domain_conflicts, r.release_sites) for r in junction.route_counts(scars, places, "GATC").collect()}
    assert counts == {"NNNN": (3, 2, 0, 1), "RNNN": (3, 1, 1, 1)}


def test_pins_leave_the_focus_open(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "i int, left string, right string")
    pins = {"left": ["a"], "right": ["y"]}
    whole, open_left = pool.pin_reasons(pins), pool.pin_reasons(pins, focus="left")
    got = {r.i: (list(r.w), list(r.o)) for r in df.select("i", whole.alias("w"), open_left.alias("o")).collect()}
    assert got == {1: (["right:unassessed"], ["right:unassessed"]), 2: (["left:different", "right:different"], ["right:different"])}
    assert [list(r.w) for r in df.select(pool.pin_reasons({"left": ["a"]}, "left").alias("w")).collect()] == [[], []]
