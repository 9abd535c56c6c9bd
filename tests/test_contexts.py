"""Shared variables, completions, release ends, compared routes, bounded matches and blocks against plain code."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plectra.operators import contexts

COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")
PARTNER = {1: 8, 2: 4, 4: 2, 8: 1}


def flip(mask):
    return sum(p for b, p in PARTNER.items() if mask & b)


def test_shared_variables(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(4), rng.random() < 0.5, rng.choice([15, 15, 5, 10, 12, 1])) for k in range(12) for i in range(7)]
    got = {(r.k, r.place): r for r in contexts.shared_variables(spark.createDataFrame(rows, "k int, place int, variable int, complement boolean, mask int"), ["k"]).collect()}
    failures = 0
    for k in range(12):
        own = [r for r in rows if r[0] == k]
        # Every assignment of bases to variables that all places allow.
        names = sorted({v for _, _, v, _, _ in own})
        fits = [
            dict(zip(names, bases))
            for bases in itertools.product((1, 2, 4, 8), repeat=len(names))
            if all((PARTNER[dict(zip(names, bases))[v]] if c else dict(zip(names, bases))[v]) & m for _, _, v, c, m in own)
        ]
        for _, place, v, c, _ in own:
            r = got[k, place]
            assert r.size == len(fits) and (r.failure is None) == bool(fits)
            if fits:
                assert r.domain == sum({PARTNER[f[v]] if c else f[v] for f in fits})
        failures += not fits
    assert 0 < failures < 12


@pytest.mark.parametrize("motifs", [["CA"], ["GATC", "CNA"], ["A"]])
def test_completions(spark, motifs):
    rng = random.Random(3)
    words = ["".join(w) for w in itertools.product("ACGT", repeat=4)]
    before, behind = rng.sample(words, 60), rng.sample(words, 50)
    df = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {r.word: r.completions for r in contexts.completions_of(df(before, "word"), "word", df(behind + behind[:5], "suffix"), "suffix", motifs).collect()}
    both = {m for motif in motifs for m in (motif, motif.translate(COMPLEMENT)[::-1])}
    site = re.compile("|".join(m.replace("N", "[ACGT]") for m in both))
    assert got == {a: sum(not site.search(a + b) for b in behind) for a in before}


def test_release_actions(spark):
    agents = [("r", "GGTC", 5, 9), ("s", "AA", 1, 1), ("t", "ACGT", 4, 2), ("u", "CC", -3, -1)]
    got = {(r.release_id, r.orientation): tuple(r)[2:] for r in contexts.release_actions(spark.createDataFrame(agents, "release_id string, motif string, top int, bottom int"), 2).collect()}
    for name, motif, top, bottom in agents:
        for o, (t, b) in (("forward", (top, bottom)), ("reverse", (len(motif) - bottom, len(motif) - top))):
            kind = "blunt" if t == b else "five_prime" if t < b else "three_prime"
            assert got[name, o] == (abs(b - t), kind, min(t, b) >= len(motif) or max(t, b) <= 0, b - t == 2)
    # A strand's overhang does not depend on the side it is read from.
    assert all(got[n, "forward"][:2] == got[n, "reverse"][:2] for n, *_ in agents)


def test_compared_routes(spark):
    left = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", "y"), (1, "d", "z")], "k int, region string, v string")
    right = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (1, "c", None), (1, "e", None)], "k int, region string, v string")
    got = {r.region: r.relation for r in contexts.compared_routes(left, right, ["k"], "region", "v").collect()}
    assert got == {"a": "same", "b": "same", "c": "changed", "d": "removed", "e": "added"}


@pytest.mark.parametrize("budget", [1, 3, 50])
def test_bounded_matches(spark, budget):
    rng = random.Random(budget)
    rows = [(g, k, rng.choice("ab"), rng.choice([1, None])) for g in "xyz" for k in rng.sample(range(100), 12)]
    wanted = {"x": ("a", 1), "y": ("b", None), "z": ("c", 1)}
    df = spark.createDataFrame(rows, "g string, k long, p string, q int")
    reference = spark.createDataFrame([(g, *w) for g, w in wanted.items()], "g string, p string, q int")
    got = {r.g: (r.examined, r.match, r.cursor) for r in contexts.bounded_matches(df, "g", "k", ["p", "q"], reference, budget).collect()}
    for g, want in wanted.items():
        own = sorted(((r[1], r[2:]) for r in rows if r[0] == g), key=lambda r: r[0])
        seen = own[:budget]
        hit = next((i for i, (_, props) in enumerate(seen) if props == want), None)
        if hit is None:
            assert got[g] == (len(seen), None, seen[-1][0] if len(own) > budget else None)
        else:
            assert got[g] == (hit + 1, seen[hit][0], None)


def test_blocks(spark):
    rows = spark.range(25).selectExpr("id AS k", "concat('v', id) AS v")
    recorded = contexts.block_digests(rows, "k", 10, ["v"])
    assert {(r.block, r.first, r["last"], r.rows) for r in recorded.collect()} == {(0, 0, 9, 10), (1, 10, 19, 10), (2, 20, 24, 5)}
    swapped = rows.withColumn("v", F.when(F.col("k") == 3, "v4").when(F.col("k") == 4, "v3").otherwise(F.col("v")))
    again = contexts.block_digests(swapped.where("k < 20").union(spark.createDataFrame([(31, "x")], "k long, v string")), "k", 10, ["v"])
    assert {tuple(r) for r in contexts.changed_blocks(recorded, again).collect()} == {(0, "changed"), (2, "missing"), (3, "extra")}
    assert contexts.changed_blocks(recorded, contexts.block_digests(rows.repartition(3), "k", 10, ["v"])).collect() == []


def test_facts_and_transitions(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (9, 7.5)], "a int, b double")
    got = {r.axis: tuple(r)[1:] for r in contexts.parameter_facts(rows, {"a": (1, 2), "b": (6, 8)}).collect()}
    assert got == {"a": (2, 1, 0, 1.0, 9.0), "b": (1, 1, 1, 5.0, 7.5)}
    steps = spark.createDataFrame([("k", 1, "s"), ("k", 2, "t"), ("k", 3, "s"), ("l", 1, "s"), ("l", 2, "t")], "key string, at int, state string")
    assert {tuple(r) for r in contexts.transitions(steps, "key", "at", "state").collect()} == {(None, "s", 2), ("s", "t", 2), ("t", "s", 1)}
