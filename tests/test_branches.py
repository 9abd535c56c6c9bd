"""Branches, permissions, placements, exports and lookups against plain code."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plectra.functions.dna import BASES
from plectra.operators import branches, partitions
from plectra.sources import records

COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def turned(word):
    return word.translate(COMPLEMENT)[::-1]


@pytest.mark.parametrize("budget", [0, 2, 9])
def test_branch_decisions(spark, budget):
    names = [f"b{i}" for i in range(6)]
    targets = {"b0": [1, 2], "b1": [1], "b2": [], "b3": [3], "b4": [1, 2], "b5": [5]}
    held = {("b0", 1), ("b0", 2), ("b1", 1), ("b4", 2), ("b5", 6)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = branches.branch_decisions(
        frame([(n,) for n in names], "b string"), ["b"], frame([(n, t) for n, ts in targets.items() for t in ts], "b string, t int"), frame(sorted(held), "b string, t int"), "t", budget
    )
    want, left = [], budget
    for i, n in enumerate(names):
        matched = sum((n, t) in held for t in targets[n])
        if targets[n] and matched == len(targets[n]):
            decision = "reused"
        else:
            decision, left = ("evaluate", left - 1) if left > 0 else ("unexamined", left)
        want.append((n, i, len(targets[n]), matched, decision))
    assert [(r.b, r.ordinal, r.targets, r.matched, r.decision) for r in got.orderBy("b").collect()] == want


def test_conflicts_and_predicates(spark):
    members = spark.createDataFrame([("m", "a", 1), ("n", None, 9), ("o", "z", 9)], "member string, kind string, size int")
    permitted = spark.createDataFrame([("kind", "a"), ("kind", "b")], "field string, value string")
    assert {tuple(r) for r in branches.member_conflicts(members, "member", permitted).collect()} == {("o", "kind", "z", 2)}
    selections = {"kind": {"values": ["a"]}, "size": {"low": 1, "high": 5}, "free": {"values": ["x"]}}
    declared = spark.createDataFrame([("kind", "b"), ("size", "9"), ("size", "4"), ("size", "text")], "key string, value string")
    got = {r.key: (r.declared, r.accepted, r.permitted) for r in branches.predicates_permitted(selections, declared).collect()}
    assert got == {"kind": (1, 0, False), "size": (3, 1, True), "free": (0, 0, True)}


def test_by_id(spark):
    catalogue = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, v int")
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r.v for r in branches.by_id(asked("a", "a"), catalogue, "id").collect()] == [1, 1]
    for wrong in ("b", "c"):
        with pytest.raises(KeyError, match=wrong):
            branches.by_id(asked("a", wrong), catalogue, "id")


def test_mirrored_sites_are_those_of_the_turned_source(spark):
    """The sites of a sequence, mirrored, are the sites found on its reverse complement."""
    rng = random.Random(2)
    dna = "".join(rng.choice("ACGT") for _ in range(60))
    agents = spark.createDataFrame([("a", "CAN", "top", 1), ("b", "GT", "bottom", 2)], "agent_id string, motif string, native string, cut int")
    on = lambda seq: partitions.nick_sites(spark.createDataFrame([(1, seq)], "key int, dna string"), agents, "key", "dna")
    own = on(dna).withColumns({"start": F.lit(0), "orientation": F.lit("forward")})
    back = branches.mirrored(own, F.lit(0), F.lit(60)).select("agent_id", "strand", "boundary")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in on(turned(dna)).select("agent_id", "strand", "boundary").collect()}


def test_placed(spark):
    rows = spark.createDataFrame([("AAGC", "top", 1, s, b) for s in ("top", "bottom") for b in (0, 1, 3, 9, 10)], "motif string, native string, cut int, strand string, at int")
    for r in branches.placed(rows, F.col("strand"), F.col("at"), F.lit(10)).collect():
        assert r.start + (r.cut if r.orientation == "forward" else len(r.motif) - r.cut) == r.at
        assert (r.orientation == "forward") == (r.strand == r.native) and r.fits == (0 <= r.start and r.start + 4 <= 10)


def test_admitted_words(spark):
    words = ["".join(w) for w in itertools.product("ACGT", repeat=4)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    left = {r.word for r in branches.admitted_words(df, "word", ["CA", "GNC"], 300).collect()}
    sites = [set(map("".join, itertools.product(*[BASES[s] for s in m]))) for m in ("CA", "TG", "GNC")]
    assert left == {w for w in words if not any(w[i : i + len(next(iter(s)))] in s for s in sites for i in range(4))}
    with pytest.raises(ValueError):
        branches.admitted_words(df, "word", ["CA"], 100)


@pytest.mark.parametrize("width", [1, 3, 6])
def test_release_windows(spark, width):
    agents = [("r", "GNTC", 6, 2), ("s", "AC", 1, 3), ("t", "GGATC", 5, 5)]
    got = {(r.release_id, r.orientation): r.pattern for r in branches.release_windows(spark.createDataFrame(agents, "release_id string, motif string, top int, bottom int"), width).collect()}
    want = {}
    for name, motif, top, bottom in agents:
        for orientation, m, cut in (("forward", motif, top), ("reverse", turned(motif), len(motif) - bottom)):
            whole = {i - cut: s for i, s in enumerate(m)}  # by distance from the end
            want[name, orientation] = "".join(whole.get(i, "N") for i in range(-width, 0))
    assert got == want
    words = spark.createDataFrame([("".join(w),) for w in itertools.product("ACGT", repeat=width)], "word string")
    patterns = spark.createDataFrame([("p", want["r", "forward"])], "id string, pattern string")
    assert branches.matching_words(words, "word", patterns).count() == len(list(itertools.product(*[BASES[s] for s in want["r", "forward"]])))


def test_material_changes(spark):
    a = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("k", 3, None), ("l", 1, "x")], "key string, role int, m string")
    b = spark.createDataFrame([("k", 1, "x"), ("k", 2, "z"), ("k", 3, None), ("k", 4, "x")], "key string, role int, m string")
    assert {tuple(r) for r in branches.material_changes(a, b, "key", "role", "m").collect()} == {("k", 3, 1), ("l", 1, 0)}


def test_primer_binding(spark):
    df = spark.createDataFrame([("ACGTT", p) for p in ("AC", "AA", "AAC", "GT", "", "ACGTTA")], "t string, p string")
    assert [r.b for r in df.select(branches.primer_binding(F.col("t"), F.col("p")).alias("b")).collect()] == ["prefix", "suffix", "suffix", None, None, None]


def test_exports(spark, tmp_path):
    nested = spark.createDataFrame([(1, ["a", 'q"uote,'], {"k": 2}), (2, [], {})], "id int, words array<string>, facts map<string,int>")
    plain = spark.createDataFrame([("x\ny", None)], "t string, n int")
    folder = f"file://{tmp_path}/out"
    records.write_relations({"nested": nested, "plain": plain}, folder)
    back = records.read_relations(spark, folder)
    assert sorted(tuple(r) for r in back["nested"].collect()) == [("1", '["a","q\\"uote,"]', '{"k":2}'), ("2", "[]", "{}")]
    assert [tuple(r) for r in back["plain"].collect()] == [("x\ny", None)]
    with pytest.raises(Exception, match="exists"):
        records.write_relations({"plain": plain}, folder)
    plain.write.mode("append").csv(f"{folder}/plain", header=True)
    with pytest.raises(ValueError, match="plain"):
        records.read_relations(spark, folder)


def test_limits(spark):
    rows = spark.createDataFrame([("a", "ACGT"), ("b", "AC")], "record_id string, sequence string")
    assert records.limited(rows, 2, 6).count() == 2
    for limits in ((1, None), (None, 5)):
        with pytest.raises(ValueError):
            records.limited(rows, *limits)
    assert records.limited(rows.limit(0), 0, 0).count() == 0
