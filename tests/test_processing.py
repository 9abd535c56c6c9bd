"""Whole foldbacks, released states, paired domains, programs, levels and grids against plain code."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plectra.functions.dna import BASES
from plectra.operators import composition, enumerate as domains, pool, processing, scan

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def turned(word):
    return word.translate(COMPLEMENT)[::-1]


def test_foldback_faults(spark):
    rng = random.Random(7)
    limits = {"max_mismatches": 1, "terminal_min": 1, "terminal_max": 4, "max_run": 4, "max_added": 8, "turn_nt": 3}
    rows = []
    for i in range(60):
        pre = "".join(rng.choice("ACGT") for _ in range(rng.randrange(4, 12)))
        start = rng.randrange(0, 3)
        stop = rng.randrange(start, len(pre) + 1)
        exact = turned(pre[start:stop])
        arm = "".join(b if rng.random() < 0.8 else rng.choice("ACGT") for b in exact)
        low = rng.randrange(0, 6)
        rows.append((i, pre, start, stop, "AC"[: rng.randrange(3)], arm, low, low + rng.randrange(3)))
    df = spark.createDataFrame(rows, "i int, precursor string, start int, stop int, extension string, arm string, protected_start int, protected_stop int")
    got = {r.i: r for r in processing.evaluated_foldback(df, limits).collect()}
    for i, pre, start, stop, extension, arm, low, high in rows:
        same = [a == b for a, b in zip(pre[start:stop], turned(arm))]
        faults = [k for k, s in enumerate(same) if not s]
        longest = max([len(list(g)) for k, g in itertools.groupby(same) if k], default=0)
        terminal = faults[0] if faults else len(same)
        turn = len(pre) - stop + len(extension)
        tests = [len(faults) > 1, any(low <= start + k < high for k in faults), not 1 <= terminal <= 4, longest > 4, len(extension) + len(arm) > 8, turn != 3]
        assert (got[i].faults, got[i].longest, got[i].terminal, got[i].turn_nt) == (faults, longest, terminal, turn)
        assert got[i].codes == [f"FOLD-00{k + 1}" for k, t in enumerate(tests) if t]
        assert got[i].designed == pre + extension + arm


def test_released_states(spark):
    pre = "ACGTTGCA"
    cases = [(a, n, t, b) for a in ("top", "bottom") for n in (0, 2, 8) for t in (-1, 1, 5, 8) for b in (1, 5, 7, 9)]
    df = spark.createDataFrame([(pre, *c) for c in cases], "precursor string, active string, nick int, top_cut int, bottom_cut int")
    seen = 0
    for r in processing.released_state(df).collect():
        own, other = (r.top_cut, r.bottom_cut) if r.active == "top" else (r.bottom_cut, r.top_cut)
        tests = [not 0 < r.nick < 8, min(own, other) < 0 or max(own, other) > 8, own <= r.nick, other < own]
        assert r.codes == [c for c, t in zip(processing.RELEASE_CODES, tests) if t]
        if r.codes:
            assert r.active_product is None and r.partner_origins is None
            continue
        seen += 1
        kept, rest = pre[r.nick : own], pre[: r.nick]
        up, down = list(range(r.nick, own)), list(range(r.nick))
        if r.active == "top":
            want = (kept, up, turned(rest), down[::-1])
        else:
            want = (turned(kept), up[::-1], rest, down)
        assert (r.active_product, r.active_origins, r.retained_partner, r.partner_origins) == want
    assert seen


@pytest.mark.parametrize("wobble", [False, True])
def test_paired_domains(spark, wobble):
    partners = {"A": "T", "C": "G", "G": "CT" if wobble else "C", "T": "AG" if wobble else "A"}
    symbols = {frozenset(b): s for s, b in BASES.items()} | {frozenset(): "-"}
    rng = random.Random(1)
    cases = {("".join(rng.choice("ACGTRYSWN") for _ in range(rng.randrange(1, 5))), "".join(rng.choice("ACGTRYSWN") for _ in range(rng.randrange(1, 5)))) for _ in range(60)}
    df = spark.createDataFrame(sorted(cases), "s string, a string")
    for r in processing.paired_domains(df, "s", "a", wobble).collect():
        if len(r.s) != len(r.a):
            assert r.failure == "lengths_differ" and r.source_domain is None
            continue
        facing = [({x for x in BASES[p] if set(partners[x]) & set(BASES[q])}, {y for y in BASES[q] if any(y in partners[x] for x in BASES[p])}) for p, q in zip(r.s, r.a)]
        assert r.source_domain == "".join(symbols[frozenset(x)] for x, _ in facing)
        assert r.adapter_domain == "".join(symbols[frozenset(y)] for _, y in facing)
        bad = [i for i, (x, _) in enumerate(facing) if not x]
        assert r.failure == (f"no_pair_at_{bad[0]}" if bad else None)


def test_programs(spark):
    nicks = spark.createDataFrame([("n2", "AG"), ("n1", "C")], "nick_id string, motif string")
    releases = spark.createDataFrame([("r1", "CC"), ("r2", "AGT")], "release_id string, motif string")
    got = [tuple(r)[1:] for r in processing.programs(nicks, releases, ~F.contains("release_motif", "nick_motif")).orderBy("ordinal").collect()]
    alone = [("single", n, o, None) for n in ("n1", "n2") for o in ("forward", "reverse")]
    assert got == alone + [("two", n, o, r) for n, o, r in (("n1", "forward", "r2"), ("n1", "reverse", "r2"), ("n2", "forward", "r1"), ("n2", "reverse", "r1"))]


def test_every_level(spark):
    rows = [("a", 1, None), ("a", 1, "x"), ("a", 3, None), ("a", 9, None), ("b", 0, "y"), ("b", 0, "x")]
    df = spark.createDataFrame(rows, "g string, level int, reason string")
    got = {(r.g, r.level): (r.examined, r.accepted, r.reasons, r.status) for r in processing.integer_levels(df, "g", "level", "reason", 4, 2).collect()}
    assert got == {
        ("a", 0): (0, 0, "", "empty"), ("a", 1): (2, 1, "x", "complete"), ("a", 2): (0, 0, "", "empty"), ("a", 3): (1, 1, "", "quota_met"), ("a", 4): (0, 0, "", "unvisited"),
        ("b", 0): (2, 0, "x,y", "complete"), **{("b", i): (0, 0, "", "empty") for i in range(1, 5)},
    }


def test_bounded_agents(spark):
    rows = [("k", a, b) for a, b in (("a", []), ("b", ["x"]), ("c", []), ("d", []), ("e", []))]
    df = spark.createDataFrame(rows, "k string, agent string, blockers array<string>")
    got = {r.agent: (r.ordinal, r.hit) for r in processing.bounded_agents(df, ["k"], "agent", 4, 2).collect()}
    assert got == {"a": (0, 1), "b": (1, None), "c": (2, 2), "d": (3, None)}


def test_supported_union(spark):
    df = spark.createDataFrame([("a", 1, "w"), ("a", 2, "w"), ("a", 2, "w"), ("a", 2, "v"), ("b", 1, "w")], "case string, program int, word string")
    assert {tuple(r) for r in processing.supported_union(df, "case", "program", "word", 2).collect()} == {("a", "w", 2), ("a", "v", 1), ("b", "w", 1)}
    with pytest.raises(ValueError):
        processing.supported_union(df, "case", "program", "word", 1)


def test_assignment_text(spark):
    df = spark.createDataFrame([("ANR", "ACG"), ("ACGT", "ACGT"), ("", "")], "t string, w string")
    assert [r.x for r in df.select(domains.assignment_text(F.col("t"), F.col("w")).alias("x")).collect()] == ["2=C; 3=G", "", ""]


def test_addresses_turn_the_product_round(spark):
    axes = {n: spark.createDataFrame([(v,) for v in values], f"{n} string") for n, values in {"x": "cab", "y": "qp", "z": "7"}.items()}
    nodes = composition.product_nodes(axes, 100).withColumnRenamed("ordinal", "want")
    assert all(r.want == r.ordinal for r in composition.addresses(nodes, axes).collect())
    off = spark.createDataFrame([("a", "p", "8")], "x string, y string, z string")
    assert composition.addresses(off, axes).first().ordinal is None


def test_overhead_matrix(spark):
    found = spark.createDataFrame([("r", "c", 5, 2), ("r", "c", 5, 1), ("r", "c", 9, 0)], "row string, col string, cost int, key int")
    searched = spark.createDataFrame([("r", True), ("s", False), ("t", True)], "row string, whole boolean")
    columns = spark.createDataFrame([("c",), ("d",)], "col string")
    got = {(r.row, r.col): (r.least, r.rows, r.first_id, r.status) for r in pool.overhead_matrix(searched, columns, found, "row", "col", "cost", "key").collect()}
    assert got[("r", "c")] == (5, 3, 1, "found") and got[("r", "d")][3] == got[("t", "c")][3] == "infeasible" and got[("s", "d")] == (None, 0, None, "unknown")


def test_query_groups(spark):
    df = spark.createDataFrame([("p", 1, "a", 1), ("p", 2, "b", 1), ("p", 3, "c", 9), ("q", 4, "c", 1)], "product string, key int, kind string, size int")
    selections = {"kind": {"values": ["a"]}, "size": {"low": 0, "high": 5}}
    got = {r.product: tuple(r)[1:] for r in pool.query_groups(df, "product", "key", selections, "kind").collect()}
    assert got == {"p": (1, 2, 1, "a,b"), "q": (0, 1, None, "c")}


def test_distinct_words_of_long_and_short_sequences(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 3, 4, 63, 64, 65, 200, 9000)]
    df = spark.createDataFrame([(t,) for t in texts], "dna string")
    for size in (4, 9):
        assert {r.word for r in scan.distinct_words(df, "dna", size).collect()} == {t[i : i + size] for t in texts for i in range(len(t) - size + 1)}
