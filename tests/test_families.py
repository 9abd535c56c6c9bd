"""Rosters, revisions, shared budgets, edits, located measures and boundaries, product stages and flat files against plain code."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plectra.operators import families
from plectra.sources.genbank import FEATURE, genbank_text, read_genbank, write_genbank


def test_expanded_and_missing(spark):
    roster = spark.createDataFrame([("f", "a", 1, None), ("f", "b", None, None), ("g", "c", 2, "x")], "fam string, m string, size int, kind string")
    base = spark.createDataFrame([("f", 7, "z"), ("g", 8, None)], "fam string, size int, kind string")
    whole = families.expanded(roster, base, "fam", "m")
    assert {tuple(r) for r in whole.collect()} == {("f", "a", 1, "z", 1), ("f", "b", 7, "z", 0), ("g", "c", 2, "x", 2)}
    outcomes = spark.createDataFrame([(7, 5), (7, 3), (9, 1)], "size int, id int")
    got = {r["m"]: (r["outcomes"], r["first"], r["status"]) for r in families.with_outcomes(whole, outcomes, ["size"], "id").collect()}
    assert got == {"a": (0, None, "missing"), "b": (2, 3, "found"), "c": (0, None, "missing")}


@pytest.mark.parametrize("budget", [0, 1, 7, 13, 100])
def test_one_budget(spark, budget):
    rng = random.Random(budget)
    rows = [(m, k, rng.choice("ab"), rng.choice([1, None])) for m in "cabd" for k in rng.sample(range(50), rng.randrange(3, 8))]
    df = spark.createDataFrame(rows, "m string, k long, p string, q int")
    controls = spark.createDataFrame([("a", None)], "p string, q int")
    got = {r.m: tuple(r)[1:] for r in families.family_coverage(df, "m", "k", "b", ["p", "q"], controls, budget).collect()}
    left, want = budget, {}
    for m in "acd":
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[1])
        seen = own[:left]
        left -= len(seen)
        same = [r[1] for r in seen if r[2:] == ("a", None)]
        want[m] = (len(own), len(seen), len(own) - len(seen), len(same), min(same, default=None), sum((r[2] != "a") + (r[3] is not None) for r in seen))
    assert got == want and sum(v[1] for v in got.values()) == min(budget, sum(v[0] for v in got.values()))


def test_revisions(spark):
    rng = random.Random(8)
    before, after, asked = [], [], []
    for f in range(150):
        old = {m: rng.choice("xy") for m in rng.sample("abc", rng.randrange(1, 4))}
        source = rng.choice("abc") if rng.random() < 0.2 else rng.choice(sorted(old))
        target = source if rng.random() < 0.4 else rng.choice("abd")
        new = {m: (rng.choice("xy") if rng.random() < 0.1 else r) for m, r in old.items() if rng.random() < 0.95}
        if rng.random() < 0.9:
            new.setdefault(target, rng.choice("xy"))
        before += [(f, m, r) for m, r in old.items()]
        after += [(f, m, r) for m, r in new.items()]
        asked.append((f, source, target))
    schema = "f int, m string, r string"
    got = {r.f: (r.kind, r.kept, r.faults) for r in families.revisions(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), spark.createDataFrame(asked, "f int, source string, target string"), "f", "m", "r").collect()}
    seen = set()
    for f, source, target in asked:
        old, new = ({m: r for g, m, r in rows if g == f} for rows in (before, after))
        edit, faults = source != target, []
        if source not in old:
            faults.append(families.UNKNOWN_SOURCE)
        if set(new) != set(old) | {target}:
            faults.append(families.ROSTER)
        if edit and target in old:
            faults.append(families.TARGET_EXISTS)
        if any(m in new and new[m] != r for m, r in old.items()):
            faults.append(families.CHANGED_REQUEST)
        if edit and source in old and target in new and new[target] == old[source]:
            faults.append(families.UNCHANGED_EDIT)
        assert got[f] == ("edit" if edit else "continuation", sum(new.get(m) == r for m, r in old.items()), ",".join(faults)), f
        seen |= set(faults or ["none"])
    assert len(seen) == 6


def test_narrowed(spark):
    schema = "k int, least int, greatest int"
    got = families.narrowed(spark.createDataFrame([(1, 2, 9), (2, 2, 4), (3, 1, 1), (4, None, 5)], schema), spark.createDataFrame([(1, 5, 12), (2, 5, 6), (4, 3, None), (5, 0, 1)], schema), ["k"])
    assert {tuple(r) for r in got.collect()} == {
        (1, 5, 9, "user_within_context", False), (2, None, None, "user_within_context", True), (3, 1, 1, "context", False),
        (4, 3, 5, "user_within_context", False), (5, 0, 1, "user_within_context", False),
    }


def test_edits_and_methods(spark):
    declared = spark.createDataFrame([(1, "a", "choice", ["x"]), (1, "b", "list", ["x", "y"]), (1, "c", "choice", ["x"])], "k int, path string, kind string, values array<string>")
    edits = spark.createDataFrame([(1, "a", ["y"]), (1, "b", ["y", "x", "y"]), (1, "c", ["x", "y"]), (2, "a", ["x"])], "k int, path string, values array<string>")
    got = {(r.k, r.path): (r.before, r.after, r.outcome) for r in families.edited_declarations(declared, edits, ["k"]).collect()}
    assert got == {(1, "a"): ("x", "y", "changed"), (1, "b"): ("x,y", "x,y", "same"), (1, "c"): ("x", "x", "choose_one"), (2, "a"): (None, None, "not_declared")}
    catalogue = spark.createDataFrame([("m", 1), ("m", 1), ("n", 2), ("n", 3), ("o", 4)], "name string, method_id int")
    requests = spark.createDataFrame([(k, n) for k in (1, 2) for n in "mnop"], "k int, name string")
    barred = spark.createDataFrame([(1, 4), (2, 1), (2, 2)], "k int, method_id int")
    got = {(r.k, r.name): (r.method_id, r.outcome) for r in families.resolved_methods(requests, catalogue, barred, ["k"]).collect()}
    both = {"n": (None, "ambiguous"), "p": (None, "unknown")}
    assert got == {(k, n): v for k in (1, 2) for n, v in both.items()} | {(1, "m"): (1, "resolved"), (2, "m"): (None, "barred"), (1, "o"): (None, "barred"), (2, "o"): (4, "resolved")}


@pytest.fixture(scope="module")
def bases(spark):
    rng = random.Random(6)
    rows = []
    for k in range(6):
        rows += [(k, "s", i, i) for i in range(12)]
        a, b = sorted(rng.sample(range(1, 12), 2))
        order = [*range(a, b)][::-1] + [*range(a)] + [*range(b, 12)] + [*range(rng.randrange(4))]
        rows += [(k, "t", i, o) for i, o in enumerate(order)]
    return rows, spark.createDataFrame(rows, "k int, state string, index int, origin int")


def test_measures(spark, bases):
    rows, df = bases
    rng = random.Random(2)
    measures = [(k, m) for k in range(6) for m in "uvw"]
    references = [(k, m, "s", i) for k, m in measures for i in (rng.sample(range(16), 3) if m != "w" else [])]
    got = families.measure_occurrences(spark.createDataFrame(measures, "k int, measure string"), spark.createDataFrame(references, "k int, measure string, state string, index int"), df, ["k"]).collect()
    want = set()
    for k, m in measures:
        origins = {i for g, n, _, i in references if (g, n) == (k, m) and i < 12}
        for state in "st":
            places = [i for g, s, i, o in rows if (g, s) == (k, state) and o in origins]
            if places:
                want.add((k, m, state, len(places), min(places), max(places)))
        if not origins:
            want.add((k, m, None, 0, None, None))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_boundaries(spark, bases):
    rows, df = bases
    anchors = [(k, f"{b}/{a}", b, a) for k in range(6) for b, a in [(2, 3), (5, 4), (7, None), (None, 9), (8, None), (None, None)]]
    cuts = [(k, b, a) for k in range(6) for b, a in [(7, 8), (7, 8), (8, 9), (8, 10), (6, None)]]
    got = families.boundary_occurrences(spark.createDataFrame(anchors, "k int, anchor string, before int, after int"), spark.createDataFrame(cuts, "k int, before int, after int"), df, ["k"]).collect()
    want = set()
    # 7 has one cut and so has 9; 8 has two that disagree, and a null side of a cut says nothing.
    for k, name, b, a in anchors:
        b, a = {(7, None): (7, 8), (None, 9): (8, 9)}.get((b, a), (b, a))
        if b is None or a is None:
            continue
        for state in "st":
            at = {i: o for g, s, i, o in rows if (g, s) == (k, state)}
            for i in range(1, len(at)):
                if (at[i - 1], at[i]) in ((b, a), (a, b)):
                    want.add((k, name, state, i, 1 if at[i - 1] == b else -1))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 12
    assert not [r for r in got if r.anchor == "8/None"] and [r for r in got if r.anchor == "7/None"]


def test_product_stages(spark):
    portrait = [(k, o, r) for k in (1, 2, 3) for o, r in [(0, "stem"), (1, "stem"), (1, "open"), (2, "closing"), (2, "closing")]]
    strands = [(k, s, i, i if s == 0 else 3 - i) for k in (1, 2, 3) for s in (0, 1) for i in range(4)]
    pairs = [(1, i, 4 - i) for i in range(1, 4)] + [(2, 0, 3), (2, 1, 1)]
    got = families.product_stages(
        spark.createDataFrame(portrait, "k int, origin int, region string"), spark.createDataFrame(strands, "k int, strand int, index int, origin int"),
        spark.createDataFrame(pairs, "k int, top int, bottom int"), "k",
    ).collect()
    region = {0: "stem", 1: "unmapped", 2: "closing", 3: "unmapped"}
    want = {(1, s, i, i if s == 0 else 4 - i, region[o], None) for k, s, i, o in strands if k == 1}
    assert {tuple(r) for r in got} == want | {(2, None, None, None, None, "no_single_frame"), (3, None, None, None, None, "no_paired_duplex")}


def test_chosen_routes(spark):
    chosen = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), ("s", 4)], "who string, route int")
    dispositions = spark.createDataFrame([(1, "ok"), (2, "bad"), (4, "ok")], "route int, status string")
    steps = spark.createDataFrame([(r, s) for r in (1, 2, 3) for s in (30, 10, 20)], "route int, step int")
    got = {(r.who, r.outcome, r.step, r.place) for r in families.chosen_routes(chosen, dispositions, steps, "route", "step", ["ok"]).collect()}
    assert got == {("p", "accepted", 10, 0), ("p", "accepted", 20, 1), ("p", "accepted", 30, 2), ("q", "rejected", None, None), ("r", "unknown", None, None), ("s", "accepted", None, None)}


def plain_record(name, seq, features):
    import hashlib

    lines = [f"LOCUS       {name:<16} {len(seq):>11} bp    ds-DNA     linear   SYN 01-JAN-1980", f"DEFINITION  {name}.", "ACCESSION   " + hashlib.sha256(seq.encode()).hexdigest()[:16], "FEATURES             Location/Qualifiers"]
    if seq:
        lines.append(f"     {'source':<16}1..{len(seq)}")
    for kind, start, stop, complement, qualifier, value in features:
        span = f"{start + 1}..{stop}"
        doubled = value.replace('"', '""')
        lines += [f"     {kind:<16}" + (f"complement({span})" if complement else span), f'{"":21}/{qualifier}="{doubled}"']
    lines.append("ORIGIN")
    for i in range(0, len(seq), 60):
        lines.append(f"{i + 1:>9} " + " ".join("".join(w) for w in itertools.batched(seq[i : i + 60].lower(), 10)))
    return "\n".join([*lines, "//"])


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    out = []
    for i, n in enumerate([0, 1, 9, 10, 59, 60, 61, 120, 777]):
        seq = "".join(rng.choice("ACGTN") for _ in range(n))
        features = [("primer_bind" if j % 2 else "misc_feature", s, rng.randint(s + 1, n), j % 3 == 0, "label", f'a "b" {j}\\d') for j in range(n % 4) for s in [rng.randrange(n)]]
        out.append((f"rec{i}", seq, features))
    return out


def test_genbank_text(spark, records):
    df = spark.createDataFrame(records, f"id string, seq string, features array<{FEATURE}>")
    got = {r.id: r.t for r in df.select("id", genbank_text(F.col("id"), F.col("seq"), F.col("features")).alias("t")).collect()}
    assert got == {name: plain_record(name, seq, features) for name, seq, features in records}
    odd = spark.createDataFrame([("x", None, None)], df.schema).select(genbank_text(F.col("id"), F.col("seq"), F.col("features"))).first()[0]
    assert odd == plain_record("x", "", [])


def test_genbank_round_trip(spark, records, tmp_path):
    df = spark.createDataFrame(records, f"id string, seq string, features array<{FEATURE}>").repartition(3)
    write_genbank(df, "id", "seq", "features", str(tmp_path / "gb"))
    back = {r.record_id: (r.sequence, [tuple(f) for f in r.features]) for r in read_genbank(spark, str(tmp_path / "gb")).collect()}
    assert back == {name: (seq, features) for name, seq, features in records}
    with pytest.raises(Exception, match="over 16"):
        write_genbank(df.withColumn("id", F.lit("x" * 17)), "id", "seq", "features", str(tmp_path / "long"))
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn/a.gb").write_text(plain_record("t", "ACGTACGTAC", []).replace("acgtacgtac", "acgtac") + "\n")
    with pytest.raises(Exception, match="not whole"):
        read_genbank(spark, str(tmp_path / "torn")).collect()
