"""Stopped searches, arms, precursors, compositions, groups and partitions against plain enumeration."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from plectra.functions.dna import BASES, masks
from plectra.operators import arms, composition, grouping, neighbour_graph as graphs, partitions, pool, ranks, stops

COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


def turned(word):
    return word.translate(COMPLEMENT)[::-1]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ranks_and_totals_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(g, k, rng.randrange(5)) for g in ("a", "b", None) for k in rng.sample(range(1000), 70)] + [("a", -5, 1)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): (r.rank, r.total) for r in ranks.running_total(ranks.rank_within(df.where("g IS NOT NULL"), "k", group="g", ranges=ranges), "k", "v", "total", "g", ranges).collect()}
    for g in ("a", "b"):
        held = sorted((k, v) for x, k, v in rows if x == g)
        for i, (k, _) in enumerate(held):
            assert got[g, k] == (i, sum(v for _, v in held[:i]))
    words = spark.createDataFrame([(w,) for w in ("b", "a", "ab", "", "zz", "z")], "w string")
    assert [r.w for r in ranks.rank_within(words, "w", ranges=ranges).orderBy("rank").collect()] == ["", "a", "ab", "b", "z", "zz"]
    assert ranks.rank_within(words.limit(0), "w").collect() == []


def test_ranges_part_the_keys(spark):
    df = spark.range(1000)
    bounds = ranks.range_bounds(df, "id", 20)
    assert len(bounds) == 19
    parts = df.groupBy(ranks.range_of(F.col("id"), bounds).alias("p")).count().collect()
    assert {r.p for r in parts} == set(range(20)) and max(r["count"] for r in parts) < 250
    plain = {i: sum(b <= i for b in bounds) for i in range(1000)}
    assert {r.id: r.p for r in df.select("id", ranks.range_of(F.col("id"), bounds).alias("p")).collect()} == plain


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_stopping_ordinals(spark, block):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < p) for k, p in (("few", 0.05), ("many", 0.5), ("none", 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, hit boolean")
    got = {r.k: r.stop for r in stops.stopping_ordinals(df, ["k"], "i", F.col("hit"), 7, block).collect()}
    want = {}
    for k in ("few", "many", "none"):
        hits = [i for x, i, h in rows if x == k and h]
        if len(hits) >= 7:
            want[k] = hits[6]
    assert got == want


def plain_arms(tract, most):
    exact = turned(tract)
    for m in range(min(len(tract), most) + 1):
        for places in itertools.combinations(range(len(tract)), m):
            for bases in itertools.product(*["ACGT".replace(exact[p], "") for p in places]):
                arm = list(exact)
                for p, b in zip(places, bases):
                    arm[p] = b
                yield "".join(arm)


def plain_codes(tract, arm, limits):
    same = [a == b for a, b in zip(tract, turned(arm))]
    runs = [len(list(g)) for k, g in itertools.groupby(same) if k]
    terminal = next((i for i, s in enumerate(same) if not s), len(same))
    tests = [not all(same[: limits.protected]), terminal < limits.least_terminal, max(runs, default=0) * 3 > len(tract) * limits.most_run_of_thirds]
    return [c for c, t in zip(arms.ARM_CODES, tests) if t]


@pytest.mark.parametrize("replaced", [0, 1, 2, 3])
def test_arms(spark, replaced):
    limits = arms.ArmLimits(replaced, 1, 2, 1, 300, 12)
    tracts = ["ACGTAC", "G", "AACCGGTTA", "TTTT"]
    nodes = arms.arm_nodes(spark.createDataFrame([(t,) for t in tracts], "tract string"), [], "tract", limits)
    got = {t: [] for t in tracts}
    for r in arms.with_arms(nodes, "tract").orderBy("ordinal").collect():
        got[r.tract].append((r.ordinal, r.space_size, r.arm, r.codes))
    for t in tracts:
        every = list(plain_arms(t, replaced))
        assert got[t] == [(i, len(every), a, plain_codes(t, a, limits)) for i, a in enumerate(every[:300])]
    told = {r.tract: r for r in stops.accounting(stops.stopped_search(nodes, ["tract"], "ordinal", "codes", limits.max_hits), ["tract"], "codes", "space_size", 300).collect()}
    for t in tracts:
        every, hits, examined = list(plain_arms(t, replaced)), 0, 0
        for a in every[:300]:
            examined += 1
            hits += not plain_codes(t, a, limits)
            if hits == limits.max_hits:
                break
        by = None if examined == len(every) else "max_hits" if hits == limits.max_hits else "max_search_nodes"
        status = "truncated" if by else "complete" if hits else "infeasible"
        assert (told[t].examined, told[t].hits, told[t].truncated_by, told[t].status) == (examined, hits, by, status)


def test_precursors(spark):
    requests = [("a", "NRYN", "AG", 0, 2), ("b", "ACGTN", "GG", 1, 3), ("c", "NNN", "CG", 1, 1), ("d", "N", "N", 0, 1)]
    df = spark.createDataFrame(requests, "key string, template string, motif string, start int, tract int")
    nodes = arms.precursor_nodes(df, ["key"], 20)
    rows = {k: sorted((r.ordinal, r.precursor, r.designed, r.codes) for r in nodes.where(F.col("key") == k).collect()) for k in "acd"}
    told = {r.key: r for r in arms.precursor_search(nodes, ["key"], 20, 5).collect()}
    for key, template, motif, start, tract in requests:
        domains = [BASES[s] for s in template]
        for i, m in enumerate(motif):
            domains[start + i] = "".join(b for b in domains[start + i] if b in BASES[m])
        every = ["".join(w) for w in itertools.product(*domains)]
        want = []
        for i, w in enumerate(every[:20]):
            designed = w + turned(w[-tract:])
            patterns = {"".join(f"[{BASES[s]}]" for s in m) for m in (motif, turned(motif))}
            sites = sum(len(re.findall(f"(?={p})", designed)) for p in patterns)
            want.append((i, w, designed, ["CAND-002"] if sites > 1 else []))
        if every:
            assert rows[key] == want
        observed = sum(not c for *_, c in want)
        assert (told[key].space_size, told[key].examined, told[key].observed, told[key].returned) == (len(every), len(want), observed, min(5, observed))
        assert told[key].domain_conflict == (not every)
        by = [n for n, t in (("max_search_nodes", len(every) > 20), ("max_hits", observed > 5)) if t]
        assert told[key].truncated_by == ",".join(by)


@pytest.mark.parametrize("nodes, accepted, all_valid", [(100, 3, False), (7, 100, False), (1000, 100, False), (1000, 100, True), (24, 5, False)])
def test_composition(spark, nodes, accepted, all_valid):
    axes = {"x": [f"x{i}" for i in range(4)], "y": ["y1", "y0"], "z": ["q", "p", "r"]}
    frames = {n: spark.createDataFrame([(v,) for v in values], f"{n} string") for n, values in axes.items()}
    rows = composition.product_nodes(frames, nodes)
    ok = F.col("ordinal") % 5 == 0
    status = F.when(ok, "accepted").otherwise("rejected")
    disposed = composition.dispositions(rows.withColumn("status", status).withColumn("reason", F.when(~ok, "no")), accepted, all_valid)
    got = [(r.ordinal, r.x, r.y, r.z, r.status, r.reason) for r in disposed.orderBy("ordinal").collect()]
    want, n = [], 0
    space = list(itertools.product(*map(sorted, axes.values())))
    for i, combo in enumerate(space[:nodes]):
        if n >= accepted:
            break
        n += i % 5 == 0
        want.append((i, *combo, "accepted" if i % 5 == 0 else "rejected", None if i % 5 == 0 else "no"))
    if all_valid:
        want = [(*w[:4], "rejected", w[5] or composition.ALL_VALID) for w in want]
    assert got == want
    told = composition.composition_summary(disposed, nodes, accepted).first()
    by = "max_realizations" if n >= accepted and len(want) < min(nodes, 24) else "max_combinations" if len(want) < 24 else None
    assert (told.nominal, told.examined, told.truncated_by) == (24, len(want), by)
    assert told.state == ("truncated" if by else "infeasible" if all_valid else "complete")


def test_groups(spark):
    rng = random.Random(1)
    options = [(i, rng.choice("EEL"), rng.choice("ab"), rng.choice([1, 2, None])) for i in range(20)] + [(40, "L", "a", 1), (41, "E", "b", 1)]
    df = spark.createDataFrame(options, "id long, kind string, product string, band int")
    brief = grouping.Brief({"m": "L", "a": "E", "z": "E"}, (("a", "m"), ("z",)), "id", "kind", "product", ("band",), 500, 6)
    by = {i: (p, b) for i, _, p, b in options}
    sides = [sorted(i for i, k, *_ in options if k == kind) for kind in ("E", "L", "E")]

    def reason(a, m, z):
        if len({a, m, z}) < 3:
            return "repeated_preparation"
        if None in (by[a][1], by[m][1], by[z][1]) or len({by[a][1], by[m][1], by[z][1]}) > 1:
            return "shared_property_mismatch"
        if by[a][0] != by[m][0]:
            return "different_products_within_group"
        return "repeated_product_between_groups" if by[a][0] == by[z][0] else None

    every = [(i, *s, reason(*s)) for i, s in enumerate(itertools.product(*sides))]
    want, n = [], 0
    for row in every[:500]:
        want.append(row)
        n += row[4] is None
        if n == 6:
            break
    evaluated = grouping.evaluated_sets(df, brief)
    assert sorted((r.ordinal, r.a, r.m, r.z, r.reason) for r in evaluated.collect()) == want
    told = grouping.coverage(df, evaluated, brief).first()
    assert (told.possible, told.evaluated, told.unexamined, told.sets) == (len(every), len(want), len(every) - len(want), 6)
    assert [told[r] for r in grouping.REASONS] == [sum(w[4] == r for w in want) for r in grouping.REASONS]
    assert sorted(tuple(r) for r in grouping.all_sets(df, brief).collect()) == sorted(row[1:4] for row in every if row[4] is None)


def test_sets_of_copies(spark):
    """Copies of options make lists and not rows of the joins; an option in two slots is in no set twice."""
    options = [(i, "ELS"[i % 3], "ab"[i % 3 // 2], 1) for i in range(120)] + [(0, "L", "a", 1), (7, "S", "b", None), (None, "S", "b", 1)]
    df = spark.createDataFrame(options, "id long, kind string, product string, band int")
    brief = grouping.Brief({"l": "E", "m": "L", "r": "S"}, (("l", "m"), ("r",)), "id", "kind", "product", ("band",), 1, 1)
    lists = grouping.joined_lists(df, brief).collect()
    assert len(lists) == 8 and max(len(x) for row in lists for x in (row.l, row.m, row.r)) == 32
    sides = [[i for i, k, _, band in options if k == kind and None not in (i, band)] for kind in "ELS"]
    want = sorted(x for x in itertools.product(*sides) if len(set(x)) == 3)
    assert len(want) == 40 * 41 * 40 - 40
    assert sorted(tuple(r) for r in grouping.all_sets(df, brief).collect()) == want


def test_sets_open_the_last_list_alone(spark):
    """The last slot's lists are longer, lose repeated options before they are opened, and are opened in a loop of their own."""
    options = [(i, kind, product, 1) for kind, product, ids in (("E", "a", range(3)), ("L", "a", range(2, 6)), ("S", "b", range(1, 300))) for i in ids]
    df = spark.createDataFrame(options, "id long, kind string, product string, band int")
    brief = grouping.Brief({"l": "E", "m": "L", "r": "S"}, (("l", "m"), ("r",)), "id", "kind", "product", ("band",), 1, 1)
    sets = grouping.all_sets(df, brief)
    want = sorted(x for x in itertools.product(range(3), range(2, 6), range(1, 300)) if len(set(x)) == 3)
    assert sorted(tuple(r) for r in sets.collect()) == want
    stages = dict((name, stage) for stage, name in re.findall(r"\*\((\d+)\) Generate explode\((\w)#", sets._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))
    assert set(stages) == {"l", "m", "r"} and stages["l"] == stages["m"] != stages["r"]
    assert sorted(len(row.r) for row in grouping.joined_lists(df, brief, grouping.OPENED).collect()) == [43, 128, 128]



def test_partitions(spark):
    rng = random.Random(8)
    sources = {i: "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((30, 12, 3, 25))}
    agents = {"a": ("CA", "top", 1), "b": ("GNT", "bottom", 2), "c": ("TTTTTT", "top", 3), "p": ("AT", "top", 1)}
    s = spark.createDataFrame(list(sources.items()), "key int, dna string").withColumn("n_nt", F.length("dna"))
    a = spark.createDataFrame([(k, *v) for k, v in agents.items()], "agent_id string, motif string, native string, cut int")
    found = partitions.nick_sites(s, a, "key", "dna")

    def cuts(key, names):
        out = set()
        for name in names:
            motif, native, cut = agents[name]
            for m, strand, at in ((motif, native, cut), (turned(motif), "bottom" if native == "top" else "top", len(motif) - cut)):
                for i in range(len(sources[key]) - len(m) + 1):
                    if all(x in BASES[y] for x, y in zip(sources[key][i:], m)) and 0 < i + at < len(sources[key]):
                        out.add((name, strand, i + at))
        return out

    assert {tuple(r) for r in found.collect()} == {(k, *c) for k in sources for n in agents for c in cuts(k, [n])}
    subsets = [(",".join(c), i, list(c)) for i, c in enumerate(itertools.chain(*[itertools.combinations(sorted(agents), w) for w in (1, 2)]))]
    required = {0: ("top", 0, 9), 1: ("bottom", 2, 12), 3: ("top", 5, 25)}
    required |= {0: next((("top", x, y) for x, y in [sorted(b for _, st, b in cuts(0, "ab") if st == "top")[:2]]), required[0])}
    sub = spark.createDataFrame(subsets, "subset string, ordinal int, agents array<string>")
    need = spark.createDataFrame([(k, *v) for k, v in required.items()], "key int, strand string, start int, stop int")
    got = {(r.key, r.subset): (r.failure, r.threshold, r.n_fragments, r.boundary_nicks, r.cleanup_nicks) for r in partitions.judged(s, found, sub, need, "key", 4, 14).collect()}
    for key, dna in sources.items():
        for name, _, members in subsets:
            made = cuts(key, members)
            pieces = set()
            for strand in ("top", "bottom"):
                edges = sorted({0, len(dna)} | {b for _, st, b in made if st == strand})
                pieces |= {(strand, x, y) for x, y in zip(edges, edges[1:])}
            kept = {required[key]} if key in required else set()
            size = lambda p: p[2] - p[1]
            threshold = max([4, *map(size, pieces - kept)])
            if {n for n, *_ in made} != set(members):
                failure = "site_absent"
            elif not kept <= pieces:
                failure = "retained_fragment_set_mismatch"
            elif threshold > 14:
                failure = "fragment_threshold_infeasible"
            else:
                failure = "retained_fragment_set_mismatch" if not kept or min(map(size, kept)) <= threshold else None
            nicks = {(st, b) for _, st, b in made}
            edge = {(st, b) for st, b in nicks if any(st == k[0] and b in k[1:] for k in kept)}
            assert got[key, name] == (failure, threshold if failure is None else None, len(pieces), len(edge), len(nicks - edge)), (key, name)


def test_survey_parts_add_up(spark):
    targets = spark.createDataFrame([(i, i % 3, f"w{i % 2}") for i in range(10)], "ordinal long, left_word int, right_word string")
    steps = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, 0, 1), (2, 0, 0), (77, 1, 0)], "ordinal long, witness int, exhausted int")
    r = pool.survey_coverage(targets, steps).first()
    assert (r.targets, r.examined, r.supported, r.excluded, r.unresolved, r.unexamined, r.undeclared) == (10, 3, 1, 1, 8, 7, 1)
    assert r.supported + r.excluded + r.unresolved == r.targets and (r.left_words, r.right_words) == (1, 1)
    assert pool.survey_coverage(targets.limit(0), steps.limit(0)).first().targets == 0


def descriptors(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.randrange(20), rng.random(), "".join(rng.choice("ACGT") for _ in range(rng.randrange(8))), rng.choice(["x", "y", None])) for i in range(n)]
    rows += [(n + i, 3, 0.5, "ACGT", "x") for i in range(n // 3)]  # a third of all rows are alike
    return rows, spark.createDataFrame(rows, "key long, s int, t double, word string, kind string")


COMPARED = graphs.Comparison("key", ("s", "t"), ("word",), ("kind",), (2.0, 1.0, 1.0))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1, *itertools.accumulate(zip(b, row, row[1:]), lambda left, c: min(left + 1, c[2] + 1, c[1] + (x != c[0])), initial=i + 1)][1:]
    return row[-1]


def test_neighbour_graph(spark):
    rows, df = descriptors(spark, 90)
    spread = [max(r[i] for r in rows) - min(r[i] for r in rows) for i in (1, 2)]

    def distance(a, b):
        shape = sum(abs(a[i] - b[i]) / spread[i - 1] for i in (1, 2)) / 2
        words = min(1.0, max(0.0, (edits(a[3], b[3]) - abs(len(a[3]) - len(b[3]))) / max(1, min(len(a[3]), len(b[3])))))
        return round((2 * shape + words + (a[4] != b[4])) / 4, 9)

    found = graphs.neighbour_graph(df, COMPARED, graphs.Settings(pivots=3, candidates=8, audited=30, neighbours=5, kept=8, through=4))
    audit = {r.a: r for r in found.audit.collect()}
    assert len(audit) == 30 and min(r.recall for r in audit.values()) >= 0.95
    edges = {}
    for r in found.edges.collect():
        edges.setdefault(r.a, []).append((r.place, r.distance, r.b))
    assert set(edges) == {r[0] for r in rows} and all(len(e) == 5 for e in edges.values())
    by = {r[0]: r for r in rows}
    for a in audit:
        exact = sorted(distance(by[a], r) for r in rows if r[0] != a)[:5]
        assert [d for _, d, _ in sorted(edges[a])] == pytest.approx(exact, abs=2e-9)
        assert all(d == pytest.approx(distance(by[a], by[b]), abs=2e-9) for _, d, b in edges[a])


def test_a_poor_graph_is_refused(spark, monkeypatch):
    _, df = descriptors(spark, 60)
    monkeypatch.setattr(graphs, "near_in_order", lambda orders, reach: orders.selectExpr("key AS a", "(key + 1) % 60 AS b").where("a <> b").distinct())
    with pytest.raises(graphs.LowRecall):
        graphs.neighbour_graph(df, COMPARED, graphs.Settings(pivots=2, candidates=4, most_candidates=8, audited=20, neighbours=5, kept=5, through=1, descents=0))


@pytest.mark.parametrize("few, worth, full", [(2048, 0.2, 16), (2048, 1.0, 0), (1, 1.0, 0), (1, 0.2, 16)])
def test_exact_graph(spark, monkeypatch, few, worth, full):
    """Every row's nearest by (distance, key), copies and missing numbers included, without windows; a window's graph may lack some."""
    monkeypatch.setattr(graphs, "near_in_order", lambda orders, reach: pytest.fail("no windows"))
    for name, value in (("FEW_TEXTS", few), ("WORTH_TILES", worth), ("FULL_CELL", full)):
        monkeypatch.setattr(graphs, name, value)
    rows, df = descriptors(spark, 60)
    rows = [(k, None if k % 11 == 0 else s, t, None if k % 13 == 0 else w, kind) for k, s, t, w, kind in rows]
    df = spark.createDataFrame(rows, df.schema)
    spread = [max(r[i] for r in rows if r[i] is not None) - min(r[i] for r in rows if r[i] is not None) for i in (1, 2)]

    def distance(a, b):
        shape = 0 if None in (a[1], b[1]) else sum(abs(a[i] - b[i]) / spread[i - 1] for i in (1, 2)) / 2
        x, y = a[3] or "", b[3] or ""
        words = min(1.0, max(0.0, (edits(x, y) - abs(len(x) - len(y))) / max(1, min(len(x), len(y)))))
        return round((2 * shape + words + (a[4] != b[4])) / 4, 9)

    found = graphs.exact_graph(df, COMPARED, graphs.Settings(audited=10, neighbours=5))
    got = sorted((r.a, r.place, r.distance) for r in found.edges.collect())
    want = [(a[0], i + 1, d) for a in sorted(rows) for i, d in enumerate(sorted(distance(a, b) for b in rows if b[0] != a[0])[:5])]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-9)
    assert found.candidates <= 6 and min(r.recall for r in found.audit.collect()) == 1.0


def test_audit_sample_takes_rare_classes_first(spark):
    df = spark.createDataFrame([(i, 1 if i < 50 else i, 0.0, "", None) for i in range(60)], "key long, s int, t double, word string, kind string")
    drawn = graphs.audit_sample(df, COMPARED, 12, "x").collect()
    assert len(drawn) == 12 and {r.key for r in drawn} > set(range(50, 60)) and math.isclose(len({r.structural_class for r in drawn}), 11)


def test_masks_of_a_template(spark):
    assert spark.range(1).select(masks(F.lit("ARN")).alias("m")).first().m == [1, 5, 15]
