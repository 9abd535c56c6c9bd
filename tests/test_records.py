"""Navigators, learned exclusions, resumable batches, ancestry and option pages against plain code."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plectra.functions.dna import BASES
from plectra.operators import junction, lineage, navigation, pool
from plectra.streaming import batches

COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")


@pytest.mark.parametrize("page_size, max_nodes", [(3, 7), (1, 100), (5, 2), (50, 1000)])
def test_pages(spark, page_size, max_nodes):
    sizes = [3, 4, 2]
    rng = random.Random(page_size)
    order = sorted(itertools.product(*map(range, sizes)), key=lambda c: (sum(c), c))
    held = [c for c in order if rng.random() < 0.5]
    planes = {(c[0], c[2]) for c in order if rng.random() < 0.15}
    pages = spark.createDataFrame([(*c, i) for i, c in enumerate(held)], "c0 long, c1 long, c2 long, what int")
    empty = spark.createDataFrame(sorted(planes), "c0 long, c2 long")
    at, cursor, got, want = 0, None, [], []
    for _ in range(60):
        found = navigation.scan_page(spark, sizes, pages, empty, ["c0", "c2"], cursor, page_size, max_nodes)
        rows = [(r.wave, r.c0, r.c1, r.c2) for r in found.rows.orderBy("wave", "c0", "c1", "c2").collect()]
        window = order[at : at + max_nodes]
        hits = [(sum(c), *c) for c in window if c in held and (c[0], c[2]) not in planes][:page_size]
        assert rows == hits and found.examined == len(window)
        full = len(hits) == page_size
        end = order.index(hits[-1][1:]) + 1 if full else at + len(window)
        assert found.cursor == (None if not full and len(window) < max_nodes else (sum(order[end - 1]), *order[end - 1]) if end > at else None)
        got += rows
        if found.cursor is None:
            break
        at, cursor = end, found.cursor
    else:
        raise AssertionError("the pages do not end")
    assert got == [(sum(c), *c) for c in order if c in held and (c[0], c[2]) not in planes]


def test_waves(spark):
    sizes = [2, 5, 3]
    plain = sorted((sum(c), *c) for c in itertools.product(*map(range, sizes)))
    assert navigation.wave_sizes(sizes) == [sum(w == k for w, *_ in plain) for k in range(8)]
    got = sorted(tuple(r) for r in navigation.wave_nodes(spark, sizes, 2, 4).collect())
    assert got == [c for c in plain if 2 <= c[0] <= 4]


def test_learned_exclusions(spark):
    rng = random.Random(5)
    words = ["".join(w) for w in itertools.product("ACGT", repeat=5)]
    seen = rng.sample(words, 200)
    motifs, flank = [("m", "GANTC"), ("p", "AT"), ("long", "TTTTTTTTTTT")], "TCA"
    df = lambda values: spark.createDataFrame([(v,) for v in values], "word string")
    patterns = navigation.site_patterns(df(seen), spark.createDataFrame(motifs, "motif_id string, motif string"), "word", flank)
    want = set()
    for word in seen:
        for name, m in motifs:
            for o, motif in (("forward", m), ("reverse", m.translate(COMPLEMENT)[::-1])):
                for start in range(5):
                    site = (word + flank)[start : start + len(motif)]
                    if len(site) == len(motif) and all(a in BASES[b] for a, b in zip(site, motif)):
                        want.add((("N" * start + motif[: 5 - start]).ljust(5, "N"), name, o, start))
    assert {tuple(r) for r in patterns.collect()} == want and want
    classes = [re.compile("".join(f"[{BASES[s]}]" for s in p)) for p, *_ in want]
    left = sorted(r.word for r in navigation.without_patterns(df(words), "word", patterns).collect())
    assert left == [w for w in words if not any(c.fullmatch(w) for c in classes)]
    assert navigation.without_patterns(df(words), "word", patterns.limit(0)).count() == len(words)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/log"


def targets_of(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def doubled(own):
    """No row for a multiple of five, two for others."""
    return own.where("k % 5 <> 0").select("k", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))


def test_batches_resume(spark, folder):
    targets = targets_of(spark, 23)
    first = batches.advance(targets, "k", doubled, folder, "p", 4, 10)
    assert (first.new_targets, first.new_batches, first.targets, first.reason) == (10, 3, 10, batches.BUDGET)
    torn = batches.write_batch(doubled(targets).withColumn("i", F.lit(9)), folder)  # no manifest names it
    schema = doubled(targets).schema
    rows = lambda: sorted(tuple(r) for r in batches.committed(spark, folder, schema).collect())
    plain = lambda n: [(k, i) for k in range(n) if k % 5 for i in (0, 1)]
    assert rows() == plain(10) and torn
    second = batches.advance(targets, "k", doubled, folder, "p", 100, 100)
    assert (second.new_targets, second.new_batches, second.targets, second.reason) == (13, 1, 23, batches.EXHAUSTED)
    assert rows() == plain(23)
    assert batches.verify(spark, folder) == 4
    assert batches.recomputed(targets, "k", doubled, folder).collect() == []
    changed = batches.recomputed(targets, "k", lambda own: doubled(own).withColumn("i", F.when(F.col("k") == 3, 7).otherwise(F.col("i"))), folder)
    assert sorted((r.side, r.k, r.i) for r in changed.collect()) == [("missing", 3, 7), ("missing", 3, 7), ("unexpected", 3, 0), ("unexpected", 3, 1)]
    with pytest.raises(ValueError, match="another plan"):
        batches.advance(targets, "k", doubled, folder, "q", 1, 1)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        batches.commit(spark, folder, 0, "data/x", "p", 1, (0, 0, "0"))


def test_a_changed_batch_is_told(spark, folder):
    batches.advance(targets_of(spark, 6), "k", doubled, folder, "p", 3, 6)
    name = batches.manifests(spark, folder).where("batch = 1").first().data
    doubled(targets_of(spark, 3)).write.mode("append").parquet(f"{folder}/{name}")
    with pytest.raises(batches.TornBatch):
        batches.verify(spark, folder)


def test_storage_stops_a_run(spark, folder):
    told = batches.advance(targets_of(spark, 50), "k", doubled, folder, "p", 5, 50, max_bytes=100)
    assert told.reason == batches.STORAGE and 0 < told.new_targets < 50
    assert batches.advance(targets_of(spark, 0), "k", doubled, f"{folder}-none", "p", 5, 5).reason == batches.EXHAUSTED
    assert batches.committed(spark, f"{folder}-none", doubled(targets_of(spark, 0)).schema).collect() == []


def test_admission(spark):
    targets = targets_of(spark, 6).withColumnRenamed("k", "ordinal")
    parts = targets.withColumn("part", F.col("ordinal") % 2).withColumn("request", F.lit("r")).withColumn("effort", F.lit(1))
    told = lambda p, t=targets: batches.admission(p, t).first().refused
    assert told(parts) == "" and told(parts.union(parts)) == ""
    assert told(parts.where("part = 0")) == "too_few,incomplete"
    assert told(parts.withColumn("request", F.col("part").cast("string"))) == "mixed_request"
    assert told(parts.withColumn("effort", F.col("part"))) == "mixed_effort"
    assert told(parts.unionByName(parts.where("ordinal = 3").withColumn("part", F.lit(0)))) == "overlapping"
    assert told(parts, targets.where("ordinal <> 3")) == "undeclared"
    assert told(parts, targets.limit(0)) == "undeclared" and told(parts.limit(0)) == "too_few,incomplete"
    assert batches.admission(parts.withColumn("part", F.col("ordinal")), targets, 5).first().refused == "too_many"
    assert batches.united(parts, targets, targets).count() == 6 and batches.united(parts.where("part = 0"), targets, targets).count() == 0


def test_islands_and_spans(spark):
    cases = {"forward": [4, 5, 6, 7], "back": [7, 6, 5, 1, 2], "turn": [1, 2, 3, 2, 1], "apart": [1, 3, 5], "gap": [0, 1, None, 3, 4]}
    rows = [(k, i, o) for k, origins in cases.items() for i, o in enumerate(origins) if o is not None]
    df = spark.createDataFrame(rows, "key string, index long, origin long")
    got = {}
    for r in lineage.islands(df, ["key"], "index", "origin").collect():
        got.setdefault(r.key, set()).add((r.start, r.length, r.first_origin, r.direction))
    assert got == {
        "forward": {(0, 4, 4, 1)},
        "back": {(0, 3, 7, -1), (3, 2, 1, 1)},
        "turn": {(0, 3, 1, 1), (3, 2, 2, -1)},
        "apart": {(0, 1, 1, 0), (1, 1, 3, 0), (2, 1, 5, 0)},
        "gap": {(0, 2, 0, 1), (3, 2, 3, 1)},
    }
    anchors = spark.createDataFrame([("forward", 5, 7), ("back", 5, 7), ("back", 1, 5), ("forward", 4, 4), ("gap", 1, 3), ("apart", 1, 3)], "key string, first long, last long")
    found = {(r.key, r.first, r["last"]): (r.start, r.stop, r.direction) for r in lineage.span_locations(anchors, df, ["key"], "index", "origin").collect()}
    assert found == {("forward", 5, 7): (1, 4, 1), ("back", 5, 7): (0, 3, -1), ("forward", 4, 4): (0, 1, 0)}


def test_correspondence(spark):
    before = spark.createDataFrame([("a", i, o) for i, o in enumerate("xyzz")], "key string, index long, origin string")
    after = spark.createDataFrame([("a", i, o) for i, o in enumerate("wyxx")], "key string, index long, origin string")
    got = {r.origin: (r.reference, r.target, r.relation) for r in lineage.correspondence(before, after, ["key"], "index", "origin").collect()}
    assert got == {"x": (None, None, "repeated"), "y": (1, 1, "retained"), "z": (None, None, "unmapped_reference"), "w": (None, None, "unmapped_target")}


OPTIONS = [("a", 1, "x"), ("a", 2, "x"), ("b", 2, "y"), ("b", None, "y"), ("c", 9, None)]
SELECTIONS = {"kind": {"values": ["a", "b"]}, "size": {"low": 1, "high": 2}, "brand": {"values": ["x"]}}


def test_parameter_pages(spark):
    df = spark.createDataFrame(OPTIONS, "kind string, size int, brand string")
    declared = spark.createDataFrame([(v, i) for i, v in enumerate([1, 2, 3, 9])], "value int, rank long")
    got = [tuple(r) for r in pool.parameter_page(df, "size", declared, SELECTIONS, 3).orderBy("value").collect()]
    assert got == [(1, 0, "supported", 1, 1, ""), (2, 0, "supported", 1, 2, "brand"), (3, 0, "no_complete_preparation_recorded", 0, 0, ""), (9, 1, "blocked_by_selections", 0, 1, "brand,kind")]


def test_choice_axes(spark):
    df = spark.createDataFrame(OPTIONS, "kind string, size int, brand string")
    declared = spark.createDataFrame([("kind", "b"), ("size", "1"), ("size", "5")], "axis string, value string")
    got = {r.axis: tuple(r)[1:] for r in pool.choice_axes(df, ["kind", "size", "brand"], SELECTIONS, declared).collect()}
    assert got == {"kind": (1, 2, True, False, True, "declared"), "size": (2, 3, True, True, False, "declared"), "brand": (1, 1, False, False, False, "observed_only")}


def test_families_count_repeats(spark):
    rows = [("p", "x"), ("p", "x"), ("q", "x"), ("r", "x"), ("r", "x"), ("s", None)]
    df = spark.createDataFrame(rows, "product string, feature string")
    found = {r.first_product: r.products for r in pool.feature_families(df, "product", ["feature"]).collect()}
    assert found == {"p": 2, "q": 1, "s": 1}
    assert {r.first_product: r.products for r in pool.families(df, "product", ["feature"]).collect()} == {"p": 3, "s": 1}


def test_pair_accounting(spark):
    pairs = spark.createDataFrame([(9, None), (9, "no"), (9, None)], "space_size long, blocker string")
    told = lambda p, r, hits, rows=pairs: tuple(junction.pair_accounting(rows, spark.createDataFrame([(p, r)], "_p boolean, _r boolean"), hits).first())
    assert told(True, False, 1) == (9, 3, 2, 1, "released_precursors,max_search_nodes,max_hits", "truncated")
    assert told(False, False, 5, pairs.withColumn("space_size", F.lit(3))) == (3, 3, 2, 2, "", "complete")
    assert told(False, True, 5, pairs.limit(0)) == (0, 0, 0, 0, "basal_routes", "truncated")
    assert told(False, False, 5, pairs.where("blocker IS NOT NULL").withColumn("space_size", F.lit(1)))[-1] == "infeasible"
