"""Published small cases and properties of the sequence operators."""

import hashlib
import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plectra.functions import dna
from plectra.operators import bounded, enumerate as domains, lineage, pool, scan
from plectra.sources import records
from plectra.streaming import steps as resumable


def test_reverse_complement_keeps_symbols(spark):
    rows = spark.createDataFrame([("GGTCTC",), ("RNT",)], "s string").select(dna.reverse_complement(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == ["GAGACC", "ANY"]


def test_expansion_is_lexical_and_budgeted(spark):
    df = spark.createDataFrame([("a", "RY"), ("b", "BDN")], "id string, seq string")
    rows = domains.expand(df, ["id"], "seq", 35).orderBy("id", "variant").collect()
    assert [(r.id, r.status, r.word) for r in rows] == [("a", "expanded", w) for w in ("AC", "AT", "GC", "GT")] + [("b", "over_budget", None)]
    assert domains.expand(df, ["id"], "seq", 36).where("id = 'b'").count() == 36


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ACGTRYSWKMBDHVN", min_size=1, max_size=4))
def test_motif_words_match_product(motif):
    want = ["".join(w) for w in itertools.product(*(dna.BASES[s] for s in motif))]
    assert scan.motif_words(motif) == want
    assert scan.reverse_motif(scan.reverse_motif(motif)) == motif


def test_word_budget():
    with pytest.raises(ValueError):
        scan.motif_words("N" * 7)


def test_sites_of_both_orientations(spark):
    seq = spark.createDataFrame([(1, "AAGCGCTT")], "id int, seq string")
    nicks = scan.scan_nicks(seq, ["id"], "seq", [("n", "AAGC", "top", 1)]).orderBy("start").collect()
    assert [(r.orientation, r.start, r.nick_boundary, r.nicked_strand) for r in nicks] == [("forward", 0, 1, "top"), ("reverse", 4, 7, "bottom")]
    out = scan.scan_releases(seq, ["id"], "seq", [("r", "AAGC", 1, 9)]).collect()
    assert out == []  # a cut past the end


def test_accounting(spark):
    space = spark.range(10).withColumnRenamed("id", "ordinal")
    blockers = F.array_compact(F.array(F.when(F.col("ordinal") % 2 == 1, F.lit("odd"))))
    whole = bounded.bounded_search(space, "ordinal", blockers, [F.col("ordinal").desc()], 10, 10)
    assert tuple(whole.summary.first()) == (10, 10, 5, "complete", "")
    cut = bounded.bounded_search(space, "ordinal", blockers, [F.col("ordinal").desc()], 5, 2)
    assert tuple(cut.summary.first()) == (10, 5, 3, "truncated", "nodes,hits")
    assert [r.ordinal for r in cut.hits.collect()] == [4, 2]
    none = bounded.bounded_search(space, "ordinal", F.array(F.lit("no")), [F.col("ordinal")], 10, 10)
    assert none.summary.first().status == "infeasible"
    early = bounded.bounded_search(space, "ordinal", F.array(F.lit("no")), [F.col("ordinal")], 5, 10)
    assert early.summary.first().status == "truncated"


def test_facets_omit_their_own_predicate(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 9), (4, None, 1)], "id int, k string, n int")
    got = {(r.axis, r.value): (r.records, r.conditional_records) for r in pool.facets(rows, ["k", "n"], {"k": {"values": ["a"]}, "n": {"low": 0, "high": 5}}, "id").collect()}
    assert got == {("k", "a"): (1, 1), ("k", "b"): (2, 1), ("k", None): (1, 1), ("n", "1"): (3, 1), ("n", "9"): (1, 0)}


def test_interleave_uneven_populations(spark):
    rows = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 0)] + [("c", i) for i in range(2)], "p string, m int")
    got = [(r.p, r.m) for r in domains.interleave(rows, "p", "m").orderBy("rank").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2), ("a", 3)]


def test_spans_need_unbroken_origins(spark):
    rows = spark.createDataFrame([("x", i, o) for i, o in enumerate([5, 6, 7, 20, 21, 3])], "k string, i int, o int")
    got = sorted((r.start, r.length, r.origin) for r in lineage.span_runs(rows, ["k"], "i", "o").collect())
    assert got == [(0, 3, 5), (3, 2, 20), (5, 1, 3)]


def test_fasta_and_csv_round_trip(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">a first\nACGT\nAC\n>b\nRYN\n")
    rows = records.read_fasta(spark, str(path)).orderBy("record_id").collect()
    assert [(r.record_id, r.sequence) for r in rows] == [("a", "ACGTAC"), ("b", "RYN")]
    out = str(tmp_path / "out")
    records.write_fasta(records.read_fasta(spark, str(path)), "record_id", "sequence", out, 4)
    again = records.read_fasta(spark, out).orderBy("record_id").collect()
    assert [(r.record_id, r.sequence) for r in again] == [("a", "ACGTAC"), ("b", "RYN")]
    table = tmp_path / "x.csv"
    table.write_text("name,seq\na,acgt\n")
    assert records.read_csv(spark, str(table), "name", "seq").first().sequence == "ACGT"
    with pytest.raises(ValueError):
        records.read_csv(spark, str(table), "name", "missing")


def test_duplicate_policies(spark):
    rows = spark.createDataFrame([("a", "AC", 0), ("b", "AC", 1), ("c", "GT", 2)], "record_id string, sequence string, ordinal int")
    assert records.collect_records(rows, "dedupe").count() == 2
    assert records.collect_records(rows, "keep").count() == 3
    with pytest.raises(ValueError):
        records.collect_records(rows, "fail")
    with pytest.raises(ValueError):
        records.collect_records(rows.union(rows), "keep")


def test_manifest_finds_changes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    manifest = spark.createDataFrame(records.manifest(spark, str(tmp_path)).collect(), "path string, sha256 string, size long")
    assert records.verify_manifest(spark, str(tmp_path), manifest).count() == 0
    (tmp_path / "b.txt").write_text("three")
    (tmp_path / "c.txt").write_text("new")
    assert sorted(r.problem for r in records.verify_manifest(spark, str(tmp_path), manifest).collect()) == ["changed", "extra"]


def test_stream_appends_once(spark, tmp_path):
    schema = "ordinal long, step int, witness int"
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1)], schema)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows.write.parquet(source)
    resumable.stream_steps(spark, source, schema, log, str(tmp_path / "cp")).awaitTermination()
    rows.write.mode("append").parquet(source)  # the same steps come again
    resumable.stream_steps(spark, source, schema, log, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(log).count() == 3


def test_long_sequences_are_scanned_in_pieces(spark):
    """Sites on and across the edges of pieces, against a plain search."""
    import random

    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    for at in (0, 60, 62, 64, 4090, 4094, 4096, 8191, 8995):
        seq = seq[:at] + "GAGTC" + seq[at + 5 :]
    df = spark.createDataFrame([("s", seq), ("short", "GAGT"), ("empty", "")], "id string, seq string")
    got = {(r.orientation, r.start) for r in scan.scan_nicks(df, ["id"], "seq", [("a", "GAGTC", "top", 1)]).collect()}
    find = lambda word: {i for i in range(len(seq)) if seq.startswith(word, i)}
    assert got == {("forward", i) for i in find("GAGTC")} | {("reverse", i) for i in find("GACTC")}
    words = {r.word for r in scan.distinct_words(df, "seq", 8).collect()}
    assert words == {seq[i : i + 8] for i in range(len(seq) - 7)}


def test_manifest_keeps_equal_names_apart(spark, tmp_path):
    from plectra.sources import records

    for folder, text in (("a", "one"), ("b", "two")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.txt").write_text(text)
    rows = records.manifest(spark, str(tmp_path))
    assert sorted(r.path for r in rows.collect()) == ["a/same.txt", "b/same.txt"]
    before = spark.createDataFrame(rows.collect(), rows.schema)
    (tmp_path / "b" / "same.txt").write_text("three")
    assert [(r.path, r.problem) for r in records.verify_manifest(spark, str(tmp_path), before).collect()] == [("b/same.txt", "changed")]


def test_interface_status(spark):
    lefts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (3, "c"), (4, "b")], "query int, left string")
    rights = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "x")], "query int, right string")
    pairs = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    ended = spark.createDataFrame(pairs, "left string, right string")
    excluded = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "left string, right string")
    got = {r.query: (r.targets, r.excluded, r.pending) for r in pool.interface_status(lefts, rights, ended, excluded).collect()}
    assert got == {1: (4, False, False), 2: (1, True, False), 3: (1, False, True), 4: (0, False, False)}


def test_storage(spark):
    rows = spark.createDataFrame([("é",), (None,), ("abc",)], "text string")
    assert tuple(resumable.storage(rows, "text").first()) == (3, 5)
    assert tuple(resumable.storage(rows.limit(0), "text").first()) == (0, 0)


def test_digests_go_by_order(spark):
    """The digest is of the whole ordered log, over several batches too; a sum of digests would not be."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, None if (k, i) == (2, 1) else f"{k}-{i}") for k in (1, 2, None) for i in range(20)] + [(5, 0, None)]
        df = spark.createDataFrame(rows[::-1], "k long, i int, said string")
        got = {r.k: (r.digest, r.n) for r in lineage.ordered_digest(df, "k", "i", "said", "digest", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2, None):
        text = ",".join(said for a, _, said in rows if a == k and said is not None)
        assert got[k] == (hashlib.sha256(text.encode()).hexdigest(), 20)
    assert got[5] == (None, 1) and len(got) == 4


def test_intervals_merge_across_blocks(spark, monkeypatch):
    """Blocks of low ends are merged first, over more tasks where there are more rows; the union is the same."""
    monkeypatch.setattr(domains, "BLOCK", 8)
    monkeypatch.setattr(domains, "PER_TASK", 20)
    rows = [(k, i * 37 % 211 * (1 + k), i * 37 % 211 * (1 + k) + i % 5) for k in range(3) for i in range(60)] + [(7, 0, 100), (7, 40, 41), (7, 101, 101), (7, 103, 104)]
    df = spark.createDataFrame(rows, "k int, lo long, hi long")
    want = []
    for k, lo, hi in sorted(rows):
        if want and want[-1][0] == k and lo <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], hi)
        else:
            want.append([k, lo, hi])
    found = domains.merged_intervals(df, "k", "lo", "hi")
    assert sorted(map(list, found.collect())) == want
