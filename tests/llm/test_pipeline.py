"""The whole pipeline on an empty table, on odd rows, and on rows planted for each stage."""

import pytest

import corpus_pipeline
from plectra.llm import line_dedup, packing

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture
def folder(tmp_path):
    def written(docs, labels, items):
        for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return written


def test_empty_tables(spark, folder, no_docs, labels, items):
    out = corpus_pipeline.run(spark, folder(no_docs, labels.limit(0), items.limit(0)))
    assert out.collect() == [] and out.columns == COLUMNS


def test_odd_rows(spark, folder, odd_docs, labels, items):
    """Nobody's labels: nothing is rejected for quality; rows without words and without ids come through."""
    rows = corpus_pipeline.run(spark, folder(odd_docs, labels.limit(0), items.limit(0))).collect()
    ids = {r.doc_id for r in rows}
    assert {0, 1, 2, 3, 9, 10, 11, None} <= ids and 4 not in ids  # 4 is a near copy of 3
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert by[(1, 1)] == [(0, 1)]
    for (_, tokens), spans in by.items():
        assert sum(n for _, n in spans) % tokens == 0


def test_each_stage_s_decisions_take_effect(spark, folder, items):
    """Of planted rows: a line that three documents share stays once, one near copy stays, a leak goes; the pieces are those of what is left."""
    import random

    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    line, copy, item = words(8), words(200), words(40)
    texts = {i: f"{words(60)}\n{line}\n{words(20)}" for i in range(3)} | {3: copy, 4: copy + " tail", 5: words(30) + " " + item + " " + words(30), 6: words(80)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = corpus_pipeline.run(spark, folder(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), bench)).collect()
    kept = {i: t.replace(f"\n{line}", "") if i < 2 else t for i, t in texts.items() if i not in (4, 5)}
    encode = packing.encoder(packing.default_vocabulary())
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(encode(t)) + 1 for i, t in kept.items()}


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_runs_hold_counts_and_holders(spark, fanout):
    """However the runs are compacted, a key has the number of its documents and the largest id."""
    import collections
    import random

    rng = random.Random(fanout)
    keys = [(rng.randrange(12), i) for i in range(60) for _ in range(2)]
    keys = sorted(set(keys), key=lambda k: -k[1])
    runs = line_dedup.LineRuns(fanout)
    for at in range(0, len(keys), 25):
        part = keys[at : at + 25]
        cut = [k for k in part]
        runs.add(spark.createDataFrame([(k, -k, i) for k, i in cut], "h1 long, h2 long, id long"))
    got = {r.h1: r.holder for r in runs.repeated(8).collect()}
    counts = collections.Counter(k for k, _ in keys)
    assert got == {k: max(i for x, i in keys if x == k) for k, n in counts.items() if n >= 8} and 0 < len(got)
    holders = [r.h1 for run in runs.runs() for r in run.where("holder IS NOT NULL").collect()]
    assert sorted(holders) == sorted(counts)
