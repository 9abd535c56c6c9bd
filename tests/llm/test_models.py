"""Held-out accuracy of the trained operators, and the whole pipeline."""

import duckdb
import pytest

from plectra.llm import language, line_dedup, quality, toxicity

SF = "/root/testdata/sf0.1"


def read(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM read_parquet('{sf}/{name}.parquet')").df()


def held_out(df, name):
    rows = df.toPandas().merge(read(name), on="doc_id")
    return rows[rows.held_out]


def ranked(rows, label):
    """Probability that a labelled row outscores an unlabelled one."""
    rank = rows.score.rank()
    pos = rows[label] == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_op4(spark):
    rows = held_out(quality.op4_quality(spark, SF), "labels")
    assert ranked(rows, "quality") > 0.99
    assert ((rows.predicted == rows.quality).mean()) > 0.98


def test_op2(spark):
    rows = held_out(toxicity.op2_toxicity(spark, SF), "labels")
    assert ranked(rows, "toxic") > 0.9


def test_op7(spark):
    rows = held_out(language.op7_language(spark, SF), "documents")
    assert (rows.lang_pred == rows.lang).mean() > 0.98


def test_op8(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = line_dedup.op8_line_dedup(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(line_dedup.OP8_SQL).project(", ".join(got.columns)).fetchall())


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
