"""What the models learn from is bounded in bytes, for texts of any length."""

import pytest
from pyspark.sql import functions as F

from plectra.llm import language
from plectra.llm.folds import within_bytes


@pytest.mark.parametrize("most", [0, 5, 40, 10_000])
def test_within_bytes(spark, most):
    rows = [(i, i % 2, "é" * (i * 7 % 23)) for i in range(30)] + [(3, 1, "é" * 21), (None, 0, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    got = sorted((r.label, r.doc_id or -1, r.text) for r in within_bytes(df, "label", most).collect())
    ordered = df.withColumn("h", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text")).collect()
    want = []
    for label in (0, 1):
        total = 0
        own = [r for r in ordered if r.label == label and len(r.text.encode()) <= most]
        for r in sorted(own, key=lambda r: (r.h, -1 if r.doc_id is None else r.doc_id, r.t)):
            total += len(r.text.encode())
            if total <= most:
                want.append((label, r.doc_id or -1, r.text))
    assert got == sorted(want)


def test_long_texts_are_not_learned_from(spark):
    rows = [(i, "x" * 5000 if i % 2 else "kept text", "en") for i in range(40)]
    samples = language.learn_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), text_bytes=1000)
    assert "kept" in samples["en"] and "xxx" not in samples["en"]
