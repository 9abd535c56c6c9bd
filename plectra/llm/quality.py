"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's score is ``w0 + sum(w x) + (sum over factors of (sum(v x))^2 - sum((v x)^2)) / 2``: all pairs of
features interact in time linear in the features.  Words are hashed to ``BUCKETS`` features; statistics of
the bytes and lines and the stored length follow.  The model is fitted by numpy on a bounded sample of
labelled documents (``PER_CLASS`` of each label), and sent to the workers.

Defined results: a null or empty text has no words and is scored by the other features; without two labels
to learn from every score is 0.5; ids may repeat or be null; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import U64, as_bytes, chunks, fold as fold_case, word_hashes, words
from .folds import fold, labelled_sample
from .shared import table

BUCKETS = 1 << 14
STATISTICS = 14
RANK = 6
PER_CLASS = 1500
EPOCHS = 12
FOLDS, HELD_OUT = 3, 1


def statistics(data: np.ndarray, edges: np.ndarray, counts: np.ndarray, distinct: np.ndarray, word_bytes: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Shares and logs, about 0 to 1 each; all are 0 for an empty text but the constant."""

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return (total[edges[1:]] - total[edges[:-1]]) / size

    size = np.maximum(1, np.diff(edges))
    n_words = np.diff(counts)
    some = np.maximum(1, n_words)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    space = data == 32
    line = data == 10
    stop = (data == 46) | (data == 44)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    other = ~(letter | digit | space | line | stop)
    pairs = np.r_[False, other[1:] & other[:-1]]
    ends = np.r_[False, (data[1:] == 10) & (data[:-1] == 46)]
    return np.stack(
        [
            np.ones(len(size)),
            share(upper) * 2,
            share(digit) * 4,
            share(space) * 3,
            np.minimum(1, share(line) * 40),
            share(stop) * 10,
            share(letter),
            np.minimum(2, share(other) * 6),
            np.minimum(2, share(pairs) * 8),
            np.minimum(1, share(ends) * 60),
            distinct / some,
            np.minimum(2, word_bytes / some / 10),
            np.log1p(n_words) / 10,
            np.log1p(np.maximum(0, stored)) / 12,
        ],
        axis=1,
    ).astype(np.float32)


def features(texts: pa.Array, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (row, bucket, value, statistics); a document's word values have length 1 together."""
    for start, stop in chunks(texts):
        data, edges = as_bytes(texts.slice(start, stop - start))
        begin, end, counts = words(data, edges)
        n = stop - start
        bucket = (word_hashes(fold_case(data), begin, end) >> U64(64 - 14)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(counts))
        key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, bucket = key // BUCKETS, key % BUCKETS
        value = np.log1p(times).astype(np.float32)
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        value /= norm[row].astype(np.float32)
        total = np.r_[0, np.cumsum(end - begin)]
        word_bytes = total[counts[1:]] - total[counts[:-1]]
        stats = statistics(data, edges, counts, np.bincount(row, minlength=n), word_bytes, stored[start:stop])
        yield row, bucket, value, stats


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = BUCKETS + STATISTICS
        self.w0 = np.zeros(1, np.float32)
        self.w = np.zeros(size, np.float32)
        self.v = (rng.standard_normal((size, RANK)) * 0.05).astype(np.float32)

    def parts(self, row, column, value, n):
        """The logit of each row, and its sums of v x."""
        vx = self.v[column] * value[:, None]
        edges = np.searchsorted(row, np.arange(n + 1))
        total = lambda x: np.diff(np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])[edges], axis=0)
        sums, squares, linear = total(vx), total(vx**2), total(self.w[column] * value)
        return self.w0[0] + linear + (sums**2 - squares).sum(axis=1) / 2, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> None:
        """Adam on the logistic loss; classes weigh alike."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (self.w0, self.w, self.v)]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                part = order[at : at + 128]
                column = np.concatenate([rows[i][0] for i in part])
                value = np.concatenate([rows[i][1] for i in part])
                row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                logit, sums = self.parts(row, column, value, len(part))
                error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weight[part] / len(part)).astype(np.float32)
                pull = error[row] * value
                gw = np.bincount(column, weights=pull, minlength=len(self.w)).astype(np.float32)
                inner = pull[:, None] * (sums.astype(np.float32)[row] - self.v[column] * value[:, None])
                gv = np.stack([np.bincount(column, weights=inner[:, k], minlength=len(self.w)) for k in range(RANK)], axis=1).astype(np.float32)
                step += 1
                for (p, m, s), g in zip(state, (error.sum(keepdims=True), gw, gv)):
                    g = g + decay * p
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def score(self, row, bucket, value, stats) -> np.ndarray:
        n = len(stats)
        rows = np.concatenate([row, np.repeat(np.arange(n), STATISTICS)])
        columns = np.concatenate([bucket, np.tile(BUCKETS + np.arange(STATISTICS), n)])
        values = np.concatenate([value, stats.ravel()])
        order = np.argsort(rows, kind="stable")
        logit, _ = self.parts(rows[order], columns[order], values[order], n)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def with_length(docs: DataFrame) -> DataFrame:
    """(doc_id, text, stored): the stored length, or the text's own where there is none."""
    own = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    stored = F.coalesce(F.col("n_chars").cast("long"), own) if "n_chars" in docs.columns else own
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), stored.alias("stored"))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorisationMachine | None:
    learn = fold("doc_id", FOLDS) != HELD_OUT
    sample = labelled_sample(with_length(docs), labels, "quality", learn, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, values = [], []
            for row, bucket, value, stats in features(batch.column("text"), batch.column("stored").to_numpy()):
                edges = np.searchsorted(row, np.arange(len(stats) + 1))
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    columns.append(np.r_[bucket[a:b], BUCKETS + np.arange(STATISTICS)].astype(np.int32))
                    values.append(np.r_[value[a:b], stats[i]].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array(columns, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float32())),
                ],
                names=["doc_id", "label", "columns", "values"],
            )

    made = sample.mapInArrow(run, "doc_id long, label int, columns array<int>, values array<float>").toArrow()
    made = made.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    labels_ = np.asarray(made.column("label"), dtype=np.int64)
    if len(set(labels_.tolist())) < 2:
        return None
    rows = [(np.asarray(c.values), np.asarray(v.values)) for c, v in zip(made.column("columns"), made.column("values"))]
    model = FactorisationMachine()
    model.fit(rows, labels_)
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine | None) -> DataFrame:
    """(doc_id, score), one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                stored = batch.column(2).to_numpy()
                score = np.concatenate([sent.value.score(*x) for x in features(batch.column(1), stored)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return with_length(docs).mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; a row is scored where it stands."""
    model = fit_quality(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    stored = F.coalesce(F.col("n_chars").cast("long"), own) if "n_chars" in docs.columns else own

    @F.pandas_udf("double")
    def score(text: pd.Series, length: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series(np.full(len(text), 0.5))
        parts = features(pa.array(text, pa.string()), length.to_numpy(np.int64))
        return pd.Series(np.concatenate([sent.value.score(*x) for x in parts] or [np.zeros(0)]))

    return docs.where(score(F.col("text").cast("string"), stored) >= threshold)
