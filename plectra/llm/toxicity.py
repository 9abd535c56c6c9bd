"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each step of a window is a word.  Its input is a learned vector of the hashed word beside the mean of learned
vectors of its hashed character n-grams.  Two gated recurrent layers read the window in both directions;
attention pools their states into one logit.  A document is scored by the greatest logit over all
overlapping windows (``WINDOW`` words, every ``STRIDE``).  Training sees documents only: the first passes draw up to
``DRAWN`` windows of each document at random, anew in each pass; each later pass follows the window of all that scores
highest as the pass begins.  Bounds of what is learned from: ``PER_CLASS`` documents of each label, of ``CLASS_BYTES`` together.

Defined results: a null or empty text is one window without words, scored by the bias alone; without two labels
to learn from every score is 0.5; ids may repeat or be null; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import BYTE_VALUE, PLACE_VALUE, U64, as_bytes, chunks, fold as fold_case, mix, word_hashes, words
from .folds import fold, labelled_sample, within_bytes
from .shared import table

FOLDS, HELD_OUT = 5, 0
WINDOW, STRIDE = 48, 24
WORD_BUCKETS, GRAM_BITS = 4096, 14
GRAMS = (3, 6)
DIM, HIDDEN = 8, 10
PER_CLASS = 500
CLASS_BYTES = 32 << 20
DRAWN = 6
EPOCHS = 20
EARLY = 10
LANES = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of each window; a text without words has one empty window."""
    sizes = np.diff(counts)
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = inner * STRIDE
    return text, counts[text] + start, np.minimum(WINDOW, sizes[text] - start)


class Types:
    """Distinct words of some texts: hash bucket and n-gram buckets of each, and each word's type."""

    def __init__(self, data: np.ndarray, edges: np.ndarray):
        begin, end, self.counts = words(data, edges)
        low = fold_case(data)
        hashes = word_hashes(low, begin, end)
        values, first, self.of_word = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (values >> U64(52)).astype(np.int64)
        # Each word with a blank at both ends.
        size = end[first] - begin[first] + 2
        edge = np.cumsum(size) - size
        total = int(size.sum())
        inner = np.arange(total) - np.repeat(edge, size)
        flat = np.r_[low, np.zeros(1, np.uint8)]
        at = inner - 1 + np.repeat(begin[first], size)
        padded = np.where((inner == 0) | (inner == np.repeat(size, size) - 1), 32, flat[at])
        self.grams, self.n_grams = {}, {}
        for k in GRAMS:
            # A word shorter than a gram is one gram, filled with zeros.
            n = np.maximum(1, size - k + 1)
            place = ragged(edge, n)
            left = np.repeat(edge + size, n) - place
            code = np.full(len(place), k, U64)
            for j in range(k):
                value = BYTE_VALUE[padded[np.minimum(place + j, max(0, total - 1))]] if total else BYTE_VALUE[:0]
                code += np.where(left > j, value, U64(0)) * PLACE_VALUE[j]
            self.grams[k] = (mix(code) >> U64(64 - GRAM_BITS)).astype(np.int64)
            self.n_grams[k] = n

    def only(self, used: np.ndarray) -> "Types":
        """The same for some types, without the texts."""
        part = object.__new__(Types)
        part.bucket = self.bucket[used]
        part.grams, part.n_grams = {}, {}
        for k in GRAMS:
            n = self.n_grams[k]
            part.n_grams[k] = n[used]
            part.grams[k] = self.grams[k][ragged((np.cumsum(n) - n)[used], n[used])]
        return part


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``n`` places each."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h, d = HIDDEN, 2 * DIM
        self.p = {"word": make(WORD_BUCKETS, DIM, scale=0.1), "gram": make(1 << GRAM_BITS, DIM, scale=0.1)}
        for way in "fb":
            self.p |= {f"w{way}": make(d, 3 * h, scale=0.3), f"u{way}": make(h, 3 * h, scale=0.25), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": make(2 * h, scale=0.3), "out": make(2 * h, scale=0.4), "bias": np.zeros(1, np.float32)}

    def inputs(self, types: Types) -> np.ndarray:
        n = len(types.bucket)
        mean = np.zeros((n, DIM), np.float32)
        for k in GRAMS if n else ():
            size = types.n_grams[k]
            mean += np.add.reduceat(self.p["gram"][types.grams[k]], np.cumsum(size) - size, axis=0) / size[:, None]
        return np.concatenate([self.p["word"][types.bucket], mean.astype(np.float32)], axis=1)

    def layer(self, way: str, pre: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: list | None) -> np.ndarray:
        """States by step and window.  Windows come longest first: ``live`` counts those that have a step."""
        h, u = HIDDEN, self.p[f"u{way}"]
        steps = range(len(live)) if way == "f" else range(len(live) - 1, -1, -1)
        state = np.zeros((ids.shape[0], h), np.float32)
        out = np.zeros((len(live), ids.shape[0], h), np.float32)
        for t in steps:
            n = live[t]
            old = state[:n]
            x, y = pre[ids[:n, t]], old @ u
            gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + y[:, : 2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            if keep is not None:
                keep.append((t, n, old.copy(), z, r, new, y[:, 2 * h :]))
            state[:n] = new + z * (old - new)
            out[t, :n] = state[:n]
        return out

    def forward(self, pre: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logits of windows that come longest first."""
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        if len(live) == 0:
            return np.full(len(sizes), self.p["bias"][0])
        kept = {way: [] if cache is not None else None for way in "fb"}
        both = np.concatenate([self.layer(way, pre[way], ids, live, kept[way]) for way in "fb"], axis=2)
        score = both @ self.p["att"]
        score[np.arange(len(live))[:, None] >= sizes[None, :]] = -1e9
        share = np.exp(score - score.max(axis=0))
        share[np.arange(len(live))[:, None] >= sizes[None, :]] = 0
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", share, both)
        if cache is not None:
            cache |= {"both": both, "share": share, "pooled": pooled, "kept": kept}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, types: Types, x: np.ndarray, ids: np.ndarray, cache: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        both, share, pooled = cache["both"], cache["share"], cache["pooled"]
        g = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["out"]
        d_share = np.einsum("tnh,nh->tn", both, d_pooled)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", d_score, both)
        d_both = share[:, :, None] * d_pooled[None] + d_score[:, :, None] * p["att"]
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u = p[f"u{way}"]
            d_u = np.zeros_like(u)
            d_pre = np.zeros((len(x), 3 * h), np.float32)
            d_state = np.zeros((ids.shape[0], h), np.float32)
            for t, n, old, z, r, new, y in reversed(cache["kept"][way]):
                d = d_state[:n] + d_both[t, :n, k * h : (k + 1) * h]
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (old - new) * z * (1 - z)
                d_r = d_new * y * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += old.T @ d_y
                np.add.at(d_pre, ids[:n, t], d_gate)
                d_state[:n] = d * z + d_y @ u.T
            g[f"u{way}"], g[f"w{way}"], g[f"c{way}"] = d_u, x.T @ d_pre, d_pre.sum(axis=0)
            d_x += d_pre @ p[f"w{way}"].T
        d_x[:, :DIM][~x[:, :DIM].any(axis=1)] = 0  # left out
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], types.bucket, d_x[:, :DIM])
        g["gram"] = np.zeros_like(p["gram"])
        for k in GRAMS:
            size = types.n_grams[k]
            np.add.at(g["gram"], types.grams[k], np.repeat(d_x[:, DIM:] / size[:, None], size, axis=0))
        return g

    def pre(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"w{way}"] + self.p[f"c{way}"] for way in "fb"}

    def logits(self, types: Types) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of every window."""
        text, start, size = windows_of(types.counts)
        pre = self.pre(self.inputs(types))
        order = np.argsort(-size, kind="stable")
        out = np.empty(len(size), np.float32)
        for at in range(0, len(order), LANES):
            part = order[at : at + LANES]
            out[part] = self.forward(pre, grid(types, start[part], size[part]), size[part])
        return text, out

    def run(self, types: Types, start: np.ndarray, size: np.ndarray, cache: dict | None = None, keep: np.ndarray | None = None):
        """(types used, their inputs, ids, logits) of windows that come longest first."""
        ids = grid(types, start, size)
        real = np.arange(ids.shape[1])[None, :] < size[:, None]
        used, own = np.unique(ids[real], return_inverse=True)
        small = np.zeros_like(ids)
        small[real] = own
        part = types.only(used)
        x = self.inputs(part)
        if keep is not None:  # words whose own vector is left out in this step
            x[~keep[used], :DIM] = 0
        return part, x, small, self.forward(self.pre(x), small, size, cache)

    def fit(self, types: Types, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 9) -> None:
        """Momentum steps on the logistic loss of each document's highest window; at first, of drawn windows.
        A step's size is set for each array as a whole, so that rare words move little."""
        rng = np.random.default_rng(seed)
        text, start, size = windows_of(types.counts)
        weight_of = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum()) * len(labels)
        momentum = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = dict.fromkeys(self.p, 0.0)
        step = 0
        for epoch in range(epochs):
            early = epoch < EARLY
            rank = np.lexsort((rng.random(len(text)) if early else -self.logits(types)[1], text))
            first_of = np.searchsorted(text, np.arange(len(labels) + 1))
            place = np.arange(len(text)) - first_of[text]
            picked = rank[place < (DRAWN if early else 1)]
            edges = np.searchsorted(text[picked], np.arange(len(labels) + 1))
            per_text = np.diff(edges)
            docs = rng.permutation(len(labels))
            for at in range(0, len(docs), 64):
                part = docs[at : at + 64]
                chosen = picked[np.concatenate([np.arange(edges[i], edges[i + 1]) for i in part])]
                chosen = chosen[np.argsort(-size[chosen], kind="stable")]
                if size[chosen].max(initial=0) == 0:
                    continue
                share = 1 / per_text[text[chosen]]
                cache: dict = {}
                used, x, ids, logit = self.run(types, start[chosen], size[chosen], cache, rng.random(len(types.bucket)) < 0.5)
                error = (sigmoid(logit) - labels[text[chosen]]) * weight_of[text[chosen]] * share / len(part)
                step += 1
                pace = rate * (1 - 0.8 * epoch / epochs)
                for k, g in self.backward(used, x, ids, cache, error.astype(np.float32)).items():
                    m = momentum[k]
                    m += 0.1 * (g - m)
                    touched = g[np.any(g != 0, axis=-1)] if g.ndim == 2 else g
                    square[k] = 0.98 * square[k] + 0.02 * float(np.mean(touched**2) if touched.size else 0)
                    self.p[k] -= (pace * m / (np.sqrt(square[k] / (1 - 0.98**step)) + 1e-7)).astype(np.float32)


def grid(types: Types, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word types by window and step; places past a window's end are not read."""
    at = start[:, None] + np.arange(max(1, int(size.max(initial=0))))[None, :]
    return types.of_word[np.minimum(at, len(types.of_word) - 1)] if len(types.of_word) else np.zeros_like(at)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Network | None:
    """Learns from the whole texts of up to ``per_class`` documents of each label, of ``class_bytes`` together."""
    learn = fold("doc_id", FOLDS) != HELD_OUT
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = labelled_sample(narrow, labels, "toxic", learn, per_class).select("doc_id", "text", "label")
    rows = within_bytes(sample, "label", class_bytes).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    if len({r["label"] for r in rows}) < 2:
        return None
    model = Network()
    model.fit(Types(*as_bytes(pa.array([r["text"] for r in rows], pa.string()))), np.array([r["label"] for r in rows]))
    return model


def score_toxicity(docs: DataFrame, model: Network | None) -> DataFrame:
    """(doc_id, score), one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if sent.value is not None:
                for start, stop in chunks(batch.column(1), 2 << 20):
                    text, logit = sent.value.logits(Types(*as_bytes(batch.column(1).slice(start, stop - start))))
                    best = np.full(stop - start, -np.inf)
                    np.maximum.at(best, text, logit)
                    score[start:stop] = sigmoid(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
