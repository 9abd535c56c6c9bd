"""Centroids, piece encoding and importance resampling against brute force, on odd rows too."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from plectra.llm import catalogue, centroids, pieces, resample

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance int"


@pytest.mark.parametrize("name", ["op11_centroids", "op13_resample"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want.project(",".join(df.columns)).fetchall(), key=key)


def plain_clusters(rows, k, rounds, dims):
    """What ``cluster`` returns, with Python integers and every distance."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for n, g in groups.items():
            centres[n] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, nearest(v)) for i, v in kept]
    each = collections.Counter()
    for _, (d, n) in found:
        each[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((-1 if i is None else i, n, d, each[n], sum(each.values()), digest[n]) for i, (d, n) in found)


def test_clusters(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-2.0, -0.5, 0.0, 0.25, 3.0]) * rng.choice([1, 1, 40]) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, [0.0] * 4), (None, [1.0] * 4)]  # repeated and null ids
    rows += [(400 + i, [1.0, -1.0, 0.5, 0.0]) for i in range(150)]  # a third of all rows is one vector
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, float("nan"), 1.0, 1.0]), (905, [float("inf")] + [0.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    for k, rounds in ((12, 5), (1, 2), (40, 0)):
        got = centroids.cluster(df, k, rounds, 4)
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_clusters(rows, k, rounds, 4)
    few = df.where("vec_id < 5")
    assert {r.distance for r in centroids.cluster(few, 40, 5, 4).collect()} == {0}
    assert centroids.cluster(df.limit(0)).collect() == []


def test_extreme_components(spark):
    """A component beyond the bound is held at it; distances and inertia stay longs."""
    rows = [(i, [s * 3e38] * 64, 0, "", 0) for i, s in enumerate((1, -1, 1, 0))]
    got = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(rows, VECTORS), 1, 1).collect()}
    assert all(0 <= r.distance <= r.cluster_inertia == r.inertia <= 2**63 - 1 for r in got.values()) and len(got) == 4


def test_annulus_holds_the_nearest_and_leaves_others_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9, 9, (60, 3)) * rng.choice([1, 10, 100], (60, 1))
    centres[30] = centres[2]  # a tie
    x = rng.integers(-9, 9, (500, 3)) * rng.choice([1, 10, 100], (500, 1))
    annuli = centroids.Annuli(centres)
    number, best = annuli.nearest(x)
    away = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == away.min(axis=1)).all() and (number == away.argmin(axis=1)).all()
    low, high = annuli.candidates(x)
    assert (high - low).mean() < 24
    # Equal norms on either edge of the annulus are compared as well.
    ring = centroids.Annuli(np.array([[5, 0], [-5, 0], [0, 5], [0, -5]]))
    assert ring.nearest(np.array([[0, 0], [5, 5]]))[0].tolist() == [0, 0]


def odd_texts():
    rng = random.Random(4)
    letters = "  \n\t▁aé中🎉\x00<s>1１ﬁ"
    texts = ["", " ", "  ", "▁", "a", " a", "a ", "a  b   c    d", "▁▁x ▁", "<s> </s> <unk> <0x0A>", "x" * 3000, "中文" * 500, "​́ é", "a\r\nb\x00c"]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_chunks_give_the_library_s_ids(library, monkeypatch, size):
    """In whole texts and in parts of any size; a table that is emptied all the time gives the same."""
    monkeypatch.setattr(pieces, "PART", size)
    monkeypatch.setattr(pieces, "parts_of", lambda t, cut=pieces.parts_of: cut(t, size))
    monkeypatch.setattr(pieces, "HELD", size)
    texts = odd_texts()
    for whole in (None, True):
        held = pieces.ChunkTable(pieces.default_model(), whole)
        assert held.whole == bool(whole)
        for text, (ids, decoded) in zip(texts, held.encode(texts)):
            want = library.encode(text, add_bos=True, add_eos=True)
            assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
            assert decoded == library.decode(want), repr(text)


def test_parts_join_again():
    text = "one  two ▁three " * 40
    for size in (1, 5, 1000):
        parts = list(pieces.parts_of(text, size))
        assert "".join(parts) == text and all(p[0] in " ▁" for p in parts[1:])


def test_op12(spark, library, sample_docs):
    texts = {r.doc_id: r.text or "" for r in sample_docs.collect()}
    got = pieces.op12_pieces(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_odd_rows_and_decode(odd_docs, no_docs, library):
    encoded = pieces.encode(odd_docs)
    rows = encoded.collect()
    assert len(rows) == 15 and all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert all((r.n_tokens, r.decoded) == (2, "") for r in rows if r.doc_id in (0, 1))
    assert len({(r.doc_id, bytes(r.ids)) for r in rows if r.doc_id == 3}) == 1
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect())
    assert back == sorted((str(r.doc_id), r.decoded) for r in rows)
    assert back == sorted((str(r.doc_id), (r.text or "")) for r in odd_docs.collect())
    assert pieces.encode(no_docs).collect() == [] and pieces.decode(encoded.limit(0)).collect() == []


def plain_draw(rows, target, percent=5, fewest=20, seed=42, buckets=10_000):
    """(doc_id, n_words, n_features, weight, score, rank) with a Counter of strings."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(table))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    made = [features(t) for _, t in rows]
    s = collections.Counter(b for _, f in made for b in f)
    t = collections.Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for (i, _), (n, f) in zip(rows, made):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= fewest), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[1], r[3]))
    for place, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


def test_draw(spark, items, odd_docs, no_docs):
    rng = random.Random(9)
    vocabulary = ["One", "two", "tHREE", "été", "中文", "x1", "end"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(45)))) for i in range(-50, 200)]
    rows += [(i, "one two three four five " * 6) for i in range(3_000_000, 3_000_150)]  # equal weights, another block of ids
    rows += [(5, "once more " * 15), (5, "once more " * 15), (None, "no id " * 20), (None, "no id " * 20), (None, None), (None, ""), (2**63 - 1, "w " * 30), (-(2**63), "w " * 30)]
    target = [r.text for r in items.collect()]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, block int")
    for percent in (5, 0, 50, 100):
        got = resample.resample(df, items, percent).collect()
        assert sorted(map(tuple, got), key=str) == plain_draw(rows, target, percent), percent
    assert sorted(r.rank for r in got if r.rank is not None) == list(range(1, sum(r.n_words >= 20 for r in got) + 1))
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, resample.resample(odd_docs, items, 60).collect()), key=str) == plain_draw(odd, target, 60)
    assert sorted(map(tuple, resample.resample(odd_docs, items.limit(0), 60).collect()), key=str) == plain_draw(odd, [], 60)
    assert resample.resample(no_docs, items).collect() == []


def test_one_score_of_many_ids(spark, monkeypatch):
    """A score that a third of all rows share is ranked in cells of bounded blocks of ids, in the order of ids."""
    monkeypatch.setattr(resample, "with_scores", lambda weighed, seed: weighed.selectExpr("*", "if(doc_id % 3 = 0, 7L, doc_id) AS score"))
    monkeypatch.setattr(resample, "BLOCK_BITS", 4)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', 20) AS text")
    got = {r.doc_id: r.rank for r in resample.resample(docs, docs, 80).collect()}
    order = sorted(got, key=lambda i: (-(7 if i % 3 == 0 else i), i))
    assert got == {i: (p + 1 if p < 240 else None) for p, i in enumerate(order)}


def test_parts_of_a_text_give_the_same_features():
    rng = random.Random(2)
    text = "".join(rng.choice("aB é1.中 ") for _ in range(500)).encode()
    whole = [h for _, found in resample.feature_hashes(text) for h in found]
    for size in (1, 3, 40):
        parts = [h for _, found in resample.feature_hashes(text, size=size) for h in found]
        assert sorted(parts) == sorted(whole) and len(whole) > 300
