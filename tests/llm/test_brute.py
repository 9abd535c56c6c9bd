"""Operators against brute force on the smallest tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plectra.llm import bytetext, decontaminate, language, licenses, ngram_join, packing, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(sample_docs):
    return {r.doc_id: r.text or "" for r in sample_docs.collect()}


def test_op1(spark, texts):
    got = {r.doc_id: r for r in suffix_dedup.op1_suffix_dedup(spark, SF).collect()}
    raw = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(b[p : p + 400] for b in raw.values() for p in range(len(b) - 399))
    removed = 0
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), int(gone.sum()), spans)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()
        removed += int(gone.sum())
    assert removed > 0


def test_multikey_sort_finds_equal_suffixes():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(0, 2900)
    words = suffix_dedup.word_view(data).astype(np.uint64)
    for length in (16, 24, 20):
        seen = collections.Counter(data[s : s + length].tobytes() for s in starts)
        want = [seen[data[s : s + length].tobytes()] > 1 for s in starts]
        assert suffix_dedup.multikey_ties(words, starts, length).tolist() == want


def test_op1_sorts_only_what_differs(monkeypatch):
    """Suffixes that stay together are not sorted again at each level."""
    rng, handed = random.Random(4), []
    passage = rng.randbytes(3000)
    data = np.frombuffer(passage + rng.randbytes(500) + passage + rng.randbytes(500), np.uint8)
    words, starts = suffix_dedup.word_view(data).astype(np.uint64), np.arange(len(data) - 400)
    argsort, lexsort = np.argsort, np.lexsort
    monkeypatch.setattr(np, "argsort", lambda key: handed.append(len(key)) or argsort(key))
    monkeypatch.setattr(np, "lexsort", lambda keys: handed.append(len(keys[0])) or lexsort(keys))
    ties = suffix_dedup.multikey_ties(words, starts, 400)
    assert np.flatnonzero(ties).tolist() == [*range(2601), *range(3500, 6101)]
    assert sum(handed) < 2 * len(starts)



def test_op3_edits_and_votes(spark, texts):
    got = {r.doc_id: r for r in simhash.op3_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        text = texts[i]
        q = len(text) // 4
        edited = text[: len(text) - q] + texts[nxt][:q]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = int(got[i].fingerprint, 16), int(got[i].edited_fingerprint, 16)
        assert got[i].near_edited == 1 - bin(a ^ b).count("1") / 128
        assert got[i].near_next == 1 - bin(a ^ int(got[nxt].fingerprint, 16)).count("1") / 128
    edited, other = (np.mean([getattr(r, c) for r in got.values()]) for c in ("near_edited", "near_next"))
    assert edited > other + 0.15
    # The radius search counts what comparing all would.
    assert simhash.RADIUS >= 16
    prints = [int(r.fingerprint, 16) for r in got.values()]
    for r in got.values():
        want = sum(bin(int(r.fingerprint, 16) ^ p).count("1") <= simhash.RADIUS for p in prints) - 1
        assert r.n_near == (want if r.doc_id % 50 == 0 else None)


def test_op5_base_places(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in licenses.op5_license_scan(spark, SF).collect()}
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = 0
    for i, text in texts.items():
        w = word.findall(text.translate(table))
        hits = [(p, label) for label, phrase in licenses.BASE_PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        found += len(hits)
    assert found > 0


def shingle_sets(texts):
    return {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) for i, t in texts.items())}


def test_op6(spark, texts):
    got = {r.doc_id: r for r in ngram_join.op6_ngram_join(spark, SF).collect()}
    sets = shingle_sets(texts)
    links = collections.defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    assert {i: got[i].n_links for i in ids} == {i: len(links[i]) for i in ids}
    assert {i: got[i].class_id for i in ids} == root
    assert any(links.values())


def test_op6_blocks(spark, sample_docs):
    """Small blocks split every group, and change nothing."""
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ngram_join.jaccard_classes(sample_docs, block=2)) == key(ngram_join.jaccard_classes(sample_docs))


def test_band_plan():
    for t in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.band_plan(t)
        assert 1 - (1 - t**rows) ** bands >= 0.999


@pytest.mark.parametrize("cells", [0, 1 << 25])
def test_op7_parse(cells, monkeypatch):
    """Phrases against a plain longest-match parse of the whole text, by either layout of the transitions."""
    monkeypatch.setattr(language, "STRETCH", 16)
    monkeypatch.setattr(language, "LANES", 8)
    samples = {"a": "the cat sat on the mat " * 20, "b": "le chat est assis", "c": "кошка сидит на ковре", "d": "猫坐在垫子上"}
    model = language.Automata(samples, cells)
    texts = ["the chat", "zzz the cat", "x" * 300, "cat " * 200, "the cat sat on the mat " * 15, "кошка сидит, 猫坐在", ""]
    plain = {k: model.encode(v)[0] for k, v in samples.items()}
    coded = [model.encode(t)[0] for t in texts]
    got = model.phrases(coded)
    as_text = lambda symbols: "".join(map(chr, symbols))
    for k, lang in enumerate(model.languages):
        for i, symbols in enumerate(coded):
            part, sample, at, count = as_text(symbols), as_text(plain[lang]), 0, 0
            while at < len(part):
                n = 1
                while at + n < len(part) and part[at : at + n + 1] in sample:
                    n += 1
                at += n
                count += 1
            assert got[k, i] == count


def test_op7_scripts(spark):
    """Labelled languages in several scripts, more letters together than any one has."""
    rng = np.random.default_rng(8)
    ranges = {"latin": range(97, 123), "greek": range(0x3B1, 0x3CA), "han": range(0x4E00, 0x4E00 + 400), "hangul": range(0xAC00, 0xAC00 + 300)}
    words = {k: ["".join(chr(c) for c in rng.choice(list(r), 4)) for _ in range(60)] for k, r in ranges.items()}
    make = lambda k: " ".join(rng.choice(words[k], 40))
    rows = [(i, make(k), k) for i, k in enumerate(list(ranges) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn_samples(docs)).collect()}
    assert all(got[i] == k for i, _, k in rows)


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.op9_packing(spark, SF).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, text in texts.items():
        ids = [*coder.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    total = 0
    for part in windows.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        total += at
    assert total >= 0.97 * packing.WINDOW * len(windows)


def test_differencing_is_balanced():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 500)
    place = packing.difference(sizes, 60)
    sums = np.bincount(place, weights=sizes, minlength=60)
    assert sums.max() - sums.min() <= 0.01 * sums.mean()
    place, k = packing.pack_sizes(sizes, 1024)
    assert np.bincount(place, weights=sizes).max() <= 1024 and k <= -(-sizes.sum() // 1024) + 2


def test_op10(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    want = set()
    for i, text in texts.items():
        w = words(text)
        for j, item in items.items():
            v = words(item)
            theirs = collections.Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            if not theirs.keys() & set(grams):
                continue
            span = len(v) - 4
            for s in range(len(grams) - span + 1):
                own = collections.Counter(grams[s : s + span])
                if (own & theirs).total() >= 0.8 * (own | theirs).total():
                    want.add((i, j))
                    break
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontamination(spark, SF).collect()}
    assert got == want and want


def test_word_arrays_match_regex():
    texts = ["Hello, World ÉTÉ", "", None, "a-b c", "end", "start"]
    data, edges = bytetext.as_bytes(pa.array(texts))
    begin, end, counts = bytetext.words(data, edges)
    low = bytetext.fold(data)
    got = [[low[b:e].tobytes().decode() for b, e in zip(begin[x:y], end[x:y])] for x, y in zip(counts[:-1], counts[1:])]
    assert got == [["hello", "world", "été"], [], [], ["a", "b", "c"], ["end"], ["start"]]
