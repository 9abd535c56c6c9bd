"""Hot leads, added tokens, repeated ids and short documents."""

import collections
import random
import zlib

import numpy as np

from plectra.llm import decontaminate, ngram_join, packing, suffix_dedup


def kept_bytes(texts, length):
    """What op1 keeps of each text, by brute force."""
    raw = [t.encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def prose(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_op1_hot_leads(spark, monkeypatch):
    """No leading gram takes more contexts to a sorting task than ``hot``, and the results are those of brute force."""
    rng = random.Random(5)
    short, long, blanks = prose(rng, 200), prose(rng, 430), " " * 300
    texts = [prose(rng, 450) + passage + prose(rng, 450) for passage in (short, long, blanks) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    largest = []
    sort = suffix_dedup.shared_windows

    def watched(suffixes, buckets, length):
        counts = collections.Counter(bytes(r.lead) for r in suffixes.select("lead").collect())
        largest.append(max(counts.values(), default=0))
        return sort(suffixes, buckets, length)

    monkeypatch.setattr(suffix_dedup, "shared_windows", watched)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(docs, hot=4).collect()}
    want = kept_bytes(texts, suffix_dedup.LENGTH)
    assert [got[i] for i in range(len(texts))] == want
    assert any(len(k) < len(t) for k, t in zip(want, texts))
    assert largest and max(largest) <= 4


def test_op9_added_tokens(spark):
    """An added token in a text has its own id, as `tokenizers` gives it with its default settings."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_vocabulary())
    token = "<|endoftext|>"
    texts = [f"a{token}b", f"one  {token}  two{token}{token}", token, f"{token}\n x", "<|endoftext|", "plain words, no token", f"<{token}|>", "été 中文 " + token]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in packing.tokenize_pieces(docs, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = [*coder.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert 50256 in np.frombuffer(got[0].ids, "<u4")


def test_rows_that_share_an_id(spark):
    """Rows with a null id or one id are told apart by their texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    a, b, c, item = (" ".join(word() for _ in range(n)) for n in (150, 200, 90, 40))
    near = lambda t: t + " tail"
    texts = [(None, a), (None, near(a)), (None, b), (8, near(b)), (None, c), (None, "short one"), (9, c + " " + word()), (9, a + " x y"), (9, item), (None, item + " " + b[:500])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    got = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in suffix_dedup.dedup_substrings(docs).collect()}
    want = kept_bytes([t for _, t in texts], suffix_dedup.LENGTH)
    assert got == {(i, len(t)): k for (i, t), k in zip(texts, want)}

    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for _, t in texts)]
    near_by = [sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1 for x in sets]
    got = sorted((r.id, r.n_shingles, r.n_links) for r in ngram_join.jaccard_classes(docs).collect())
    lowest = -(2**63)
    assert got == sorted((lowest if i is None else i, len(x), n) for (i, _), x, n in zip(texts, sets, near_by))
    kept = sorted(len(r.text) for r in ngram_join.one_of_each(docs).collect())
    groups = [{0, 1, 7}, {2, 3}, {4, 6}, {5}, {8}, {9}]
    assert len(kept) == len(groups)
    assert all(any(len(texts[k][1]) in kept for k in g) for g in groups)

    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.decontaminate(docs, items).collect()) == sorted(t for _, t in texts if item not in t)


def test_op10_short_documents(spark):
    """A document shorter than the item is compared as a whole, as brute force does."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(100)]
    docs = [item[:-1], item[1:], item[:50] + item[51:], item[:85], item[10:], item[:80], item[:60], item[:3], item, ["x"] + item[:-2]]
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "one two three")], "item_id long, text string")
    grams = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    theirs, want = grams(item), {}
    for i, d in enumerate(docs):
        own = grams(d)
        value = (own & theirs).total() / (own | theirs).total()
        if value >= 0.8:
            want[i] = (1, value, 0, len(d), 1)
    got = {r.doc_id: (r.item_id, r.similarity, r.start_word, r.n_words, r.n_windows) for r in decontaminate.find_leaks(table, items).collect()}
    assert got == want and {0, 1, 2, 3} <= set(want) and 6 not in want


def test_op6_band_units(spark, monkeypatch):
    """A component that chance band hits join is verified by band buckets, and loses no link."""
    rng = random.Random(8)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(1100)]
    texts = {i: " ".join(stream[i * 16 : i * 16 + 140]) for i in range(60)}  # neighbours are near 0.78 alike
    for i in range(0, 60, 4):
        words = texts[i].split()
        texts[100 + i] = " ".join(words[4:])
        texts[200 + i] = " ".join(words[:-3] + ["other"] * 3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    want = {i: sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in shingles.items()) for i, a in shingles.items()}
    made, real = [], ngram_join.verification_units
    monkeypatch.setattr(ngram_join, "verification_units", lambda *a: made.append(real(*a)) or made[-1])
    for block in (256, 8, 3):
        assert {r.id: r.n_links for r in ngram_join.jaccard_classes(docs, block=block).collect()} == want
    assert [u.where("band >= 0").isEmpty() for u in made] == [True, False, False]
    assert max(want.values()) > 1
