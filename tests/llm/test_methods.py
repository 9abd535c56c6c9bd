"""Gradients, identities, indexes and recall of the methods, and bundles of repeated rows."""

import collections
import random

import numpy as np
import pyarrow as pa

from plectra.llm import decontaminate, packing, quality, simhash, toxicity
from plectra.llm.bytetext import as_bytes


def test_op2_gradients():
    """Back-propagation against differences of the loss."""
    texts = ["you are a terrible person and so on", "a fine day by the sea", "word", "one two three four five six seven"]
    types = toxicity.Types(*as_bytes(pa.array(texts, pa.string())))
    labels = np.array([1.0, 0, 0, 1])
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, start, size = toxicity.windows_of(types.counts)
    order = np.argsort(-size, kind="stable")
    start, size, labels = start[order], size[order], labels[order]

    def loss():
        logit = net.run(types, start, size)[3]
        return float(np.sum(np.log1p(np.exp(logit)) - labels * logit))

    cache = {}
    used, x, ids, logit = net.run(types, start, size, cache)
    found = net.backward(used, x, ids, cache, toxicity.sigmoid(logit) - labels)
    rng = np.random.default_rng(4)
    for name, g in found.items():
        places = np.argwhere(np.abs(g) > 1e-6)
        for place in map(tuple, places[rng.permutation(len(places))[:6]]):
            old, step = net.p[name][place], 1e-2
            net.p[name][place] = old + step
            up = loss()
            net.p[name][place] = old - step
            down = loss()
            net.p[name][place] = old
            assert abs((up - down) / (2 * step) - g[place]) <= 1e-3 + 0.02 * abs(g[place]), (name, place)


def test_op4_identity():
    """The sum of squares gives what adding every pair of features does."""
    machine = quality.FactorisationMachine()
    rng = np.random.default_rng(2)
    machine.w[:] = rng.standard_normal(len(machine.w)) * 0.1
    machine.w0[:] = 0.3
    row = np.repeat([0, 1, 2], [5, 1, 9])
    column, value = rng.integers(0, len(machine.w), 15), rng.standard_normal(15)
    logit, _ = machine.parts(row, column, value, 3)
    for r in range(3):
        c, x = column[row == r], value[row == r]
        pairs = sum(machine.v[c[i]] @ machine.v[c[j]] * x[i] * x[j] for i in range(len(c)) for j in range(i))
        assert abs(logit[r] - (0.3 + (machine.w[c] * x).sum() + pairs)) < 1e-4


def near(words, rng, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_op3_recall(spark):
    """Near copies by true similarity of five-word shingles are found within the radius."""
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [words, near(words, rng, 2), near(words, rng, 4)]
    rows = simhash.fingerprint(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), ["doc_id"], "text")
    prints = {r.doc_id: (r.f1, r.f2) for r in rows.collect()}
    met = {(r.f1, r.f2, r.near1, r.near2): r.distance for r in simhash.near_fingerprints(rows, rows).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) >= 120
    assert sum((*prints[a], *prints[b]) in met for a, b in pairs) >= 0.95 * len(pairs)
    bits = lambda i: (prints[i][0] % 2**64) << 64 | prints[i][1] % 2**64
    within = {(*prints[a], *prints[b]) for a in prints for b in prints if bin(bits(a) ^ bits(b)).count("1") <= simhash.RADIUS}
    assert set(met) == within


def test_op3_order(spark):
    """Null and repeated ids, one outlying id and small buckets: each row is followed by the next in order."""
    rng = random.Random(9)
    ids = [None] * 6 + [7] * 5 + [10**12] + rng.sample(range(1000), 40)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 40)))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.with_next(simhash.bucketed(docs, bucket_rows=3, bounds=4), ["id", "text"], ["text"]).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode())
    want = sorted(rows, key=key)
    pairs = collections.Counter((a, b[1]) for a, b in zip(want, want[1:] + want[:1]))
    assert collections.Counter(((r.doc_id, r.text), r.next_text) for r in got) == pairs
    one = docs.limit(1)
    assert [(r.text, r.next_text) for r in simhash.with_next(simhash.bucketed(one), ["id", "text"], ["text"]).collect()] == [(one.first().text,) * 2]


def test_op10_blocks():
    """The blocks find exactly the fingerprints within the radius, and chance pairs are few among the candidates."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    items = decontaminate.Items(list(range(30)), [" ".join(rng.choice(words, 40)) for _ in range(30)])
    prints = np.concatenate([items.prints[:10], rng.integers(0, 2, (50, 128)).astype(bool)])
    for row in prints[5:40]:
        row[rng.choice(128, 33)] ^= True
    every = np.arange(30)
    got = {tuple(x) for x in items.within(prints, every).tolist()}
    want = {(w, i) for w in range(60) for i in range(30) if (prints[w] != items.prints[i]).sum() <= decontaminate.RADIUS}
    assert got == want and len(got) >= 5
    assert {tuple(x) for x in items.within(prints, every[3:5]).tolist()} == {x for x in want if x[1] in (3, 4)}
    chance = rng.integers(0, 2, (2000, 128)).astype(bool)
    assert len(items.candidates(chance, every)[0]) < 0.01 * 2000 * 30


def test_op10_recall_of_changed_items():
    """Items with words changed, at similarities from 0.8 to 1, lie within the radius."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(5000)])
    near = asked = 0
    for size in (15, 30, 60, 100):
        for _ in range(200):
            own = rng.choice(words, size)
            other = own.copy()
            other[rng.choice(size, rng.integers(1, max(2, size // 20)), replace=False)] = rng.choice(words)
            pair = decontaminate.Items([0, 1], [" ".join(own), " ".join(other)])
            if pair.similarity(pair.shingles[0], 1) >= decontaminate.THRESHOLD:
                asked += 1
                near += len(pair.within(np.stack(pair.prints[:1]), np.array([1])))
    assert asked > 200 and near >= 0.995 * asked


def test_op9_repeated_rows(spark):
    """Rows that are all alike share no bundle beyond its size."""
    docs = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same words again' AS text")
    placed = packing.pack(docs).groupBy((packing.F.col("sequence_id") / (1 << 24)).cast("long").alias("bundle")).count().collect()
    assert sum(r["count"] for r in placed) == 100_000
    assert max(r["count"] for r in placed) <= 1.25 * packing.BUNDLE


def test_op5_spans(spark):
    """Method labels against the share of a notice's three-word runs that neighbouring diagonals hold."""
    from plectra.llm import licenses

    rng = random.Random(5)
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    split = lambda t: [w for w in __import__("re").findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())]
    texts, want = [], []
    for label, notice in licenses.NOTICES[:6]:
        words = split(notice)
        for drop in (0, len(words) // 20, len(words) // 2):
            kept = words[:]
            for at in sorted(rng.sample(range(len(kept)), drop), reverse=True):
                if drop == len(words) // 2:
                    kept[at] = "zzz"
                else:
                    del kept[at]
            grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            texts.append(" ".join([fill(20), *kept, fill(20)]))
            want.append((label, len(grams(words) & grams(kept)) / len(grams(words))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in licenses.license_spans(docs).where("accepted").collect():
        got[r.id].add(r.label)
    for i, (label, share) in enumerate(want):
        if share >= 0.85:
            assert label in got[i]
        if share < 0.3:
            assert label not in got[i]
    chain = spark.createDataFrame([(1, "cc by nc " * 5000)], "doc_id long, text string")
    row = licenses.license_spans(chain).where("base and label = 'cc-by-nc'").collect()
    assert len(row) == 1 and (row[0].exact, row[0].coverage) == (5000, 1)
