"""Rules that must not depend on what else is in the data."""

import numpy as np
import pandas as pd

from plectra.llm import licenses, ngram_join


def test_op6_links_need_a_band_in_components_and_in_buckets():
    """A pair that shares no band is no candidate, whether its classes are verified as a component or by a bucket."""
    same = np.arange(20, dtype=np.uint64)
    sets = [same, same, same]
    keys = np.array([[1, 2, 3], [1, 9, 3], [7, 2, 8]])  # the last two share nothing
    reps, copies, everyone = np.array([10, 20, 30]), np.ones(3, np.int64), np.arange(3)
    links, root = ngram_join.verify_group(reps, copies, sets, everyone, everyone, 0.8, keys, -1)
    assert links.tolist() == [2, 1, 1] and root.tolist() == [10, 10, 10]
    by_band = np.zeros(3, np.int64)
    for band in range(3):
        for key in set(keys[:, band].tolist()):
            held = np.flatnonzero(keys[:, band] == key)
            own = np.arange(len(held))
            part, _ = ngram_join.verify_group(reps[held], copies[held], [sets[i] for i in held], own, own, 0.8, keys[held], band)
            by_band[held] += part
    assert by_band.tolist() == links.tolist()


def test_op6_a_pair_links_alike_in_small_and_large_components():
    """Beside one other class or three hundred, the same pairs are linked."""
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 2**60, 40, dtype=np.uint64))
    near = np.sort(np.r_[base[:36], rng.integers(0, 2**60, 4, dtype=np.uint64)])
    others = [np.sort(rng.integers(0, 2**60, 40, dtype=np.uint64)) for _ in range(300)]
    for crowd in (0, 300):
        sets = [base, near, *others[:crowd]]
        keys = [np.array([5, 6]), np.array([5, 7]), *[np.array([100 + i, 6]) for i in range(crowd)]]
        rows = pd.DataFrame({"unit": 1, "band": -1, "rep": np.arange(len(sets)), "copies": 1, "keys": keys, "shingles": [s.tobytes() for s in sets], "blk": 0, "bi": 0, "bj": 0})
        found = ngram_join.verify_bin(rows, 0.8)
        assert dict(zip(found.rep, found.links)) == {0: 1, 1: 1}


def test_op5_notices_with_many_separators_and_short_templates(spark):
    """Words are counted as they are cut: a hyphenated notice of a hundred words is found whole; a phrase of two words never is."""
    notice = "-".join(f"clause{i}" for i in range(100))
    docs = spark.createDataFrame([(1, f"before {notice} after"), (2, notice.replace("clause50", "x")), (3, "two words")], "doc_id long, text string")
    found = {(r.id, r.label): r for r in licenses.license_spans(docs, [("short", "two words")], [("long", notice)]).collect()}
    assert set(found) == {(1, "long"), (2, "long")}
    assert (found[1, "long"].exact, found[1, "long"].coverage) == (1, 1.0)
    assert found[2, "long"].exact == 0 and found[2, "long"].coverage == 95 / 98
    assert licenses.word_count("  a-b/c.d  ") == 4
