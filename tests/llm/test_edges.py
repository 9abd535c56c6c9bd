"""Each operator on odd rows and on an empty table."""

import pytest

from plectra.llm import decontaminate, language, licenses, line_dedup, ngram_join, packing, quality, simhash, suffix_dedup, toxicity


def results(docs, labels, items):
    yield "op1", suffix_dedup.dedup_substrings(docs)
    yield "op2", toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    yield "op3", simhash.fingerprints(docs)
    yield "op4", quality.score_quality(docs, quality.fit_quality(docs, labels))
    yield "op5", licenses.license_spans(docs)
    yield "op6", ngram_join.jaccard_classes(docs)
    yield "op7", language.identify(docs, language.learn_samples(docs))
    yield "op8", line_dedup.dedup_lines(docs)
    yield "op9", packing.pack(docs)
    yield "op10", decontaminate.find_leaks(docs, items)


def test_empty_tables(no_docs, labels, items):
    for name, df in results(no_docs, labels.limit(0), items.limit(0)):
        assert df.collect() == [], name


@pytest.fixture(scope="module")
def found(odd_docs, labels, items):
    return {name: df.collect() for name, df in results(odd_docs, labels, items)}


def test_rows_stay(found):
    for name in ("op1", "op2", "op3", "op4", "op6", "op7", "op8"):
        assert len(found[name]) == 15, name


def test_scores(found):
    for name in ("op2", "op4", "op7"):
        assert all(0 <= r.score <= 1 for r in found[name]), name


def test_repeats_lose_their_bytes(found):
    rows = [r for r in found["op1"] if r.doc_id == 3]
    assert len(rows) == 2 and all(r.n_removed == r.n_bytes and r.kept == b"" for r in rows)
    run = next(r for r in found["op1"] if r.doc_id == 10)  # a run repeats inside its own text
    assert (run.n_removed, run.n_spans) == (5000, 1)
    assert all((r.n_bytes, r.n_removed) == (0, 0) for r in found["op1"] if r.doc_id in (0, 1))


def test_equal_texts_have_equal_fingerprints(found):
    same = {(r.f1, r.f2) for r in found["op3"] if r.doc_id == 3}
    assert len(same) == 1
    assert {(r.f1, r.f2) for r in found["op3"] if r.doc_id in (0, 1, 2)} == {(0, 0)}


def test_license_places(found):
    rows = [r for r in found["op5"] if r.label == "mit" and r.base]
    assert sum(r.exact for r in rows if r.coverage == 1) >= 60 * 2


def test_near_duplicates(found):
    by = {}
    for r in found["op6"]:
        by.setdefault(r.id, []).append(r)
    assert [r.class_id for r in by[3] + by[4]] == [3, 3, 3]
    assert [r.n_links for r in by[3]] == [2, 2] and by[4][0].n_links == 2
    assert all(r.n_links == 0 for i in (0, 1, 2) for r in by[i])


def test_languages(found):
    assert all(r.lang_pred == "und" for r in found["op7"] if r.doc_id in (0, 1, 2))


def test_lines(found):
    rows = {r.doc.doc_id: r for r in found["op8"] if r.doc.doc_id in (0, 5, 6, 7)}
    assert (rows[5].n_lines, rows[5].n_dropped, rows[5].kept_text) == (1, 1, "")
    assert (rows[6].n_lines, rows[6].n_dropped) == (2, 2)
    assert (rows[7].n_lines, rows[7].n_dropped) == (2, 0)
    assert (rows[0].n_lines, rows[0].n_dropped, rows[0].kept_text) == (1, 0, "")
    assert rows[7].doc.label == "z"  # other columns pass through


def test_leaks(found):
    assert sorted((r.doc_id is None, r.item_id is None, r.item_id or 0) for r in found["op10"]) == [(False, False, 3), (False, True, 0), (True, False, 0)]


def stages(docs, labels, items):
    yield quality.keep_good(docs, labels)
    yield line_dedup.clean_lines(docs)
    yield ngram_join.one_of_each(docs)
    yield decontaminate.decontaminate(docs, items)


def test_pipeline_forms_on_odd_rows(odd_docs, no_docs, labels, items):
    """Each stage keeps the columns, clashing names too; of equal rows the n-gram join keeps one."""
    n = odd_docs.count()
    kept = [out for out in stages(odd_docs, labels, items)]
    assert all(out.columns == odd_docs.columns for out in kept)
    rows = [out.collect() for out in kept]
    assert 0 < len(rows[0]) <= n and len(rows[1]) == n
    assert sorted(r.doc_id for r in rows[2] if r.doc_id in (3, 4)) == [3]
    assert sorted(r.doc_id for r in rows[2] if r.doc_id in (0, 1, 2)) == [0, 1, 2]  # texts without words are nobody's copies
    assert {r.doc_id for r in rows[3]} == set(range(12)) - {8} - {9} | {None} and any(r.doc_id is None and r.text is None for r in rows[3])
    for out in stages(no_docs, labels.limit(0), items.limit(0)):
        assert out.columns == no_docs.columns and out.collect() == []
