"""Similarity join, repeats and contamination against plain-Python models."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import hashlib

import model
from turnmill.llm.decontamination import clean_documents, contamination
from turnmill.llm.jaccard_join import similarity_join, without_near_copies
from turnmill.llm.sentence_spans import remove_repeated_spans
from turnmill.llm.suffix_dedup import remove_repeats


@pytest.fixture(scope="module")
def rows():
    return model.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return model.frame(spark, rows).repartition(5).cache()


@pytest.mark.parametrize("tile", [2_000_000, 2_000])
def test_components(docs, rows, tile):
    members, links = similarity_join(docs, tile=tile)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == model.components(rows)
    for r in links.collect():
        assert r.a < r.b and 100 * r.overlap >= 75 * r.union_size


def test_components_of_odd_tables(spark, docs):
    assert similarity_join(docs.limit(0))[0].count() == 0
    odd = model.frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "q"), (2, "A b c d e f"), (3, None)])
    got = sorted(tuple(-1 if x is None else x for x in r[:2]) + (r.component_id,) for r in similarity_join(odd)[0].collect())
    assert got == [(-1, 2, None), (2, 2, 2), (3, 0, 3), (4, 1, 4), (4, 2, 2), (4, 2, 2)]
    kept = without_near_copies(odd)
    assert kept.columns == odd.columns
    # Of one id, the text that is similar to another's goes and the other stays.
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (4, "q")]


def test_one_of_each_group_stays(docs, rows):
    kept = {r.doc_id for r in without_near_copies(docs).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in model.components(rows).items() if i == c}


def test_repeats(docs, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.text_bytes).hexdigest()) for r in remove_repeats(docs, block=20_000).collect()}
    assert got == model.without_repeats(rows)


def test_repeats_in_whole_characters(docs, rows):
    texts = {i: (t or "").encode() for i, t in rows}
    for r in remove_repeats(docs, whole_characters=True).collect():
        bytes(r.text_bytes).decode()
        assert len(r.text_bytes) == len(texts[r.doc_id]) - r.n_removed


def test_repeats_of_odd_tables(spark, docs):
    assert remove_repeats(docs.limit(0)).count() == 0
    long = "".join(chr(97 + int(c, 16)) for c in hashlib.sha512(b"x").hexdigest() + "ab")
    odd = model.frame(spark, [(None, long), (1, long), (1, long), (1, long + "!"), (2, None), (3, long)])
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_removed) for r in remove_repeats(odd).collect())
    removed = [n for i, _, n in got if i == 1]
    assert len(got) == 5 and got[0] == (-1, 130, 0) and sorted(removed) == [0, 130]
    assert got[-2:] == [(2, 0, 0), (3, 130, 130)]


def test_sentence_spans(docs, rows):
    got = {r.doc_id: (r.n_sentences, r.n_removed, bytes(r.text_bytes)) for r in remove_repeated_spans(docs, block=20_000).collect()}
    assert got == model.without_spans(rows)
    assert remove_repeated_spans(docs.limit(0)).count() == 0


ITEMS = [(1, "A b, c"), (1, "a b c"), (20, None), (3, ""), (None, "a b c"), (10, "éñ 7"), (2, "...")]


@pytest.mark.parametrize("most", [8 << 20, 600, 200])
def test_contamination(spark, docs, rows, most):
    long = model.words(rows[70][1], model.ALNUM)
    items = [*ITEMS, (200, b" ".join(long[3:40]).decode().upper()), (9, b"--".join(long[30:45]).decode())]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    more = model.frame(spark, [*rows, (99_999, "x A-b.C ÉÑ éñ 7 a b c?"), (None, "a b c")])
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in contamination(more, benchmark, max_pattern_bytes=most).collect()}
    want = model.contamination([*rows, (99_999, "x A-b.C ÉÑ éñ 7 a b c?"), (None, "a b c")], [x for x in items if None not in x])
    assert got == want and got[99_999][1] == 8
    clean = clean_documents(more, benchmark, max_pattern_bytes=most)
    assert clean.columns == more.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, (_, n, _) in want.items() if not n}


def test_spans_are_offsets_of_the_original(spark):
    text = "Zé!  One,two  three. tail"
    one = model.frame(spark, [(1, text)])
    benchmark = spark.createDataFrame([(1, "one two THREE")], "item_id long, text string")
    (row,) = contamination(one, benchmark).collect()
    assert [text.encode()[s.start : s.end] for s in row.spans] == [b"One,two  three"]
    assert contamination(one.limit(0), benchmark).count() == 0
    assert contamination(one, benchmark.limit(0)).first().n_hit == 0
