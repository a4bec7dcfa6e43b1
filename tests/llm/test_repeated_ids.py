"""Pipeline stages on tables in which rows share doc_ids."""

import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
import model
from turnmill.llm.tables import with_own_ids

STAGES = dict(corpus_pipeline.STAGES)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """Every other id of the corpus stands on two rows: of other texts, of equal
    ones, of a null and a text."""
    rng = random.Random(8)
    own = model.corpus()
    texts = [t for _, t in own]
    return [*own, *[(i, rng.choice([t, rng.choice(texts), None, "only here " * 12 + str(i)])) for i, t in own[::2]], (None, texts[3]), (None, texts[3])]


def own_ids(rows):
    """What each row is when all are documents of their own."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], sha(r[1])))
    return [(k, t) for k, (_, t) in enumerate(known)], [i for i, _ in known]


def test_own_ids(spark, rows):
    got = sorted((r.doc_id, r.text, r.row.doc_id, r.row.text, r.row.lang) for r in with_own_ids(model.frame(spark, rows).repartition(6)).collect())
    numbered, ids = own_ids(rows)
    assert [(n, i, sha(t)) for n, t, i, _, _ in got] == [(n, i, sha(t)) for (n, t), i in zip(numbered, ids)]
    assert all(t == u and lang == "en" for _, t, _, u, lang in got)


def test_repeats_neither_multiply_nor_lose_rows(spark, rows):
    docs = model.frame(spark, rows).repartition(6)
    result = STAGES["repeats"](spark, docs, "")
    assert result.columns == docs.columns
    numbered, ids = own_ids(rows)
    removed = model.without_repeats(numbered)
    want = sorted(ids[n] for n, _ in numbered if removed[n][1] < removed[n][0] or not removed[n][0])
    got = result.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == want
    assert sorted(r.text for r in got if r.doc_id is None) == [rows[-1][1]] * 2
    whole = {(ids[n], t) for n, t in numbered if t and not removed[n][1]}
    assert whole <= {(r.doc_id, r.text) for r in got}
    assert all(r.n_chars == len(r.text) for r in got if r.doc_id is not None)


def test_near_copies_judge_rows(spark, rows):
    docs = model.frame(spark, rows).repartition(6)
    result = STAGES["near_copies"](spark, docs, "")
    assert result.columns == docs.columns
    numbered, ids = own_ids(rows)
    found = model.components(numbered)
    want = sorted((ids[n], t or "") for n, t in numbered if found[n][1] == n)
    assert sorted((r.doc_id, r.text or "") for r in result.where("doc_id is not null").collect()) == want
    assert result.where("doc_id is null").count() == 2
