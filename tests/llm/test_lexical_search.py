"""Ranked search against a plain model, whatever its sketches exclude."""

import math
import os
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import model
from turnmill.llm import lexical_search
from turnmill.llm.lexical_search import MAPPINGS, cell_of, fold, rank_documents

TERM = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(rows, items, k):
    docs = [(i, model.words(t, TERM)) for i, t in rows]
    some = [w for _, w in docs if w]
    n_docs, n_words = len(some), sum(map(len, some))
    df = {}
    for w in some:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(model.words(text, TERM))
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, w in docs:
            if w:
                m = 50 + 50 * len(w) * n_docs // n_words
                score = 0
                for t in terms & set(w):
                    tf = w.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
                if score > 0:
                    scores.append((-score, i is None, i or 0))
        out[item] = [(-s, None if none else i) for s, none, i in sorted(scores)[:k]]
    return {item: best for item, best in out.items() if best}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        own = out.setdefault(r.item_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.score, r.doc_id))
    return out


@pytest.fixture(scope="module")
def rows():
    odd = [(None, "a b c éñ 7"), (None, "b"), (8, "x7 X7 x-7"), (8, "a b"), (9, "...")]
    return [*model.corpus(), *odd]


@pytest.fixture(scope="module")
def items(rows):
    words = rows[3][1].split() + rows[65][1].split()
    asked = [(i, " ".join(words[5 * i : 5 * i + 30]).upper()) for i in range(8)]
    return [*asked, (20, "A, b!"), (20, "x7"), (21, None), (22, "..."), (23, "nowhere42"), (None, "éñ a_b"), (24, rows[-17][1])]


@pytest.mark.parametrize("k,seeds,batch", [(50, None, 1 << 14), (3, 3, 1 << 14), (7, 1, 150)])
def test_ranks(spark, rows, items, k, seeds, batch, monkeypatch):
    monkeypatch.setattr(lexical_search, "_BATCH", batch)
    docs = model.frame(spark, rows).withColumnsRenamed({"row": "item", "sig": "cells", "kind": "rank"}).repartition(5)
    queries = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, term int, bound double")
    assert result(rank_documents(docs, queries, k, seeds)) == ranked(rows, items, k)


def test_candidates_that_are_not_broadcast(spark, rows, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "_SMALL", 0)
    docs, queries = model.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert result(rank_documents(docs, queries, 4)) == ranked(rows, items, 4)


def test_no_rows(spark, rows):
    docs, queries = model.frame(spark, rows[:9]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, q in ((docs.limit(0), queries), (docs, queries.limit(0)), (docs, queries.where("item_id = 1").selectExpr("item_id", "'!' as text"))):
        got = rank_documents(d, q)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
    with pytest.raises(ValueError):
        rank_documents(docs, queries, 0)


def test_sketches_bound_every_count():
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 40, 3000))
    terms, counts = rng.integers(0, 1 << 60, 3000).astype(np.uint64), rng.integers(1, 400, 3000)
    cells, limits = fold(rows, terms, counts, 41)
    assert len(limits) == 42 and len(cells) == limits[-1]
    for row, term, count in zip(rows, terms, counts):
        own = cells[limits[row] : limits[row + 1]].reshape(MAPPINGS, -1)
        least = min(own[j, cell_of(np.array([term]), j, own.shape[1])[0]] for j in range(MAPPINGS))
        assert least >= min(count, 255)


def test_most_documents_are_not_read_again(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs, queries = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "benchmark"))
    read = []
    whole = lexical_search._exact

    def counted(d, pairs, *rest):
        read.append(pairs.count())
        return whole(d, pairs, *rest)

    lexical_search._exact = counted
    try:
        rank_documents(docs, queries, 5).count()
    finally:
        lexical_search._exact = whole
    assert read[1] < 0.5 * docs.count() * queries.count()
