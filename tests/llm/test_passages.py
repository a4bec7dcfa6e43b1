"""Passages that sentences do not bound, against brute force over words."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import model
from turnmill.llm.sentence_spans import remove_repeated_spans


def without_passages(rows, span=3, words=50):
    """Bytes kept by the rule of sentences, and without runs of words seen before."""
    spans = model.without_spans(rows, span)
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        found = list(re.finditer(model.SPACE, b))
        own = [m.group().translate(model.LOWER) for m in found]
        gone = [False] * len(own)
        for k in range(len(own) - words + 1):
            key = tuple(own[k : k + words])
            if key in seen:
                gone[k : k + words] = [True] * words
            seen.add(key)
        out[i] = (own, gone, spans[i])
    return out


@pytest.fixture(scope="module")
def planted():
    """Ordinary rows; passages of 60 words without a stop, inside sentences; one
    sentence of 55 words that a longer text quotes."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, quoted = prose(60), prose(55)
    rows = [(10_000 + k, f"{prose(9)} {passage} {prose(7)}. {prose(5)}.") for k in range(6)]
    rows += [(10_100, quoted), (10_101, f"{prose(8)}. {prose(4)} {quoted} {prose(4)}. {prose(6)}.")]
    return passage, quoted, rows


def test_passages_inside_sentences_go(spark, planted):
    passage, quoted, rows = planted
    docs = model.frame(spark, [*model.corpus(), *rows]).repartition(5)
    got = {r.doc_id: bytes(r.text_bytes).decode() for r in remove_repeated_spans(docs, block=20_000, words=50).collect()}
    texts = dict(rows)
    assert got[10_000] == texts[10_000] and got[10_100] == quoted
    for i in (10_001, 10_002, 10_003, 10_004, 10_005):
        assert got[i] == texts[i].replace(passage + " ", "")
    assert got[10_101] == texts[10_101].replace(quoted + " ", "")


def test_runs_of_words_against_brute_force(spark, planted):
    rows = [*model.corpus(), *planted[2]]
    docs = model.frame(spark, rows).repartition(5)
    # No text has as many sentences: a text is one run, as in the model.
    got = {r.doc_id: (r.n_sentences, bytes(r.text_bytes)) for r in remove_repeated_spans(docs, span=10_000, block=20_000, words=50).collect()}
    for i, (own, gone, (n, removed, _)) in without_passages(rows, 10_000).items():
        left = [] if removed else [w for w, g in zip(own, gone) if not g]
        assert (got[i][0], [w.translate(model.LOWER) for w in re.findall(model.SPACE, got[i][1])]) == (n, left)


def test_scripts_without_spaces(spark):
    rng = random.Random(2)
    prose = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = prose(60)
    rows = [(1, f"{prose(9)}{passage}{prose(9)}。{prose(3)}。"), (2, f"{prose(5)}{passage}{prose(5)}！")]
    got = {r.doc_id: (r.n_sentences, bytes(r.text_bytes).decode()) for r in remove_repeated_spans(model.frame(spark, rows), words=50).collect()}
    assert got == {1: (2, rows[0][1]), 2: (1, rows[1][1].replace(passage, ""))}
