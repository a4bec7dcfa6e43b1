"""Classifiers by held-out accuracy, neighbours by recall, packing by round trip,
URL rules and licences by cases."""

import os
import random
import sys
import textwrap
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import model
from turnmill.llm.licenses import TEMPLATES, scan_licenses
from turnmill.llm.neighbours import nearest
from turnmill.llm.packing import WordEncoder, byte_bpe_path, pack_sequences
from turnmill.llm.quality import train_quality
from turnmill.llm.toxicity import fit_nnpu, train_toxicity
from turnmill.llm.url_rules import judge_urls, mine_rules

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ODD = [(None, "a b"), (1, None), (1, ""), (2, "x" * 5000), (3, " \n"), (4, "idiot 7")]


def held_out(scores, labels, name, least):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    pairs = [(r.score >= least, truth[r.doc_id]) for r in scores.collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    return np.array(pairs, int).T


@needs_data
def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fitted = train_quality(docs, labels)
    said, true = held_out(fitted.scores(docs), labels, "quality", 0.7)
    assert (said == true).mean() > 0.95
    odd = model.frame(spark, ODD)
    scores = fitted.scores(odd).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert fitted.kept(odd, 0.0).collect() == odd.collect() and fitted.kept(odd, 1.1).count() == 0
    for none in (train_quality(docs.limit(0), labels), train_quality(docs, labels.limit(0))):
        assert {r.score for r in none.scores(odd).collect()} == {1.0}


@needs_data
def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fitted = train_toxicity(docs, labels)
    said, true = held_out(fitted.scores(docs), labels, "toxic", 0.3)
    assert (said == true).mean() > 0.85 and said[true == 1].mean() >= 0.5
    odd = model.frame(spark, ODD)
    scores = fitted.scores(odd).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert train_toxicity(docs.limit(0), labels).scores(odd).count() == len(ODD)
    assert max(r.score for r in train_toxicity(docs, labels.limit(0)).scores(odd).collect()) < 0.01


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(5)
    positive = [np.array([0, rng.integers(2, 9)]) for _ in range(60)]
    mixed = [np.array([0 if k % 10 == 0 else 1, rng.integers(2, 9)]) for k in range(400)]
    w, bias = fit_nnpu(positive, mixed, 9, 0.1)
    assert w[0] + bias > 0.5 and w[1] + bias < -1


def test_packing_is_a_partition_of_the_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    rows = [*model.corpus(), (None, "x y"), (1, "again"), (2, "hello <|endoftext|> world"), (4, "<|endoftext|><|endoftext|>\n<|endof")]
    docs = model.frame(spark, rows).repartition(3)
    ids = {}
    for i, t in rows:
        own = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(i, []).append(own)
    for limits in ((1024, 64, None), (256, 4, 200)):
        pieces = pack_sequences(docs.withColumn("prompt", docs.n), None, *limits, unscored="prompt", pool_size=256).collect()
        sequences = {}
        for p in pieces:
            assert any(len(o) == p.doc_tokens and zlib.crc32(o[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for o in ids[p.doc_id])
            sequences.setdefault(p.sequence_id, []).append(p)
        assert sum(p.length for p in pieces) == sum(len(o) for own in ids.values() for o in own)
        for own in sequences.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1])
            total = sum(p.length for p in own)
            assert total <= limits[0] and len(own) <= limits[1]
            assert sum(p.loss_tokens for p in own) <= (limits[2] or limits[0])
            assert limits[2] or total == limits[0] or total & (total - 1) == 0
    assert pack_sequences(docs.limit(0)).count() == 0


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe_path())
    rng = random.Random(1)
    bits = ["a", "don't", " ", " ", "  ", "\n", "\t", "\0", "\x1c", "\x85", "7", "é", "中文", ".", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    encoder = WordEncoder(byte_bpe_path(), max_words=50)
    for at in range(0, len(texts), 40):
        ids, ends = encoder.encode(texts[at : at + 40])
        for k, text in enumerate(texts[at : at + 40]):
            assert list(ids[ends[k] : ends[k + 1]]) == tokenizer.encode(text, add_special_tokens=False).ids


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    points = [(i, [float(x) for x in np.float32(centres[i % 12] + 0.4 * rng.normal(size=16))]) for i in range(1500)]
    points += [(5000 + i, points[3][1]) for i in range(40)]  # one vector many times
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9050, [1.0] * 3), (None, [1.0] * 16), (3, points[3][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in [*points, *odd]], "vec_id long, embedding array<float>, leaf int").repartition(4)
    found = nearest(table, table.where("vec_id % 50 = 0"), leaf=32, share=0.2).collect()
    ids, x = np.array([i for i, _ in points]), np.array([v for _, v in points])
    length = np.sqrt((x * x).sum(1))
    hit = total = 0
    for q in sorted({r.query_id for r in found}):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        k = int(np.flatnonzero(ids == q)[0])
        scores = x @ x[k] / (length * length[k])
        for r in own:
            assert abs(r.score - scores[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12
        best = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != q][:5]
        hit += len({int(ids[i]) for i in best} & {r.vec_id for r in own})
        total += 5
    assert {r.query_id for r in found} == {i for i, _ in points if i % 50 == 0} and hit / total >= 0.9
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 5000), key=lambda r: r["rank"])] == [3, 5001, 5002, 5003, 5004]
    assert nearest(table.limit(0), table).count() == 0 and nearest(table, table.limit(0)).count() == 0
    two = table.where("vec_id in (50, 51)")
    assert [(r.query_id, r.vec_id) for r in nearest(two, two.where("vec_id = 50")).collect()] == [(50, 51)]


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://x.com/fr/?a=://b": ("x.com", "/fr/", "com/fr/", "allow"),
        "https://x.com/de/#top": ("x.com", "/de/", "com/de/", "block"),
        "https://org": ("org", "", None, "allow"),
        "ftp://h#f/": ("h", "", None, "allow"),
        "http://bad-shop.net/p1": ("bad-shop.net", "/p1", None, "block"),
        "http://good-shop.net/p1": ("good-shop.net", "/p1", None, "allow"),
    }
    rows = [(i, u) for i, u in enumerate(cases)]
    taught = [(1000 + i, f"http://{'bad' if i % 2 else 'good'}-shop.net/p{i}") for i in range(80)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in [*rows, *taught, (None, None), (1, "no scheme")]], "page_id long, url string, host string, own string")
    labels = spark.createDataFrame([(i, (i + 1) % 2, 0) for i, _ in taught] + [(None, 0, 0), (1001, None, 0)], "doc_id long, quality int, toxic int")
    judged = judge_urls(pages, labels).collect()
    assert len(judged) == len(rows) + len(taught) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged if r.page_id is not None}
    assert [got[i] for i, _ in rows] == list(cases.values())
    assert all(got[i][3] == ("block" if i % 2 else "allow") for i, _ in taught)
    assert next(r.learned_tokens for r in judged if r.page_id == 11) in (["host=bad"], ["site=bad-shop.net"])
    assert judge_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in judge_urls(pages, labels.limit(0)).where("page_id >= 1000").collect()} == {"allow"}
    mined = mine_rules(spark.createDataFrame([(f"http://{h}.net/", h == "bad") for h in ("bad", "good") * 9], "url string, bad boolean"), 0.1, 0.9, 5)
    assert all(r.key in r.tokens for r in mined.collect()) and mined.count() > 0


def test_licences(spark):
    rng = random.Random(4)
    plain = [(100 + i, "\n".join(" ".join(rng.choice(["of", "the", "version", "license", "work", "this", "under", "abc", "xyz", "free"]) for _ in range(12)) for _ in range(4))) for i in range(60)]
    rows = [
        *plain,
        (1, "some words\nReleased under the MIT License.\nmore"),
        (2, "  licensed under the APACHE license, version 2.0  "),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "the license of this work is under version review"),
        (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in scan_licenses(model.frame(spark, rows)).collect()}
    assert {i: got[i].families for i in (1, 2, 3, 4, 5, None)} == {1: "mit", 2: "apache-2.0,gpl-3.0", 3: "", 4: "", 5: "", None: "cc-by-nc-4.0"}
    assert got[2].n_licensed == 2 and got[4].probability is None
    assert not any(got[i].families for i, _ in plain)
    assert scan_licenses(model.frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_licences_in_wrapped_paragraphs(spark):
    rng = random.Random(8)
    mit = "MIT License\n\nCopyright (c) 2020 A. Nother\n\n" + "\n".join(
        textwrap.wrap(" ".join(t for f, t in TEMPLATES if f == "mit" and len(t) > 100 and not t.endswith("documentation files.")), 60)
    )
    apache = "# Copyright 2019\n# Licensed under the Apache License,\n#   Version 2.0 (the \"License\"); you may not use\n# this file except in compliance with the License.\n"
    words = ["license", "licence", "warranty", "the", "of", "copyright", "software", "work", "under", "terms", "this", "permission", "public"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ". The"]) for _ in range(n))

    rows = [
        (1, mit), (2, apache), (3, "Released under the MIT License. Copyright 2020 A. Nother."),
        (4, f"{prose(4000)}\n\n{mit.upper()}\n\n{prose(4000)}"),
        (5, f"{prose(30)} Released under the MIT License. {prose(30)}. " + apache),
        (6, "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"),
        (7, "You may modify it under the terms of the GNU Lesser General Public License. This work is licensed under the GNU Lesser General Public License."),
        (8, "They said the license was granted, free of charge, to any person who asked."),
        *((100 + i, prose(200)) for i in range(80)),
    ]
    got = {r.doc_id: r for r in scan_licenses(model.frame(spark, rows)).collect()}
    found = {i: got[i].families for i in range(1, 9)}
    assert found == {1: "mit", 2: "apache-2.0", 3: "mit", 4: "mit", 5: "apache-2.0,mit", 6: "bsd-3-clause", 7: "lgpl-3.0", 8: ""}
    assert got[1].n_licensed == got[4].n_licensed >= 3
    assert not any(r.families for i, r in got.items() if i >= 100)


def test_licence_templates(spark):
    """Each is found in its own family, and with any one word of a long one left out."""
    rows = [(i, t) for i, (_, t) in enumerate(TEMPLATES)]
    cut = [(1000 + i, " ".join(w for k, w in enumerate(t.split()) if k != len(t.split()) // 2)) for i, t in rows if len(t.split()) > 12]
    got = {r.doc_id: r.families for r in scan_licenses(model.frame(spark, rows + cut)).collect()}
    assert all(got[i] == TEMPLATES[i % 1000][0] for i, _ in rows + cut)
