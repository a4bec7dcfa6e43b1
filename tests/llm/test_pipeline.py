"""The pipeline stage by stage against brute force, registered queries against SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as registered
import corpus_pipeline
import model
from compare import duck_result, duck_views, spark_result
from turnmill.llm.quality import train_quality
from turnmill.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_against_brute_force(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    names = [name for name, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name in names[:-1]:
        result = stages[name](spark, docs, DATA)
        assert result.columns == columns
        result.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, got = texts(docs), texts(after)
        if name == "quality":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            good = {r.doc_id for r in train_quality(docs, labels).scores(docs).where("score >= 0.7").collect()}
            want = [x for x in before if x[0] in good]
            assert 0 < len(want) < len(before)
        elif name == "near_copies":
            found = model.components(before)
            want = [x for x in before if found[x[0]][1] == x[0]]
            assert len(want) < len(before)
        elif name == "repeats":
            removed = model.without_repeats(before)
            assert {i for i, _ in got} == {i for i, (n, gone, _, _) in removed.items() if gone < n or not n}
            same = {i for i, (_, gone, _, _) in removed.items() if not gone}
            want = got
            assert [x for x in got if x[0] in same] == [x for x in before if x[0] in same]
            assert all(len(t.encode()) - 6 * r[2] <= r[0] - r[1] + 6 * r[2] for i, t in got for r in [removed[i]])
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            items = [w for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for w in [model.words(r.text, model.ALNUM)] if w]
            sought = {tuple(w[k : k + min(10, len(w))]) for w in items for k in range(len(w) - min(10, len(w)) + 1)}
            sizes = {len(w) for w in sought}
            want = []
            for i, t in before:
                w = model.words(t, model.ALNUM)
                if not any(tuple(w[k : k + n]) in sought for n in sizes for k in range(len(w) - n + 1)):
                    want.append((i, t))
        assert got == want
        docs = after
    pieces = stages["packing"](spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in texts(docs)}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_run_is_registered_and_ends_in_pieces(spark):
    assert registered.queries()["pipeline"] is corpus_pipeline.run
    assert set(QUERIES) < set(registered.queries())
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_result(QUERIES[name](spark, DATA)) == duck_result(duck_views(DATA), ORACLES[name])
