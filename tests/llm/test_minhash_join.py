"""MinHash near-duplicates against all pairs of a small corpus."""

import os
import random
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import model
from turnmill.llm.minhash_join import _profiles, _sets, matching_links, minhash_join, set_ids, signatures


def hard():
    """The common corpus, near copies about the threshold, two groups of many
    near copies that share a passage, one of them a chain."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = model.corpus()
    at = 10_000
    for n in (6, 7, 9, 14, 30, 80):
        base = [word() for _ in range(n + 4)]
        for cut in range(4):
            rows.append((at, " ".join(base[cut:])))
            rows.append((at + 1, " ".join(base[: len(base) - cut]).upper()))
            at += 2
    passage = [word() for _ in range(30)]
    for _ in range(2):
        base = [word() for _ in range(110)]
        for _ in range(40):
            copy = base[:]
            copy[rng.randrange(110)] = word()
            rows.append((at, " ".join(copy + passage)))
            at += 1
    for _ in range(30):
        base[rng.randrange(110)] = word()
        rows.append((at, " ".join(base + passage)))
        at += 1
    return rows


@pytest.fixture(scope="module")
def rows():
    return hard()


@pytest.mark.parametrize("tile", [2_000_000, 1_500, 300])
def test_components(spark, rows, tile):
    docs = model.frame(spark, rows).withColumnsRenamed({"sig": "set_id", "kind": "label", "row": "run"}).repartition(5)
    members, links = minhash_join(docs, tile=tile)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == model.components(rows, percent=85)
    classes = {r.class_id for r in members.collect()}
    for r in links.collect():
        assert r.a != r.b and {r.a, r.b} <= classes and 100 * r.overlap >= 85 * r.union_size


def test_odd_tables(spark):
    odd = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "q"), (2, "A b c d e f"), (3, None), (5, " \n")]
    frame = model.frame(spark, odd)
    got = sorted(tuple(-1 if x is None else x for x in (r.doc_id, r.n_shingles, r.class_id, r.component_id)) for r in minhash_join(frame)[0].collect())
    assert got == [(-1, 2, -1, -1), (2, 2, 2, 2), (3, 0, 3, 3), (4, 1, 4, 4), (4, 2, 2, 2), (4, 2, 2, 2), (5, 0, 5, 5)]
    for none in minhash_join(frame.limit(0)):
        assert none.count() == 0
    with pytest.raises(ValueError):
        minhash_join(frame, percent=40)


def test_a_repeated_id_stands_for_each_of_its_texts(spark):
    base = [f"w{k}" for k in range(60)]
    one, two = " ".join(base), " ".join(f"x{k}" for k in range(60))
    rows = [(1, one), (1, two), (7, one + " more"), (9, two + " more"), (8, two)]
    got = sorted((r.doc_id, r.component_id) for r in minhash_join(model.frame(spark, rows))[0].collect())
    assert got == [(1, 1), (1, 1), (7, 1), (8, 1), (9, 1)]


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    gaps = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (170, 15, 15))
        sets = [np.sort(np.concatenate((both, x))) for x in (one, two)]
        hashes, limits = np.concatenate(sets), np.array([0, 185, 370])
        a, b = signatures(hashes, limits)
        gaps.append((a == b).mean() - 0.85)
        assert len(set(set_ids(hashes, limits))) == 2
    assert abs(np.mean(gaps)) < 0.02


def test_links_of_a_tile():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.sort(np.concatenate((base[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)))) for k in range(1, 40)]
    sets += [np.sort(rng.integers(0, 1 << 63, 380).astype(np.uint64)) for _ in range(10)]
    signed = signatures(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))))
    label, side = np.arange(len(sets)), np.zeros(len(sets), int)
    found = matching_links(signed, sets, label.copy(), side, 85, 38)
    # Copies that lack k of 400 are similar to the first up to k = 32; a spanning tree of these.
    assert len(found) == 31
    assert matching_links(signed, sets, np.zeros(len(sets), int), side, 85, 38) == []


def peak(work):
    """MB of arrays that are held at once."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_profiles_of_a_large_batch_take_little_memory():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    for reader in (_profiles(5), _sets(5)):
        assert peak(lambda: [None for _ in reader(iter([batch]))]) < 50


def test_a_tile_of_many_small_sets_takes_little_memory():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 1 << 63, 6).astype(np.uint64)) for _ in range(20_000)]
    signed = signatures(np.concatenate(sets), np.arange(0, 6 * len(sets) + 1, 6))
    label = np.arange(len(sets))
    found = []
    assert peak(lambda: found.extend(matching_links(signed, sets, label, np.zeros(len(sets), int), 85, 38))) < 35
    assert found == []
