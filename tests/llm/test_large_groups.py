"""Links of one tile of the similarity join: all that connect, from few looks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from turnmill.llm import jaccard_join
from turnmill.llm.columns import byte_rows, mix
from turnmill.llm.graph import local_components


def sets_of(texts):
    return jaccard_join.shingles(*byte_rows(pa.array([t.encode() for t in texts], pa.binary())), 5)


def test_texts_of_common_lines_are_not_held_against_all(monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(8)) for _ in range(300)]
    texts = ["\n".join(rng.sample(lines, 3)) for _ in range(3000)]
    texts.append(texts[100] + " and a few more")
    searched, search = [], jaccard_join.CountTree.search
    monkeypatch.setattr(jaccard_join.CountTree, "search", lambda tree, *given: searched.append(1) or search(tree, *given))
    links = jaccard_join.spanning_links(np.arange(len(texts)), np.zeros(len(texts), int), *sets_of(texts), 75)
    assert (100, 3000) in {(a, b) for a, b, _, _ in links}
    assert len(searched) < len(texts) // 4


def near_sets(rng):
    passages = [rng.sample(range(rng.choice((30, 200, 3000))), rng.randint(1, 25)) for _ in range(rng.randint(1, 8))]
    out = []
    for _ in range(rng.choice((2, 3, 10, 40, 120))):
        one = set(rng.choice(passages)) | set(rng.choice(passages) if rng.random() < 0.4 else ())
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            one.add(rng.randrange(10**6))
            if rng.random() < 0.6:
                one.discard(rng.choice(sorted(one)))
        out.append(one)
    return out


@pytest.mark.parametrize("percent", [65, 75, 100])
@pytest.mark.parametrize("runs", [1, 2])
def test_links_of_a_tile(percent, runs):
    for seed in range(60):
        rng = random.Random(seed)
        sets = near_sets(rng)
        hashes = np.concatenate([np.sort(mix(np.array(sorted(s), np.uint64) + np.uint64(7))) for s in sets])
        limits = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        ids = np.array(rng.sample(range(1000), len(sets)))
        run = np.array([rng.randrange(runs) for _ in sets])
        want = set()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if (run.min() == run.max() or run[i] != run[j]) and 100 * len(a & b) >= percent * len(a | b):
                    want.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), len(a & b), len(a | b)))
        got = [tuple(map(int, x)) for x in jaccard_join.spanning_links(ids, run, hashes, limits, percent)]
        assert set(got) <= want
        if want:
            nodes, roots = local_components(*(np.array(x) for x in list(zip(*want, strict=True))[:2]))
            found = local_components(*(np.array(x) for x in list(zip(*got, strict=True))[:2]))
            assert np.array_equal(found[0], nodes) and np.array_equal(found[1], roots)
            assert len(got) == len(nodes) - len(set(roots.tolist()))  # no link too many
