"""The prefix trie against a plain model that tries every prefix."""

import hashlib
import random
import zlib

import pytest

from turnmill.llm import prefix_trie as module
from turnmill.llm.prefix_trie import peel, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "k") for r in rows], SCHEMA)


def trie(rows, every=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c], key=lambda x: (*x[:2], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c % every if c >= 0 else -(-c % every))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ids if whole[c] == node)))
        parent = min(members[node[:-1]]) if node else -1
        out.append((min(ids), len(node), parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def corpus(seed=1):
    """Shared heads, copies, a deep chain that many leave late, turns of equal number."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(400, 406), -7, -100, -130]:
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "a b", None, "𝄞x", "é" * 130, "x" * 200, "y" * 511])) for k in range(rng.randint(0, 9))]
    deep = [("user", f"t{k % 7}") for k in range(70)]
    for c in range(600, 630):
        n = rng.choice([12, 40, 66, 70])
        rows += [(c, k, r, t if k != 45 or c % 3 else "other") for k, (r, t) in enumerate(deep[:n])]
    rows += [(c, None, "user", "first") for c in (3, 601)] + [(5, 1, "user", "z"), (5, 1, "user", "z"), (5, 1, "system", "q")]
    rows += [(None, 0, "user", "nobody"), (800, 0, "user", "only")]
    for c in range(900, 940):  # one group of copies
        rows += [(c, k, "user", f"same {k}") for k in range(11)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("near,subtree", [(8, 200_000), (8, 3), (2, 5), (0, 1)])
def test_nodes(spark, near, subtree, monkeypatch):
    monkeypatch.setattr(module, "NEAR_ROOT", max(near, 1))
    rows = corpus()
    assert result(prefix_trie(frame(spark, rows).repartition(5), subtree=subtree)) == trie(rows)


def test_few_and_none(spark):
    assert result(prefix_trie(frame(spark, []))) == []
    assert result(prefix_trie(frame(spark, [(None, 1, "user", "x")]))) == []
    # All own turns are among those left out, and there is no head to take.
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lost, 0, "user", "gone")]
    assert result(prefix_trie(frame(spark, rows))) == trie(rows)
    assert len(trie(rows)) == 1


def test_a_very_long_text_and_role(spark):
    rows = [(c, k, "r" * 3000, "é" * 200_000) for c in (100, 101, 102) for k in range(3)]
    assert result(prefix_trie(frame(spark, rows))) == trie(rows)


def test_peeling_without_a_cluster():
    chars = (5).to_bytes(8, "big")
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    rows = [(a + b, chars * 2, 2, 2, 4, 0, 0, 0, "x"), (a + c, chars * 2, 2, 1, 3, 0, 0, 0, "y"), (a, chars, 1, 1, 9, 0, 0, 0, "z")]
    nodes, left = peel(rows, 0)
    assert sorted(nodes) == [(a, b"", 1, 3, 4, 2, 2, 20, "z"), (b, a, 2, 4, 2, 0, 1, 5, "x"), (c, a, 2, 3, 1, 0, 1, 0, "y")]
    assert left == [(b"", b"", 0, 4, 3, 1, 2, 20, None)]
    assert peel([], 3) == ([], [])
