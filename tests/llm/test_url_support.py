"""The bar for mined URL rules does not rise with the number of examples."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from turnmill.llm.url_rules import judge_urls, mine_rules, tokens_of

Z = 2.576


def test_small_bad_sites_among_many_examples(spark):
    urls = [(i, f"http://site{i % 300}.net/p") for i in range(12_000)] + [(20_000 + i, "http://bad-shop.net/q") for i in range(21)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 20_000)) for i, _ in urls], "doc_id long, quality int")
    judged = judge_urls(pages, labels)
    assert {(r.blocked, r.n) for r in judged.selectExpr("verdict = 'block' as blocked").groupBy("blocked").agg({"*": "count"}).toDF("blocked", "n").collect()} == {(True, 21), (False, 12_000)}


def test_exactly_the_least_number_of_examples(spark):
    for n, mined in ((20, True), (19, False)):
        rows = [("http://bad.net/", True)] * n + [(f"http://h{k % 50}.org/", False) for k in range(987)]
        assert (mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.0, 0.6).count() > 0) == mined


def test_rules_no_surer_than_chance_are_left_out(spark):
    rows = [(f"http://{'a' if k % 2 else 'b'}.net/", k % 10 < 8) for k in range(400)]
    assert mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.0, 0.6).count() == 0


def test_rules_by_enumeration(spark):
    """Every combination of tokens, counted one by one: the mined rules cover the same
    examples with the same confidence. Tokens of the same examples are one rule there."""
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        url = f"https://{rng.choice(['www.', 'm.', ''])}{rng.choice('abc')}.{rng.choice(['org', 'com'])}/{rng.choice('xyz')}/{rng.choice(['p.html', 'q'])}"
        rows.append((url, rng.random() < (0.9 if "b.org" in url or "/z/p" in url else 0.15)))
    rows += [rows[0]] * 30 + [("no scheme", True)] * 3
    df = spark.createDataFrame(rows, "url string, bad boolean")
    own = {r.url: frozenset(r.own) for r in df.select("url").distinct().select("url", tokens_of(F.col("url")).alias("own")).collect()}
    total, bad = len(rows), sum(b for _, b in rows)
    sets = {frozenset(c) for t in own.values() for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    sure = {}
    for tokens in sets:
        held = [b for u, b in rows if tokens <= own[u]]
        n, p = len(held), sum(held) / len(held)
        bound = (p + Z**2 / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n))) / (1 + Z**2 / n)
        if sum(held) >= 8 and p >= 0.6 and bound > bad / total:
            sure[tokens] = p
    want = {t: p for t, p in sure.items() if not any(sure.get(t - {x}, -1) >= p for x in t)}
    got = {frozenset(r.tokens): r for r in mine_rules(df, 0.0, 0.6, 8).collect()}

    def covered(tokens):
        return frozenset(u for u in own if tokens <= own[u])

    assert len(got) > 3 and got.keys() <= want.keys()
    assert {covered(t) for t in got} == {covered(t) for t in want}
    for tokens, r in got.items():
        assert r.confidence == pytest.approx(want[tokens]) and r.lift == pytest.approx(want[tokens] * total / bad) and r.key in tokens
        assert r.support == pytest.approx(sum(b for u, b in rows if tokens <= own[u]) / total)
