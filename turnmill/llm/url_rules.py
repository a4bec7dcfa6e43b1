"""URL filter: host and path rules first, mined association rules for the rest.

Labelled URLs become sets of tokens (host words, host endings, path words, file
ending, query keys); Spark's FP-growth finds the combinations that a fixed number of
bad examples have, alike at every size of the input, and those that imply the bad
label with enough confidence, and surely more often than chance, are kept. A rule is listed in an inverted index under its
rarest token; a URL looks its own tokens up and verifies the whole combination.

DataFrame expressions only. Distinct URLs are matched, so a URL that a third of
the rows have is one; pages themselves are only joined to the verdict. A page's
rows never meet in one group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from turnmill.llm.tables import stored

#: Rule (host, path), verdict. A rule fits its host and all subdomains.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
_Z = 2.576
RULE = "tokens array<string>, confidence double, lift double, support double, key string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        top, slash, rest = rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; none of a URL without ``://``."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(f"{kind}="), w))

    labels = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(
        F.concat(
            named("host", F.split(host, r"[^\p{L}\p{N}]+")),
            named("site", endings),
            named("path", F.split(F.lower(path), r"[^\p{L}\p{N}]+")),
            named("kind", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1))),
            named("key", F.transform(F.split(query, "&"), lambda p: F.split(p, "=")[0])),
        )
    )


def mine_rules(labelled: DataFrame, support: float, confidence: float, least: int = 20) -> DataFrame:
    """Columns tokens, confidence, lift, support and key (the rarest token) of
    the combinations that imply a bad label, from columns url and bad (boolean).

    ``support`` is a share of the examples, ``least`` a number of bad ones; both
    hold. The lower bound of a rule's confidence (Wilson, 99.5 %) must be above the
    share of bad examples, so that a rule's lift is above 1. A combination is left
    out if a part of it is a rule of no less confidence. Of tokens that the very same
    examples have, the first in order stands for all.

    FP-growth sees bad examples only, as a rule has the bad label; how often a
    combination occurs in all examples is then counted through its rarest token.
    """
    spark = labelled.sparkSession
    urls = labelled.groupBy("url").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    urls = stored(urls.select("*", tokens_of(F.col("url")).alias("own")), "labelled-urls")
    total, bad = urls.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_bad"), F.lit(0))).first()
    need = max(least, math.ceil(support * total - 1e-9))
    if bad < max(1, need):
        return spark.createDataFrame([], RULE)
    had = urls.select("url", "n", "n_bad", F.explode("own").alias("token"))
    # Tokens of the same examples have the same counts and the same hashes of their URLs.
    same = ["n_bad", "n", "low", "high"]
    tokens = had.groupBy("token").agg(
        F.sum("n_bad").alias("n_bad"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("url")).alias("low"), F.bit_xor(F.xxhash64("url", F.lit(1))).alias("high")
    )
    tokens = stored(tokens.where(F.col("n_bad") >= need).groupBy(*same).agg(F.min("token").alias("token")).select("token", "n"), "tokens")
    items = had.where("n_bad > 0").join(tokens.select("token"), "token").groupBy("url").agg(F.collect_list("token").alias("items"))
    # Every bad example is a row, one without a frequent token an empty one.
    rows = labelled.where("bad").select("url").join(items, "url", "left")
    rows = rows.select(F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    # FP-growth asks for the next whole number of examples from share * rows on.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / bad, numPartitions=parts).fit(rows)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n_bad")), "itemsets")
    rarest = sets.select("tokens", F.explode("tokens").alias("token")).join(tokens, "token")
    keys = rarest.groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    listed = stored(sets.join(keys, "tokens"), "candidates")
    met = urls.select("n", "own", F.explode("own").alias("key")).join(listed, "key")
    met = met.where(F.size(F.array_except("tokens", "own")) == 0)
    sums = met.groupBy("tokens", "n_bad", "key").agg(F.sum("n").alias("n"))
    sure, n = F.col("n_bad") / F.col("n"), F.col("n")
    spread = _Z * F.sqrt(sure * (1 - sure) / n + _Z**2 / (4 * n * n))
    bound = (sure + _Z**2 / (2 * n) - spread) / (1 + _Z**2 / n)
    rules = sums.where((sure >= confidence) & (bound > bad / total))
    # Written down, as the rules are looked at several times.
    rules = stored(rules.select("tokens", sure.alias("confidence"), (sure * total / bad).alias("lift"), (F.col("n_bad") / total).alias("support"), "key"), "mined")
    # Each rule against those of one token less, found by the rest of its tokens.
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("least"))
    parts_of = rules.where(F.size("tokens") > 1).select(
        "tokens", "confidence", F.explode(F.transform("tokens", lambda t: F.array_except(F.col("tokens"), F.array(t)))).alias("part")
    )
    beaten = parts_of.join(shorter, "part").where("least >= confidence").select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, support: float = 0.0, confidence: float = 0.6
) -> DataFrame:
    """Of every page: page_id, host, path, rule, verdict, learned_tokens and
    learned_confidence (of the surest mined rule that fits; null without one). Of
    equally sure rules the one of more support counts, then the one whose tokens come
    last in order.

    ``labels`` has doc_id (the page_id it is about) and quality, 0 for bad; null
    ids and labels are left out, repeated ones are each an example. The verdict
    is the longest fitting rule's; else block if a mined rule fits; else allow.

    Null url or one without ``://``: host and path empty, no rule, allow. Rows
    stay rows: null and repeated page_ids are judged each for itself. Without
    labels or pages nothing is mined, or nothing returned. Columns other than
    page_id and url, and doc_id and quality, are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    marked = labels.select(F.col("doc_id").cast("long").alias("page_id"), (F.col("quality") == 0).alias("bad")).dropna()
    examples = rows.where("url is not null").join(marked, "page_id").select("url", "bad")
    mined = stored(mine_rules(examples, support, confidence), "rules")
    urls = rows.where("url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("own"))
    met = urls.select("url", "own", F.explode("own").alias("key")).join(mined, "key")
    fits = met.where(F.size(F.array_except("tokens", "own")) == 0)
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", "support", "tokens")).alias("best"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(best, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "best")
    learned = F.when(F.col("best").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, learned).alias("verdict"),
        F.col("best.tokens").alias("learned_tokens"),
        F.col("best.confidence").alias("learned_confidence"),
    )
