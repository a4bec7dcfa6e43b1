"""The registered queries of the operators, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.decontamination import contamination
from turnmill.llm.jaccard_join import similarity_join
from turnmill.llm.lexical_search import rank_documents
from turnmill.llm.licenses import scan_licenses
from turnmill.llm.minhash_join import minhash_join
from turnmill.llm.neighbours import nearest
from turnmill.llm.network import training_fold
from turnmill.llm.packing import pack_sequences
from turnmill.llm.prefix_trie import prefix_trie
from turnmill.llm.quality import train_quality
from turnmill.llm.sentence_spans import remove_repeated_spans
from turnmill.llm.suffix_dedup import remove_repeats
from turnmill.llm.toxicity import train_toxicity
from turnmill.llm.url_rules import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("text_bytes", 256).alias("kept_sha256"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_spans(table(spark, sf_dir, "documents"), words=50)
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2("text_bytes", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_sequences(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(
        "doc_id",
        (~training_fold(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(train_quality(docs, table(spark, sf_dir, "labels")).scores(docs), 0.7)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(train_toxicity(docs, table(spark, sf_dir, "labels")).scores(docs), 0.3)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = similarity_join(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = minhash_join(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_nearest_neighbours,
        op3_license_scans,
        op4_quality_classifier,
        op5_toxicity,
        op6_jaccard_join,
        op7_suffix_array_dedup,
        op8_benchmark_decontamination,
        op9_substring_dedup,
        op10_packing,
        op11_lexical_search,
        op12_minhash_dedup,
        op13_prefix_trie,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _windows(table_: str, key: str, size: int) -> str:
    """Windows of ``size`` words, or of all if there are fewer."""
    return f"""SELECT DISTINCT {key}, n, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT {key}, ws, least({size}, len(ws)) AS n, unnest(range(1, len(ws) - least({size}, len(ws)) + 2)) AS k
        FROM {table_} WHERE len(ws) > 0)"""


def _linked(percent: int, more: str = "") -> str:
    """Components of documents whose sets of shingles are similar."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS ({_windows("words", "doc_id", 5)}),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.win = b.win AND a.n = b.n
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * o >= {percent} * (x.n + y.n - o)),
reached(doc_id, root) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT links.a, reached.root FROM reached JOIN links ON links.b = reached.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id{more}
FROM documents d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""


#: For what SQL can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_jaccard_join": _linked(75),
    "op8_benchmark_decontamination": rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
sought AS ({_windows("items", "item_id", 10)}),
sizes AS (SELECT DISTINCT n FROM sought),
held AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM docs JOIN sizes ON len(ws) >= n)),
found AS (SELECT doc_id, item_id, n, k FROM held JOIN sought USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_lexical_search": rf"""
WITH held AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, corpus),
factors AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM sizes, corpus),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN factors USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM ranked WHERE place <= 50""",
    "op12_minhash_dedup": _linked(85, ", d.doc_id = min(root) AS kept"),
    "op13_prefix_trie": """
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id: every byte is put in, then eight steps are taken
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
      flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1),
        lambda i: list_concat([ascii((conv_id::VARCHAR)[i])::BIGINT], list_transform(range(8), lambda j: (-1)::BIGINT))))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
parts AS (SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = base WHERE t.k <= h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id WHERE t.k > h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM parts),
prefixes AS (SELECT conv_id, depth, length(text) AS chars,
    md5(string_agg(md5(role || chr(0) || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node,
    count(*) OVER (PARTITION BY conv_id) AS size FROM rebuilt),
members AS (SELECT conv_id, depth, chars, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = size AS last
  FROM prefixes UNION ALL SELECT conv_id, 0, 0, 'root', NULL, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM heads),
nodes AS (SELECT node, depth, chars, parent, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends FROM members GROUP BY ALL),
kids AS (SELECT parent AS node, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node AS node, b.node AS other FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT below.node, count(*) FILTER (WHERE kids IS NULL) AS leaves, sum((n - 1) * chars) AS saved
  FROM below JOIN nodes o ON o.node = other LEFT JOIN kids ON kids.node = other GROUP BY below.node)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN nodes p ON p.node = x.parent LEFT JOIN kids ON kids.node = x.node""",
}
