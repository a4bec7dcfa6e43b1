"""From raw documents to packed training sequences.

Each stage takes all that the one before it kept; all but the last return the
columns of ``documents``. Between stages the rows are written down and read
again, so that a lost executor costs a read and no stage runs twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnmill.llm.decontamination import clean_documents
from turnmill.llm.jaccard_join import without_near_copies
from turnmill.llm.packing import pack_sequences
from turnmill.llm.quality import train_quality
from turnmill.llm.suffix_dedup import remove_repeats
from turnmill.llm.tables import repeats_an_id, stored, with_own_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least 0.7)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train_quality(docs, labels).kept(docs, 0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return without_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what is covered by repeated strings of 100 bytes, n_chars
    counted anew; documents of which nothing is left go. Rows that repeat a doc_id
    are documents of their own, in the order of the SHA-256 of their texts. Rows
    with null doc_id stay as they are."""
    named = docs.where("doc_id is not null")
    again = repeats_an_id(named)
    rows = with_own_ids(named) if again else named.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    left = remove_repeats(rows.select("doc_id", "text"), whole_characters=True).where("n_removed < n_bytes or n_bytes = 0")
    text = F.col("text_bytes").cast("string")
    left = left.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    changed = rows.drop("text").join(left, "doc_id").select("text", "n_chars", "row")
    changed = changed.select(*[c if c in ("text", "n_chars") else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return changed.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    pieces = pack_sequences(docs)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn from data and hash bytes; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
