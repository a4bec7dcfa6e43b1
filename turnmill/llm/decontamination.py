"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, letters and bytes beyond ASCII, A-Z lower-cased. The
automaton holds every window of consecutive words of every benchmark item; each
document is scanned once, and matches are mapped back to bytes of the original.

One pass, no shuffle. The automaton is built once per Python worker from the
broadcast windows. The benchmark's size is counted first: beyond
``max_pattern_bytes`` its items are dealt over several automata, each of that
size, and the documents pass from one to the next within a stage; results stay whole.
Each automaton is held by a Python worker of its own, so the texts are written down
after every ``CHAINED`` of them, for the memory of an executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import texts_of
from turnmill.session import checkpointed

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<long>, spans array<struct<start: long, end: long>>"
STATE = "doc_id long, text binary, item_ids array<long>, hits array<long>"
#: Automata that one task runs through at once.
CHAINED = 8
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Every byte as it counts in a word; a space between words.
TABLE = bytes(
    _UPPER.get(c, c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows_of(items: list[tuple[int, str]], size: int) -> dict[bytes, tuple[int, list[int]]]:
    """Window -> (its words, the items that have it)."""
    out: dict[bytes, tuple[int, list[int]]] = {}
    for item, text in items:
        words = words_of(text.encode())
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            own = out.setdefault(b" ".join(words[i : i + n]), (n, []))[1]
            if item not in own:
                own.append(item)
    return out


def automaton_of(items: list[tuple[int, str]], size: int):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for window, (n, own) in windows_of(items, size).items():
        automaton.add_word(f" {window.decode('latin-1')} ", (n, tuple(own)))
    automaton.make_automaton()
    return automaton


def _scanner(shared, size: int, last: bool) -> Callable:
    """Adds the hits of one group of items; the last group's scan also reports."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(span)] if last else [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["n_words", "n_hit", "item_ids", "spans"] if last else ["text", "item_ids", "hits"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # stays with the worker, and so does its automaton
        if "automaton" not in held:
            held["automaton"] = automaton_of(held["items"], size)
        automaton = held["automaton"]
        for batch in batches:
            out: list[tuple] = []
            for text, items, hits in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:4]), strict=True):
                text = text.as_py()
                words = words_of(text)
                if words and len(automaton):
                    line = f" {b' '.join(words).decode('latin-1')} "
                    found = list(automaton.iter(line))
                    if found:
                        spaces = np.frombuffer(line.encode("latin-1"), np.uint8) == 32
                        at = np.cumsum(spaces)[[e for e, _ in found]] - 1  # after the last word
                        items = sorted({*items, *(i for _, (_, own) in found for i in own)})
                        hits = [*hits, *(int(x) for e, (_, (n, _)) in zip(at, found, strict=True) for x in (e - n, e))]
                out.append(_report(text, len(words), items, hits) if last else (text, items, hits))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names]
            )

    return scan


def _report(text: bytes, n_words: int, items: list[int], hits: list[int]) -> tuple:
    """``hits``: first word and word after the last of every occurrence."""
    if not hits:
        return n_words, 0, [], []
    depth = np.zeros(n_words + 1, np.int64)
    np.add.at(depth, hits[::2], 1)
    np.add.at(depth, hits[1::2], -1)
    hit = np.cumsum(depth)[:-1] > 0
    first, after = _runs(hit)
    begin, end = _runs(np.frombuffer(text.translate(TABLE), np.uint8) != 32)
    spans = [{"start": int(begin[a]), "end": int(end[b - 1])} for a, b in zip(first, after, strict=True)]
    return n_words, int(hit.sum()), items, spans


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin, and where they have ended."""
    sides = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(sides == 1), np.flatnonzero(sides == -1)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_pattern_bytes: int = 8 << 20) -> DataFrame:
    """What each document shares with the benchmark.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window. ``n_hit`` counts the document's words inside
    any occurrence of a window, ``item_ids`` lists the items with occurring
    windows in ascending order, ``spans`` are the hit stretches as byte offsets
    of the UTF-8 text, from the first hit word to the end of the last.

    Null or empty text: no words, no hits. Items with null id or text have no
    windows; equal item_ids are one item. Rows stay rows: null and repeated
    doc_ids are judged each for itself. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    groups = _groups(benchmark, size, max_pattern_bytes)
    none = F.array().cast("array<long>")
    rows = texts_of(docs, none.alias("item_ids"), none.alias("hits"))
    for k, own in enumerate(groups[:-1], 1):
        held = spark.sparkContext.broadcast({"items": _rows(own)})
        rows = rows.mapInArrow(_scanner(held, size, False), STATE)
        if k % CHAINED == 0:
            rows = checkpointed(rows)
    held = spark.sparkContext.broadcast({"items": _rows(groups[-1])})
    return rows.mapInArrow(_scanner(held, size, True), SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, max_pattern_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, unchanged; see
    contamination. Rows with null text stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    for k, own in enumerate(_groups(benchmark, size, max_pattern_bytes)):
        if k and k % CHAINED == 0:
            rows = checkpointed(rows)
        held = docs.sparkSession.sparkContext.broadcast({"items": _rows(own)})
        rows = rows.mapInArrow(_sieve(held, size), rows.schema)
    return rows.select("row.*")


def _sieve(shared, size: int) -> Callable:
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "automaton" not in held:
            held["automaton"] = automaton_of(held["items"], size)
        automaton = held["automaton"]
        for batch in batches:
            keep = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                line = f" {b' '.join(words).decode('latin-1')} "
                keep.append(not (words and len(automaton)) or next(automaton.iter(line), None) is None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sieve


def _groups(benchmark: DataFrame, size: int, most: int) -> list[DataFrame]:
    """The items in groups whose windows have at most about ``most`` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    weight = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + weight * size // most  # every byte of an item is in up to ``size`` windows
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text") for k in range(parts)]


def _rows(items: DataFrame) -> list[tuple]:
    return [tuple(r) for r in items.collect()]
