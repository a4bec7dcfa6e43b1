"""Packing of tokenised examples into training sequences as vector bins.

A sequence is a bin with three limits at once: tokens, segments and tokens that
bear loss. The next example for a bin is the one whose demands have the largest
dot product with what the bin has left, both as shares of the limits; if none
fits, the best one is cut and its head fills the bin.

One pass over the input, no shuffle. Every task packs its own rows from a pool
of bounded size, so memory holds one Arrow batch, the pool and the ids of a
bounded slice of text, whose distinct words are encoded once each; a lost task is done anew from its own input split. Read the
documents from a table (not straight from a shuffle), so that a repeated task
sees its rows in the same order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnmill.llm.columns import byte_rows, ranges, slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long"
)
_SLICE = 1 << 24  # bytes of text that are encoded at once
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_WIDE = [int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def byte_bpe_path() -> str:
    """The public byte-level BPE vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _whole_encoder(path: str) -> tuple[Callable[[list[str]], list[list[int]]], dict[str, int] | None, np.ndarray | None]:
    """Ids of whole strings, the added tokens of the vocabulary, which are one id
    wherever they stand, and the bytes of each id; strings must not hold an added
    token. None for the tokens: the strings may hold them and must be whole texts.

    Vocabularies of the byte-level kind are read into tiktoken, which gives the
    very ids of ``tokenizers`` in a third of the time; others go through
    ``tokenizers`` itself."""
    import json
    import os

    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    added = known.get("added_tokens", ())
    plain = not any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain and (known.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not known["pre_tokenizer"].get("add_prefix_space"):
        import tiktoken

        # Byte-level vocabularies write bytes without a visible sign as 256, 257 …
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in seen)
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in known["model"]["vocab"].items() if t not in special}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = list(map(len, ranks))
        return lambda texts: [own.encode_ordinary(t) for t in texts], special, lengths
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], None, None


def _blanks(data: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 that belong to white space of any script."""
    out = _BLANK[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        ahead = np.concatenate((data, np.zeros(2, np.uint8))).astype(np.uint32)
        two = ahead[lead] == 0xC2
        code = (ahead[lead] << 16) | (ahead[lead + 1] << 8) | np.where(two, 0, ahead[lead + 2])
        wide = np.isin(code, _WIDE)
        for k, own in enumerate((lead[wide], lead[wide], lead[wide & ~two])):
            out[own + k] = True
    return out


def _pieces(data: np.ndarray, limits: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: words with the white space before them,
    where that is safe; texts that are ``whole`` are one piece.

    A byte-level BPE never joins tokens across a single space or line feed
    between two other characters.
    """
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        blank = _blanks(data)
        begins[1:-2] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~blank[:-2] & ~blank[2:]
    begins[limits[1:][limits[1:] > 0] - 1] = False
    for k in np.flatnonzero(whole):
        begins[limits[k] : limits[k + 1]] = False
    begins[limits[:-1]] = True
    return np.flatnonzero(begins[:-1])


class WordEncoder:
    """Token ids of texts, each distinct word of a call encoded once.

    ``max_words``: words that are given to the vocabulary as one string."""

    def __init__(self, path: str, max_words: int = 100_000):
        self.whole, self.added, lengths = _whole_encoder(path)
        # Of added tokens that begin alike, the longest is meant.
        longest = sorted(self.added or (), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.max_words, self.lengths = max_words, lengths

    def _text(self, text: str) -> list[int]:
        """Ids of one text, which may hold added tokens."""
        parts = self.split.split(text) if self.split else [text]
        ids = self.whole(parts[::2])
        for k, token in enumerate(parts[1::2], start=1):
            ids[2 * k - 1 : 2 * k - 1] = [[self.added[token]]]
        return list(chain.from_iterable(ids))

    def _holds_added(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), bool)
        for token in self.added:
            out |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        return out

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where those of each begin and how many they are."""
        data, limits = byte_rows(words)
        first, last = limits[:-1], limits[1:] - 1
        blank = _blanks(data)
        # What begins with a single space or line feed and ends with neither can
        # stand among others: the vocabulary sees one string, cut by its tokens' bytes.
        joined = (last > first) & ((data[first] == 32) | (data[first] == 10)) & ~blank[last] & ~self._holds_added(words)
        joined[joined] = ~blank[first[joined] + 1]
        flat, sizes = [], np.zeros(len(words), np.int64)
        some, ends = byte_rows(words.filter(pa.array(joined)))
        together = []
        for a in range(0, len(ends) - 1, self.max_words):
            own = ends[a : a + self.max_words + 1]
            got = self.whole([some[own[0] : own[-1]].tobytes().decode()])[0]
            flat.append(np.fromiter(got, np.uint32, len(got)))
            cut = np.searchsorted(np.cumsum(self.lengths[flat[-1]]), own[1:] - own[0]) + 1
            together.append(np.diff(cut, prepend=0))
        alone = [self._text(w.decode()) for w in words.filter(pa.array(~joined)).to_pylist()]
        flat.append(np.fromiter(chain.from_iterable(alone), np.uint32, sum(map(len, alone))))
        sizes[joined] = np.concatenate(together) if together else 0
        sizes[~joined] = np.fromiter(map(len, alone), np.int64, len(alone))
        order = np.concatenate((np.flatnonzero(joined), np.flatnonzero(~joined)))
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat), starts, sizes

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and n + 1 limits."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if self.added is None:
            got = self.whole(texts.to_pylist())
            ends = np.cumsum([0, *map(len, got)])
            return np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1])), ends
        data, limits = byte_rows(texts)
        starts = _pieces(data, limits, self._holds_added(texts))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(limits), np.int64)
        buffers = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        flat, begin, sizes = self._learned(words.dictionary)
        which = words.indices.to_numpy()
        sizes = sizes[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return flat[ranges(begin[which], sizes)], ends[np.searchsorted(starts, limits)]


class Pool:
    """Pieces of examples that wait for a bin: which example, where from, how long."""

    def __init__(self, limits: np.ndarray):
        self.limits = limits.astype(float)
        self.examples: list[tuple] = []  # (doc_id, ids, unscored leading tokens)
        self.rows: list[tuple[int, int, int]] = []  # example, start, length

    def demands(self) -> np.ndarray:
        out = np.ones((len(self.rows), 3))
        for k, (e, start, length) in enumerate(self.rows):
            out[k] = length, 1, self.loss(e, start, length)
        return out

    def loss(self, e: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, self.examples[e][2]))

    def head(self, e: int, start: int, left: np.ndarray) -> int:
        """Tokens from ``start`` on that still fit."""
        unscored = max(0, self.examples[e][2] - start)
        return int(min(left[0], unscored + left[2]))

    def pack(self, down_to: int) -> Iterator[list[tuple[int, int, int]]]:
        """Bins until at most ``down_to`` pieces wait. The last bins of a pool
        that is emptied are cut to powers of two, which need no padding."""
        waiting = self.rows
        need = self.demands()
        alive = np.ones(len(waiting), bool)
        count = len(waiting)
        while count > down_to:
            left, placed = self.limits.copy(), []
            while left[0] > 0 and left[1] > 0 and count:
                fits = alive & (need <= left).all(axis=1)
                if left[1] == 1:  # the last segment should close the bin
                    fits &= need[:, 0] == left[0]
                if fits.any():
                    score = (need / self.limits) @ (left / self.limits)
                    k = int(np.argmax(np.where(fits, score, -1.0)))
                    placed.append(waiting[k])
                    left -= need[k]
                    alive[k] = False
                    count -= 1
                    continue
                k = int(np.argmax(np.where(alive, need[:, 0], -1.0)))
                e, start, length = waiting[k]
                n = min(self.head(e, start, left), length)
                if n <= 0:
                    break
                placed.append((e, start, n))
                left -= (n, 1, self.loss(e, start, n))
                if n == length:
                    alive[k] = False
                    count -= 1
                else:
                    waiting[k] = (e, start + n, length - n)
                    need[k] = length - n, 1, self.loss(e, start + n, length - n)
            total = int(self.limits[0] - left[0])
            if left[0] > 0:
                room = 1 << (total.bit_length() - 1)
                for e, start, length in reversed(placed[:]):
                    if total == room:
                        break
                    placed.pop()
                    n = max(0, length - (total - room))
                    total -= length - n
                    if n:
                        placed.append((e, start, n))
                    waiting.append((e, start + n, length - n))
                    need = np.vstack((need, (length - n, 1, self.loss(e, start + n, length - n))))
                    alive = np.append(alive, True)
                    count += 1
            yield placed
        self.rows = [r for r, keep in zip(waiting, alive, strict=True) if keep]
        used = sorted({r[0] for r in self.rows})
        place = {e: k for k, e in enumerate(used)}
        self.examples = [self.examples[e] for e in used]
        self.rows = [(place[e], s, n) for e, s, n in self.rows]


def _encoded(encoder: WordEncoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text; null is empty."""
    texts = pc.fill_null(texts, "")
    for i, j in slices(byte_rows(texts)[1], _SLICE):
        ids, ends = encoder.encode(texts.slice(i, j - i))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield ids[a:b]


def _packer(shared, limits: tuple[int, int, int], end_id: int, pool_size: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value  # stays with the worker, and so does its vocabulary
        if "encoder" not in held:
            held["encoder"] = WordEncoder(held["path"])
        encoder, pool = held["encoder"], Pool(np.array(limits))
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(sequence: list[tuple[int, int, int]]) -> None:
            nonlocal number
            offset = 0
            for e, start, length in sequence:
                doc, ids, _ = pool.examples[e]
                crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                rows.append((doc, start, length, crc, len(ids), number, offset, pool.loss(e, start, length)))
                offset += length
            number += 1

        def flushed() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            docs, texts, unscored = (batch.column(k) for k in range(3))
            encoded = _encoded(encoder, texts)
            for at in range(0, len(docs), 256):
                for doc, skip in zip(docs.slice(at, 256).to_pylist(), unscored.slice(at, 256).to_pylist(), strict=True):
                    own = np.append(next(encoded), np.uint32(end_id))
                    e, start = len(pool.examples), 0
                    pool.examples.append((doc, own, max(0, skip or 0)))
                    while len(own) - start:
                        n = min(len(own) - start, pool.head(e, start, pool.limits))
                        if n == limits[0]:
                            place([(e, start, n)])
                        else:
                            pool.rows.append((e, start, n))
                        start += n
                if len(pool.rows) > pool_size:
                    for sequence in pool.pack(pool_size // 4):
                        place(sequence)
                elif len(pool.examples) > 2 * pool_size:
                    for _ in pool.pack(len(pool.rows)):
                        pass
                if len(rows) > 20_000:
                    yield flushed()
        for sequence in pool.pack(0):
            place(sequence)
        if rows:
            yield flushed()

    return pack


def pack_sequences(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_tokens: int = 1024,
    max_segments: int = 64,
    max_loss_tokens: int | None = None,
    unscored: str | None = None,
    end_id: int = 0,
    pool_size: int = 1024,
) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A document is its token ids and ``end_id``. Each id is in exactly one piece;
    documents are cut where that fills a sequence. A sequence has at most
    ``max_tokens`` tokens, ``max_segments`` pieces and ``max_loss_tokens`` tokens
    that bear loss (default: as many as tokens). ``unscored`` names a column with
    the number of leading tokens of an example that bear none (a prompt; null: 0).
    Sequences that are not full have a power of two of tokens.

    Columns: those of SCHEMA. Null or empty text: one piece, the end id. Null
    doc_id stays null; rows with the same doc_id are packed each for itself. No
    documents: no pieces. Other columns are ignored.
    """
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    if min(limits) < 1 or pool_size < 4 * max_segments:
        raise ValueError("limits must be positive and the pool hold four sequences")
    skip = F.col(unscored).cast("long") if unscored else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), skip.alias("skip"))
    shared = docs.sparkSession.sparkContext.broadcast({"path": tokenizer or byte_bpe_path()})
    return rows.mapInArrow(_packer(shared, limits, end_id, pool_size), SCHEMA)
