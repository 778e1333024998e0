"""Encoding of whole texts with a public byte-level tokenizer, with reuse of content-defined chunks.

A rolling hash over the characters behind a word's start says where a text is cut, so that texts that share passages
share chunks, wherever these stand. A chunk is encoded once in a worker process, whatever document or task brings it
again, and kept while there is room. Where two chunks join, the words on both sides are encoded together; if that
gives other ids than the chunks have there, the join is not right by itself, and ever more around it is encoded anew
until both sides agree, so that the ids always equal those of the whole text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._arrays import code_points, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GRAM = 12

_ENCODERS: dict[str, object] = {}


def load(vocabulary: str = VOCABULARY):
    """The encoder of a rank file; once for each worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


class _Chunk:
    """A chunk's ids, its first and its last word (all of it if it is a single word)."""

    __slots__ = ("head", "ids", "tail")

    def __init__(self, text: str, encode):
        self.ids = encode(text)
        a, b = text.find(" ", 1), text.rfind(" ", 1)
        self.head, self.tail = (text[:a], text[b:]) if a > 0 else (text, text)


class ChunkEncoder:
    """Ids of texts, with a bounded store of the chunks seen; texts longer than it holds are still whole."""

    def __init__(self, vocabulary: str = VOCABULARY, mean_chunk: int = 1024, kept_chars: int = 16_000_000):
        self.encode, self.bytes_of = load(vocabulary).encode_ordinary, load(vocabulary).decode_single_token_bytes
        # of the starts of words, some seven characters apart, one in so many is a cut
        self.mask = np.uint32((1 << max(1, (mean_chunk // 7).bit_length() - 1)) - 1)
        self.store: dict[str, _Chunk] = {}
        self.joins: dict[tuple[str, str], list[int]] = {}
        self.room = self.kept_chars = kept_chars
        self.hits = self.misses = self.repaired = 0

    def chunk(self, s: str) -> _Chunk:
        got = self.store.get(s)
        if got is None:
            self.misses += 1
            got = _Chunk(s, self.encode)
            self.room -= len(s) + 64
            if self.room < 0:  # a new generation
                self.store.clear()
                self.joins.clear()
                self.room = self.kept_chars
            self.store[s] = got
        else:
            self.hits += 1
        return got

    def agree(self, left: _Chunk, right: _Chunk) -> bool:
        """Whether the words at a join, encoded together, have the ids that the chunks have there."""
        key = (left.tail, right.head)
        got = self.joins.get(key)
        if got is None:
            ids = self.encode(left.tail + right.head)
            # how many ids end where the left word ends; none do if an id reaches over the join
            n, k, end = 0, 0, len(left.tail.encode("utf-8", "surrogatepass"))
            while n < end:
                n += len(self.bytes_of(ids[k]))
                k += 1
            self.room -= len(left.tail) + len(right.head) + 32
            self.joins[key] = got = (ids[:k], ids[k:]) if n == end else None
        return got is not None and left.ids[-len(got[0]) :] == got[0] and right.ids[: len(got[1])] == got[1]

    def batch(self, texts: list[str]) -> Iterator[list[int]]:
        for a, b in slices(texts):
            yield from self._slice(texts[a:b])

    def _slice(self, texts: list[str]) -> Iterator[list[int]]:
        codes, off = code_points(texts)
        cuts = self._cuts(codes)
        first, last = np.searchsorted(cuts, off[:-1], "right"), np.searchsorted(cuts, off[1:])
        cuts = cuts.tolist()
        for t, lo, x, y in zip(texts, off.tolist(), first.tolist(), last.tolist(), strict=False):
            if x == y:
                yield self.chunk(t).ids if t else []
                continue
            ends = [c - lo for c in cuts[x:y]] + [len(t)]
            yield self._joined(t, ends)

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Places between visible characters where a space begins a word and the hash of what follows says so."""
        if len(codes) < GRAM + 3:
            return np.empty(0, np.int64)
        c = codes[: len(codes) - GRAM]
        seen = ((c > 0x20) & (c < 0x7F)) | ((c >= 0xC0) & (c < 0x250))
        at = np.flatnonzero((c[1:-1] == 0x20) & seen[:-2] & seen[2:]) + 1
        h = np.zeros(len(at), np.uint32)
        for i in range(1, GRAM + 1):
            h = h * np.uint32(0x9E3779B1) + codes[at + i]
        h ^= h >> np.uint32(15)
        return at[(h * np.uint32(0x85EBCA77) >> np.uint32(16)) & self.mask == 0]

    def _joined(self, t: str, ends: list[int]) -> list[int]:
        """Ids of the chunks of t that end at ends, repaired at their joins."""
        out: list[int] = []
        held, at = self.chunk(t[: ends[0]]), 0  # at: where the held chunk begins
        for begin, end in zip(ends, ends[1:], strict=False):
            nxt = self.chunk(t[begin:end])
            if self.agree(held, nxt):
                out += held.ids
                held, at = nxt, begin
            else:
                # encoded as one: what agrees with the next chunk then is exact again
                self.repaired += 1
                held = _Chunk(t[at:end], self.encode)
        return out + held.ids


_CHUNKS: dict[tuple[str, int], ChunkEncoder] = {}


def chunk_encoder(vocabulary: str = VOCABULARY, mean_chunk: int = 1024) -> ChunkEncoder:
    """The encoder of this worker process; its store outlives the task."""
    key = (vocabulary, mean_chunk)
    if key not in _CHUNKS:
        _CHUNKS[key] = ChunkEncoder(vocabulary, mean_chunk)
    return _CHUNKS[key]


def encode_texts(df: DataFrame, text: str, ids: str = "ids", vocabulary: str = VOCABULARY, empty_ids: tuple[int, ...] = (), null_ids: tuple[int, ...] = (), mean_chunk: int = 1024) -> DataFrame:
    """df without its text, with the list of token ids of each text (array<int>), without special tokens.

    Strings that look like special tokens are ordinary text. Empty texts get empty_ids and null texts null_ids, both
    the empty list unless told otherwise; repeated rows stay repeated; a column already called ids is replaced.
    One pass without a shuffle: each worker process keeps its own chunks, since sending every chunk to one place and
    its ids back would cost more than encoding it again.
    """
    keep = [c for c in df.columns if c not in (text, ids)]
    src = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = df.select(*[f"`{c}`" for c in keep]).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(vocabulary, mean_chunk)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                rb = whole.slice(k, 1000)
                texts = rb.column(rb.num_columns - 1).to_pylist()
                full = [t for t in texts if t]
                it = enc.batch(full)
                lens, flat = [0], []
                for t in texts:
                    flat += next(it) if t else (null_ids if t is None else empty_ids)
                    lens.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.asarray(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*rb.columns[:-1], lists], names=[*keep, ids])

    return src.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, count: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without its text, with the number of token ids (0 for null and empty texts)."""
    return encode_texts(df, text, "__ids", vocabulary).withColumn(count, F.size("__ids")).drop("__ids")


def decode_ids(df: DataFrame, ids: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without its ids, with the text that they stand for; null ids give null, bytes that are no text are replaced."""
    keep = [c for c in df.columns if c not in (ids, text)]
    src = df.select(*[f"`{c}`" for c in keep], F.col(f"`{ids}`").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(vocabulary).decode
        for rb in batches:
            texts = [None if x is None else decode(x) for x in rb.column(rb.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text])

    return src.mapInArrow(run, df.select(*[f"`{c}`" for c in keep]).schema.add(text, T.StringType()))
