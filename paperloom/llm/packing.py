"""Token ids packed into fixed-length rows.

Whole texts are encoded with a public byte-level BPE vocabulary (never trained
here) and an end-of-text id is appended. A document longer than a row is split
into full rows and a rest; rests and short documents are packed by
best-fit-decreasing: longest first, each into the open row with the least room
that still holds it, found in a segment tree over remaining capacities.

Packing runs within a task over windows of ``WINDOW_TOKENS`` tokens, without a
shuffle and in bounded memory; a task that is run again yields the same rows.
Which documents share a row, and the number of shards, follow from how the input
is dealt to tasks (files, splits, cores); that every token of every document is
in exactly one place does not. ``shards`` deals documents by a hash of id and
text instead, so that rows depend on the documents alone, at the cost of a
shuffle of the texts.

Rows of the result: ``shard`` and ``row`` (the row's place), ``ids`` (``length``
little-endian ids, padded with the end-of-text id), ``cu_seqlens`` (cumulative
segment lengths from 0, so the last is what is used), ``position_resets``
(offsets at which positions start again from 0), and per segment ``doc_ids``
and ``doc_offsets`` (its first token's place in its document).

Defined cases: null and empty text is the end-of-text id alone; rows that
repeat an id, or whose id is null, are packed each; other columns are not
read. Splitting is lossless: the segments of a document, put together by
``doc_offsets``, are its ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before merges, for the vocabulary above.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
LENGTH = 2048
WINDOW_TOKENS = 4_000_000
SCHEMA = (
    "shard int, row long, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, "
    "position_resets array<int>, ids binary"
)


class Encoder:
    """Byte-level BPE of ordinary text, ended by the end-of-text id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, end: int = END_OF_TEXT):
        import tiktoken

        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(*ranks.values(), end) < 1 << 16 else "<u4")
        self._end = np.array([end], self.dtype)

    def encode(self, text: str) -> np.ndarray:
        ids = self._bpe.encode_to_numpy(text, disallowed_special=()) if text else self._end[:0]
        return np.concatenate([ids.astype(self.dtype), self._end])


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The vocabulary file as merge ranks (read by the driver, a few MB at most)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Capacities:
    """Open rows by remaining capacity; a segment tree finds the tightest fit."""

    def __init__(self, most: int):
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, taken out, and its room."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of at most ``length``, as lists of positions in ``sizes``."""
    open_rows, rows = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = open_rows.take(sizes[i])
        if fit is None:
            fit = len(rows), length
            rows.append([])
        row, room = fit
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.add(room - sizes[i], row)
    return rows


@dataclass
class Packer:
    """Packs encoded documents window by window."""

    length: int
    dtype: np.dtype
    end: int = END_OF_TEXT
    ids: list[np.ndarray] = field(default_factory=list)
    names: list[int | None] = field(default_factory=list)
    held: int = 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.names.append(name)
        self.held += len(ids)

    def rows(self) -> list[list[tuple[int, int, int]]]:
        """Rows as lists of (document, first token, tokens)."""
        full, rests = [], []
        for d, ids in enumerate(self.ids):
            cut = len(ids) // self.length * self.length
            full += [[(d, s, self.length)] for s in range(0, cut, self.length)]
            if cut < len(ids):
                rests.append((d, cut, len(ids) - cut))
        return full + [[rests[i] for i in row] for row in best_fit_decreasing([r[2] for r in rests], self.length)]

    def flush(self, shard: int, at: int) -> Iterator[pa.RecordBatch]:
        rows = self.rows()
        for first in range(0, len(rows), 1024):
            some = rows[first : first + 1024]
            matrix = np.full((len(some), self.length), self.end, self.dtype)
            cu, docs, starts = [], [], []
            for r, row in enumerate(some):
                ends = [0]
                for d, s, n in row:
                    matrix[r, ends[-1] : ends[-1] + n] = self.ids[d][s : s + n]
                    ends.append(ends[-1] + n)
                cu.append(ends)
                docs.append([self.names[d] for d, _, _ in row])
                starts.append([s for _, s, _ in row])
            width = self.length * self.dtype.itemsize
            offsets = np.arange(len(some) + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), shard, np.int32)),
                    pa.array(np.arange(at + first, at + first + len(some))),
                    pa.array(docs, pa.list_(pa.int64())),
                    pa.array(starts, ints),
                    pa.array(cu, ints),
                    pa.array([c[:-1] for c in cu], ints),
                    packed,
                ],
                ["shard", "row", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "ids"],
            )
        self.ids, self.names, self.held = [], [], 0


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """The position of every token of a row."""
    return np.concatenate([np.arange(b - a) for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)] or [np.zeros(0, int)])


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, window_tokens: int = WINDOW_TOKENS, shards: int | None = None) -> DataFrame:
    """Packed rows of all documents."""
    arrow.check_integer(docs, "doc_id")
    docs = docs.select("doc_id", "text")
    if shards:
        shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
        docs = docs.withColumn("_shard", shard).repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = Encoder(ranks.value), 0
        packer, shard = Packer(length, encoder.dtype), TaskContext.get().partitionId()
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                packer.add(names[i].as_py(), encoder.encode(texts[i].as_py() or ""))
                if packer.held >= window_tokens:
                    for out in packer.flush(shard, at):
                        at += out.num_rows
                        yield out
        yield from packer.flush(shard, at)

    return arrow.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), SCHEMA, run)
