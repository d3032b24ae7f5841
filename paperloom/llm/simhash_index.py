"""SimHash near-dedup with a Gray-order hierarchical index.

``fingerprints`` computes the 64-bit SimHash of every whole text. ``links``
finds near fingerprints (at most ``MAX_BITS`` differing bits) without comparing
all pairs:

* Only distinct fingerprints take part; copies of a text are one value.
* Two values within 3 bits agree in one of four 16-bit blocks, so each value is
  dealt to four buckets ``(block, bits)``. Buckets above ``BUCKET`` values are
  split into chunks by a salt and every two chunks meet in a task of their own,
  so no task is given an unbounded bucket.
* A bucket is indexed by sorting on the Gray rank (the place of the value in the
  Gray sequence, so that neighbours differ in few bits). Leaves are runs of
  sorted values; upper nodes hold the bits that all values below share, as a
  mask and a pattern. Two groups are dropped as a whole when the shared bits of
  both already differ in more than ``MAX_BITS`` places, and likewise when all
  their values are known to be linked with each other already.
* Only links that join two parts not yet joined are sent on: a spanning forest
  per bucket, which has the same connected components as all links.

Defined cases: null and blank text has fingerprint zero, linked like any other;
a text of fewer words than a shingle is one shingle; rows with the same or with
null ``doc_id`` are separate documents, and a component of null ids only has
a null ``component_id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import arrow, scratch
from paperloom.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
BUCKET = 100_000
LEAF = 32
FANOUT = 8
#: Bytes whose words are held at a time, so a very long text needs bounded memory.
STRETCH = 1 << 20
_PLACES = np.arange(8) * 256
_ONES = (np.arange(256)[:, None] >> np.arange(8)) & 1
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, stretch by stretch."""
    text, digest, at, words, some = text.lower(), xxhash.xxh64_intdigest, 0, [], False  # on bytes: A-Z only
    while at < len(text):
        end = _BLANK.search(text, at + STRETCH)
        to = end.start() if end else len(text)
        words, at = words + text[at:to].split(), to
        n = len(words) - shingle + 1
        if n > 0:
            joined, some = b" ".join(words), True
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            span = zip((ends - sizes)[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            yield np.fromiter((digest(joined[a:b], seed) for a, b in span), "<u8", n)
            words = words[n:]
    if words and not some:
        yield np.array([digest(b" ".join(words), seed)], "<u8")


def bits_of(hashes) -> int:
    """The bits that more than half of the hashes have, which come in arrays."""
    n, seen = 0, np.zeros(8 * 256, np.int64)  # how often each of the eight bytes has each value
    for h in hashes:
        n += len(h)
        seen += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).reshape(-1), minlength=8 * 256)
    ones = seen.reshape(8, 256) @ _ONES  # byte by bit
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: bits that more than half of its shingles' hashes have."""
    return bits_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fp", with_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) 64-bit column, and without the text unless ``with_text``."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        out = np.zeros(batch.num_rows, np.uint64)
        for first, after, raw, off in arrow.slices(batch.column(batch.schema.get_field_index(text))):
            for i in range(after - first):
                out[first + i] = fingerprint(raw[off[i] : off[i + 1]].tobytes())
        return [pa.array(out.view(np.int64))]

    return arrow.with_columns(docs, [T.StructField(to, T.LongType())], columns, () if with_text else (text,))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    rank = values.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class Forest:
    """Disjoint sets over positions, and the links that joined them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent


class GrayIndex:
    """Hierarchical index over distinct values in Gray order."""

    def __init__(self, values: np.ndarray, max_bits: int = MAX_BITS, leaf: int = LEAF, fanout: int = FANOUT):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        self.max_bits, self.leaf, self.fanout = max_bits, leaf, fanout
        self.forest = Forest(len(values))
        starts = np.arange(0, len(values), leaf)
        all_and, all_or = np.bitwise_and.reduceat(self.values, starts), np.bitwise_or.reduceat(self.values, starts)
        self.levels = [(~(all_and ^ all_or), all_and)]  # mask of shared bits, their pattern
        while len(self.levels[-1][0]) > 1:
            masks, patterns = self.levels[-1]
            starts = np.arange(0, len(masks), fanout)
            high, low = np.bitwise_or.reduceat(patterns | ~masks, starts), np.bitwise_and.reduceat(patterns & masks, starts)
            mask = np.bitwise_and.reduceat(masks, starts) & ~(low ^ high)
            self.levels.append((mask, low))

    def _far(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        masks, patterns = self.levels[level]
        return np.bitwise_count((patterns[a] ^ patterns[b]) & masks[a] & masks[b]) > self.max_bits

    def _joined(self) -> list[np.ndarray]:
        """Per level, the one part that all values of a node are in, or -1."""
        out, labels, size = [], self.forest.roots(), self.leaf
        for _ in self.levels:
            starts = np.arange(0, len(labels), size)
            low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
            labels = np.where(low == high, low, -1)
            out.append(labels)
            size = self.fanout
        return out

    def _compare(self, a: int, b: int) -> None:
        x, y = a * self.leaf, b * self.leaf
        own, other = self.values[x : x + self.leaf], self.values[y : y + self.leaf]
        near = np.bitwise_count(own[:, None] ^ other[None, :]) <= self.max_bits
        if a == b:
            near = np.triu(near, 1)
        for i, j in zip(*np.nonzero(near), strict=True):
            self.forest.join(x + int(i), y + int(j))

    def spanning_links(self) -> np.ndarray:
        """Pairs of near values whose components are those of all near pairs."""
        leaves = len(self.levels[0][0])
        for a in range(leaves):
            self._compare(a, a)
        for a in range(leaves - 1):
            self._compare(a, a + 1)
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        joined, known = self._joined(), len(self.forest.links)
        while todo:
            level, a, b = todo.pop()
            if len(self.forest.links) - known > 256:
                joined, known = self._joined(), len(self.forest.links)
            same = (joined[level][a] == joined[level][b]) & (joined[level][a] >= 0)
            keep = ~(self._far(level, a, b) & (a != b)) & ~same
            a, b = a[keep], b[keep]
            if level == 0:
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if j > i + 1:
                        self._compare(i, j)
                continue
            n = len(self.levels[level - 1][0])
            down = np.arange(self.fanout)
            x = (a[:, None, None] * self.fanout + down[:, None] + 0 * down).reshape(-1)
            y = (b[:, None, None] * self.fanout + down + 0 * down[:, None]).reshape(-1)
            some = (x < n) & (y < n) & (x <= y)
            x, y = x[some], y[some]
            todo += [(level - 1, x[i : i + 4096], y[i : i + 4096]) for i in range(0, len(x), 4096)]
        found = np.array(self.forest.links, np.int64).reshape(-1, 2)
        return self.values[found]


def _small_buckets(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, max_bits: int) -> np.ndarray:
    """Near pairs within buckets of one leaf at most, all buckets of a size at once."""
    out = [np.zeros((0, 2), np.uint64)]
    for m in np.unique(sizes):
        if m > 1:
            i, j = np.triu_indices(int(m), 1)
            for some in np.array_split(starts[sizes == m], max(1, (sizes == m).sum() * len(i) >> 20)):
                x, y = values[some[:, None] + i], values[some[:, None] + j]
                near = np.bitwise_count(x ^ y) <= max_bits
                out.append(np.stack([x[near], y[near]], 1))
    return np.concatenate(out)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets; rows come sorted by bucket, whole buckets are taken at a time."""

    def links(key: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        small = sizes <= LEAF
        found = [_small_buckets(values, starts[small], sizes[small], MAX_BITS)]
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
            found.append(GrayIndex(np.unique(values[s : s + n])).spanning_links())
        a, b = np.concatenate(found).T.view(np.int64) if sum(map(len, found)) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    key, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield links(key[:cut], values[:cut])
            key, values = key[cut:], values[cut:]
    if len(key):
        yield links(key, values)


def links(values: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all near pairs of the distinct ``fp``."""
    spark = values.sparkSession
    keys = F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(65535)) + F.lit(i * 65536) for i in range(4)])
    dealt = values.select("fp", F.explode(keys).alias("key"))
    large = dealt.groupBy("key").count().filter(F.col("count") > bucket)
    large = large.select("key", F.ceil(F.col("count") / bucket).cast("int").alias("n"))
    large = scratch.written(large, "large-buckets")
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int")
    other = F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)
    pair = F.least("chunk", "other").cast("long") * 4096 + F.greatest("chunk", "other")
    met = dealt.join(large, "key", "left").select("key", "fp", chunk.alias("chunk"), F.explode(other).alias("other"))
    met = met.select((F.col("key") * (1 << 24) + pair).alias("key"), "fp")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return arrow.mapped(met.repartition(tasks, "key").sortWithinPartitions("key"), "a long, b long", _bucket_links)


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, its group's smallest id."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    told = scratch.written(fingerprints(docs, with_text=False).select("doc_id", "fp"), "simhash")
    first = scratch.written(told.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    of = components(links(first.select("fp")))
    grouped = first.join(of, first["fp"] == of["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("first").alias("component_id"))
    owner = scratch.written(grouped.join(smallest, "part").select(F.col("fp").alias("_fp"), "component_id"), "simhash-groups")
    return told.join(owner, told["fp"] == owner["_fp"]).select("doc_id", "fp", "component_id")
