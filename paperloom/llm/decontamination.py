"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``K`` words gives a gram hash, and of every
``SPAN - K + 1`` neighbouring grams the smallest is kept as a fingerprint. Any
span of ``SPAN`` words that a document and a benchmark item share makes both
keep the same fingerprint, so joining fingerprints misses no such span. Each
joined document is then read exactly: its words against the items' windows, and
every occurrence of a window marks its words.

An item of fewer than ``SPAN`` words is one window of its own length; these are
joined by the hashes of all document runs of those few lengths.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text, each
broadcast as hash arrays beside the text they are checked against (about eight
bytes a byte of text), so the broadcast has a fixed bound; all documents meet
every block. Of a document only the words around fingerprints are read exactly,
and a long text is hashed in stretches.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Defined cases: null or wordless text has no words and no hits; wordless items
have no window; items that share an id are all searched, and the id is counted
once; a null ``item_id`` is searched and named by the empty string; other
columns pass, whatever their names, but ``n_words``, ``hit_words`` and ``items``
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import arrow, scratch

SPAN = 10
K = 6
BLOCK_BYTES = 8 << 20
#: Bytes whose words are hashed at a time.
STRETCH = arrow.SLICE_BYTES
#: Fixed value: a word after lower-casing A-Z, on UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _classes() -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.ones(256, bool)
    word[:0x30] = word[0x3A:0x61] = word[0x7B:0x80] = False
    return fold, word


_FOLD, _WORD = _classes()
_IS_WORD = _WORD[_FOLD]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        ones = [np.full(max(n, STRETCH + 1), b, np.uint64) for b in (_BASE, inverse)]
        for x in ones:
            x[0] = 1
        _POWERS[:] = [np.cumprod(x) for x in ones]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _fragments(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after and unmixed hash of every run of word bytes; ``edges`` end words."""
    inside = _IS_WORD[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    before[edges] = False
    start = np.flatnonzero(inside & ~before[:-1])
    edge = np.ones(len(raw) + 1, bool)
    edge[:-1] = ~inside
    edge[edges] = True
    end = np.flatnonzero(edge[1:] & inside) + 1
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return start, end, (sums[end] - sums[start]) * down[start]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after and hash of every word of every text."""
    starts, ends, hashes = [], [], []
    for at in range(0, len(raw), STRETCH):
        to = min(len(raw), at + STRETCH)
        near = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")]
        start, end, h = _fragments(raw[at:to], near - at)
        start, end = start + at, end + at
        if at and len(start) and start[0] == at and ends and len(ends[-1]) and ends[-1][-1] == at and at not in near[:1]:
            power = np.uint64(pow(int(_BASE), int(at - starts[-1][-1]), 1 << 64))
            h[:1] = hashes[-1][-1:] + power * h[:1]  # the word that the stretch before began
            start[0] = starts[-1][-1]
            starts[-1], ends[-1], hashes[-1] = starts[-1][:-1], ends[-1][:-1], hashes[-1][:-1]
        starts.append(start)
        ends.append(end)
        hashes.append(h)
    none = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else none.view(np.uint64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none]), _mixed(h)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words before each text."""
    start, _, h = word_spans(raw, offsets)
    return h, np.searchsorted(start, offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : n + j]
    return _mixed(out)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Which grams are the smallest of one of the windows they lie in."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(len(grams), bool)
    low = grams[:n].copy()
    for j in range(1, window):
        np.minimum(low, grams[j : n + j], out=low)
    kept = np.zeros(len(grams), bool)
    for j in range(window):
        kept[j : n + j] |= grams[j : n + j] == low
    return kept


@dataclass
class Windows:
    """All windows of one length of some items, sorted by hash, with the bytes they stand for."""

    hashes: np.ndarray
    first: np.ndarray  # byte range in the block's text
    after: np.ndarray
    item: np.ndarray

    def items_of(self, h: int, said: bytes, text: bytes) -> list[int]:
        """The items that hold exactly these words."""
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        return [int(self.item[i]) for i in range(low, high) if text[self.first[i] : self.after[i]] == said]


@dataclass
class Block:
    """The fingerprints and windows of some benchmark items."""

    span: int
    k: int
    names: list[str] = field(default_factory=list)
    text: bytes = b""  # words of all items, with a blank after each
    grams: dict[int, np.ndarray] = field(default_factory=dict)  # run length -> sorted hashes
    windows: dict[int, Windows] = field(default_factory=dict)

    def near(self, words: np.ndarray) -> np.ndarray:
        """Positions of the runs that the items may share."""
        found = []
        for length, own in self.grams.items():
            grams = gram_hashes(words, length)
            if length == self.k and self.span in self.windows:
                at = np.flatnonzero(winnow(grams, self.span - self.k + 1) | (self.k in self.windows))
            else:
                at = np.arange(len(grams))
            place = np.searchsorted(own, grams[at])
            found.append(at[own[np.minimum(place, len(own) - 1)] == grams[at]])
        return np.concatenate(found) if found else np.zeros(0, int)

    def read(self, hashes: np.ndarray, near: np.ndarray, said) -> tuple[np.ndarray, set[str]]:
        """Hit words and items of one document, exactly, given its word hashes and positions of ``near``.

        ``said(a, b)`` gives the document's words ``a`` to ``b``, each with a blank after it.
        """
        hits, items = [], set()
        low, high = np.maximum(near - self.span, 0), np.minimum(near + self.span, len(hashes))
        cut = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1]) + 1
        for a, b in zip(low[np.append(0, cut)].tolist(), np.maximum.reduceat(high, np.append(0, cut)).tolist(), strict=True):
            words, hit = said(a, b).split(b" ")[:-1], np.zeros(b - a + 1, np.int64)
            for length, windows in self.windows.items():
                grams = gram_hashes(hashes[a:b], length)
                place = np.minimum(np.searchsorted(windows.hashes, grams), len(windows.hashes) - 1)
                for i in np.flatnonzero(windows.hashes[place] == grams).tolist():
                    if own := windows.items_of(grams[i], b" ".join(words[i : i + length]) + b" ", self.text):
                        items.update(self.names[x] for x in own)
                        hit[i] += 1
                        hit[i + length] -= 1
            hits.append(a + np.flatnonzero(np.cumsum(hit[:-1])))
        return np.concatenate(hits), items


def block_of(items: list[tuple[str, bytes]], span: int = SPAN, k: int = K) -> Block:
    out, text, at = Block(span, k), [], 0
    grams: dict[int, list[np.ndarray]] = {}
    windows: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for name, raw in items:
        said = b"".join(w + b" " for w in words_of(raw))
        start, end, hashes = word_spans(np.frombuffer(said, np.uint8), np.array([0, len(said)]))
        length = min(span, len(hashes))
        if not length:
            continue
        n = len(hashes) - length + 1
        own = np.full(n, len(out.names), np.int32)
        windows.setdefault(length, []).append((gram_hashes(hashes, length), (at + start[:n]).astype(np.int32), (at + end[length - 1 :] + 1).astype(np.int32), own))
        if length < span:
            grams.setdefault(length, []).append(gram_hashes(hashes, length))
        else:
            own = gram_hashes(hashes, k)
            grams.setdefault(k, []).append(own[winnow(own, span - k + 1)])
        out.names.append(name)
        text.append(said)
        at += len(said)
    out.text = b"".join(text)
    out.grams = {length: np.unique(np.concatenate(g)) for length, g in grams.items()}
    for length, each in windows.items():
        h, first, after, item = (np.concatenate(x) for x in zip(*each, strict=True))
        by = np.argsort(h, kind="stable")
        out.windows[length] = Windows(h[by], first[by], after[by], item[by])
    return out


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, span: int = SPAN, k: int = K) -> list:
    """The benchmark's items in broadcast blocks of bounded size; the table is read twice, whatever their number."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes) or 1
    context, out, held, now = benchmark.sparkSession.sparkContext, [], [], 0
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int"))
    for r in (dealt.orderBy("part") if n > 1 else dealt).toLocalIterator():
        if r["part"] != now and held:
            out.append(context.broadcast(block_of(held, span, k)))
            held = []
        now = r["part"]
        held.append((r["item"], r["text"].encode()))
    return [*out, context.broadcast(block_of(held, span, k))]


def _against(docs: DataFrame, block) -> DataFrame:
    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        own, n = block.value, batch.num_rows
        counts, hits, items = np.zeros(n, np.int64), [None] * n, [None] * n
        for first, after, raw, off in arrow.slices(batch.column(batch.schema.get_field_index("text"))):
            start, end, words = word_spans(raw, off)
            before = np.searchsorted(start, off)
            counts[first:after] = np.diff(before)
            near = np.sort(own.near(words))
            of = np.searchsorted(before, near, "right") - 1
            for i in np.unique(of).tolist():
                a, b = before[i], before[i + 1]

                def said(x: int, y: int, a=a) -> bytes:
                    return b"".join(_FOLD[raw[start[w] : end[w]]].tobytes() + b" " for w in range(a + x, a + y))

                at, names = own.read(words[a:b], near[of == i] - a, said)
                if names:
                    hits[first + i], items[first + i] = at.tolist(), sorted(names)
        return [pa.array(counts), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return arrow.with_columns(docs, FIELDS, columns)


def find_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, span: int = SPAN, k: int = K) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions) and ``items`` (both null where clean)."""
    blocks = blocks_of(benchmark, block_bytes, span, k)
    if len(blocks) == 1:
        return _against(docs, blocks[0])
    key = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("_body"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("_more")]
    found = None
    for b in blocks:
        one = _against(docs.select("text"), b).filter("items is not null")
        one = scratch.written(one.select(*key, "hit_words", "items"), "leaks")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("_body", "_more").agg(  # equal texts have equal hits
        F.sort_array(F.flatten(F.collect_set("hit_words"))).alias("_hits"),
        F.sort_array(F.flatten(F.collect_set("items"))).alias("_found"),
    )
    counted = _against(docs, docs.sparkSession.sparkContext.broadcast(Block(span, k)))
    kept = [c for c in counted.columns if c not in ("hit_words", "items")]
    whole = counted.select(F.struct(*[counted[c] for c in kept]).alias("_row"), *[c.alias(f"_own{i}") for i, c in enumerate(key)])
    met = whole.join(found, (whole["_own0"] == found["_body"]) & (whole["_own1"] == found["_more"]), "left")
    return met.select(*[F.col("_row")[c].alias(c) for c in kept], F.array_distinct("_hits").alias("hit_words"), F.array_distinct("_found").alias("items"))
