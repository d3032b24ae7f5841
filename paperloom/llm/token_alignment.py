"""Alignment of two tokenizers' tokens over a corpus, and counts of linked ids.

Tokenizer A is a byte-level BPE, B a piece model that puts a space first; both
see a space and the text. Two tokens of a text are neighbours where their bytes
overlap. The connected components of that bipartite graph, found by union-find,
are the smallest groups that both tokenizers cut alike; a group's A tokens and B
tokens are all linked to each other.

Work is split where a space follows a character that is none and precedes
another: neither tokenizer has tokens across such a place. A task aligns every
different word of a chunk of documents once (many in one call), and documents
are put together from words. What a chunk holds is bounded by ``CHUNK_BYTES`` of
text and ``CHUNK_WORDS`` words (a single text may exceed the first).

Pair counts (in how many documents a pair is linked) are counted per chunk, summed
by pair in a shuffle, and sent back by another join to the chunks that hold the
pair, not to documents: chunks, not texts or pairs of single documents, move.

Defined cases: texts that are null or empty, or that tokens of A or of B do not
spell byte by byte (say, a text with U+2581), have no tokens, no groups and no
links. Rows that repeat an id, or have none, are documents each. Other columns are
not read. Special tokens' strings are plain text. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import arrow, scratch

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 32 << 20
CHUNK_WORDS = 700_000
#: Documents' texts put together at a time, and words aligned at a time.
PART_BYTES = 1 << 20
BLOCK = 4096
SPACE = "▁"
_WORDS = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (a rule of that format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def _union(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Root (smallest member) of every node's component: all links hook roots at once, then paths are halved."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers, from 0 in order, of the A and B tokens that end at these byte offsets (both cover the same bytes)."""
    ends = np.union1d(a_ends, b_ends)  # between two of them one A and one B token overlap
    u, v = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends) + len(a_ends)
    root = _union(len(a_ends) + len(b_ends), u, v)
    number = np.unique(root, return_inverse=True)[1]  # roots are first A tokens, so numbers follow the text
    return number[: len(a_ends)], number[len(a_ends) :]


def links(a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every link: all pairs within each group."""
    sizes = np.bincount(b_group, minlength=int(a_group[-1]) + 1) if len(a_group) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    times = sizes[a_group] if len(a_group) else sizes
    a = np.repeat(np.arange(len(a_group)), times)
    within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, first[a_group[a]] + within


@dataclass
class Vocabularies:
    """The two tokenizer files' contents; they travel to the tasks (a few MB)."""

    a_json: str
    b_model: bytes

    @classmethod
    def load(cls, a: str = VOCABULARY_A, b: str = VOCABULARY_B) -> Vocabularies:
        with open(a, encoding="utf-8") as one, open(b, "rb") as other:
            return cls(one.read(), other.read())


class Tokenizers:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, files: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a_json)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b_model)
        byte = _byte_of()
        spelled = {i: bytes(byte[c] for c in t) for t, i in json.loads(files.a_json)["model"]["vocab"].items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [_piece_bytes(p) for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)  # no piece goes on after a space
        text = lambda n, before: [before + str(i).encode() for i in range(n)]
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.a_text = (text(na, b""), text(na, b";"), text(na, b","))
        self.b_text = (text(nb, b"|"), text(nb, b","))

    def words(self, text: str) -> list[str]:
        return _WORDS.split(text) if self.by_words else [text]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a space and ``text``, or None if either does not spell it."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        whole = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a), np.array(b)


@dataclass
class Aligned:
    """Groups of tokens in order: ids and group numbers of both sides, and bytes."""

    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    ends: np.ndarray  # of A tokens, in bytes


def _aligned(t: Tokenizers, a: np.ndarray, b: np.ndarray) -> Aligned:
    a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    return Aligned(a, b, *components(a_ends, b_ends), a_ends)


def align_text(t: Tokenizers, text: str | None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of A and of B."""
    found = t.ids(text) if text else None
    if found is None:
        return []
    got = _aligned(t, *found)
    cut = lambda ids, group: [x.tolist() for x in np.split(ids, np.flatnonzero(np.diff(group)) + 1)]
    return list(zip(cut(got.a, got.a_group), cut(got.b, got.b_group), strict=True))


class Words:
    """The different words of a chunk: how each is cut, what it links, and its share of the text of groups.

    A word that the tokenizers do not spell has number 0.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.number: dict[str, int] = {}
        self.text: list[bytes] = [b""]
        self.pairs: dict[int, int] = {}
        self._facts: list[np.ndarray] = [np.zeros((1, 4), np.int64)]  # A tokens, B tokens, groups, links
        self._sizes: list[np.ndarray] = [np.zeros(1, np.int64)]
        self._pair: list[np.ndarray] = []
        self._times: list[np.ndarray] = []
        self._held = None

    def add(self, words: list[str]) -> None:
        """Align words that are not yet known."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        for at in range(0, len(plain), BLOCK):
            self._add(plain[at : at + BLOCK])
        for w in words:
            if w not in self.number:
                self._add([w])
        self._held = None

    def _add(self, words: list[str]) -> None:
        found = self.t.ids(" ".join(words))
        sizes = np.array([len(w.encode()) + 1 for w in words])
        if found is not None:
            got, after = _aligned(self.t, *found), np.cumsum(sizes)
            whole = np.searchsorted(got.ends, after)
            if np.array_equal(got.ends[np.minimum(whole, len(got.ends) - 1)], after):
                last = got.a_group[whole]  # the group that ends with the word
                if np.array_equal(np.flatnonzero(np.diff(got.a_group, append=-1))[last], whole):
                    self._take(words, got, whole + 1, last + 1)
                    return
        if len(words) == 1:
            self.number[words[0]] = 0
            return
        for w in words:
            self._add([w])

    def _take(self, words: list[str], got: Aligned, a_after: np.ndarray, g_after: np.ndarray) -> None:
        n, t = len(words), self.t
        word_of_group = np.repeat(np.arange(n), np.diff(g_after, prepend=0))
        a_word, b_word = word_of_group[got.a_group], word_of_group[got.b_group]
        x, y = links(got.a_group, got.b_group)
        key, owner = (got.a[x].astype(np.int64) << 32) | got.b[y], a_word[x]
        facts = np.stack([np.bincount(w, minlength=n) for w in (a_word, b_word, word_of_group, owner)], 1)
        distinct, inverse = np.unique(key, return_inverse=True)
        pairs = self.pairs
        index = np.array([pairs.setdefault(k, len(pairs)) for k in distinct.tolist()])[inverse]
        both, times = np.unique((owner << 40) | index, return_counts=True)
        self._facts.append(facts)
        self._sizes.append(np.bincount(both >> 40, minlength=n))
        self._pair.append((both & ((1 << 40) - 1)).astype(np.int32))
        self._times.append(times.astype(np.int32))
        # the text of groups: A ids, then B ids of each, in order
        first_a, first_b = np.diff(got.a_group, prepend=-1) > 0, np.diff(got.b_group, prepend=-1) > 0
        begins = np.diff(a_word, prepend=-1) > 0
        how = np.where(begins, 0, np.where(first_a, 1, 2)).tolist()
        texts = [t.a_text[h][i] for h, i in zip(how, got.a.tolist(), strict=True)]
        texts += [t.b_text[h][i] for h, i in zip(np.where(first_b, 0, 1).tolist(), got.b.tolist(), strict=True)]
        order = np.argsort(np.concatenate([2 * got.a_group, 2 * got.b_group + 1]), kind="stable").tolist()
        texts = [texts[i] for i in order]
        ends = np.cumsum(facts[:, 0] + facts[:, 1]).tolist()
        at, base = 0, len(self.text)
        for i, (w, end) in enumerate(zip(words, ends, strict=True)):
            self.text.append(b"".join(texts[at:end]))
            self.number[w] = base + i
            at = end

    def tables(self) -> tuple[np.ndarray, ...]:
        """Facts by word, and where each word's pairs begin, the pairs and how often each is linked."""
        if self._held is None:
            none = [np.zeros(0, np.int32)]
            self._facts, self._sizes = [np.concatenate(self._facts)], [np.concatenate(self._sizes)]
            self._pair, self._times = [np.concatenate(self._pair or none)], [np.concatenate(self._times or none)]
            self._held = self._facts[0], np.concatenate([[0], np.cumsum(self._sizes[0])]), self._pair[0], self._times[0]
        return self._held


_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *[c.nbytes for c in columns]], np.int64).tobytes()
    return zstandard.compress(head + b"".join(c.tobytes() for c in columns), 1)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds), 8), 8 + 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_PART = ("<i8", "?", "<i4", "u1", "<i4", "<i4", "<i4")  # ids, no id, facts, digests, pairs of each, gaps, times


class Chunk:
    """Documents aligned so far, and in how many each pair is linked."""

    def __init__(self, tokenizers: Tokenizers, number: int):
        self.words, self.number, self.size = Words(tokenizers), number, 0
        self.held_in = np.zeros(1024, np.int32)

    def part(self, ids: list[int | None], texts: list[str | None]) -> bytes:
        """Align some documents; what is known of them before corpus-wide counts."""
        words, known = self.words, self.words.number
        split = [words.t.words(x) if x else [] for x in texts]
        if new := {w for s in split for w in s if w not in known}:
            words.add(sorted(new))
        numbers = [[known[w] for w in s] for s in split]
        spelled = [bool(s) and 0 not in s for s in numbers]
        numbers = [s if ok else [] for s, ok in zip(numbers, spelled, strict=True)]
        digests = [hashlib.sha256(b";".join([words.text[i] for i in s])).digest() if s else b"" for s in numbers]
        flat = np.array([i for s in numbers for i in s], np.int64)
        sizes = np.array([len(s) for s in numbers])
        doc = np.repeat(np.arange(len(ids)), sizes)
        facts, first, pair, times = words.tables()
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(facts[flat], 0)])
        ends = np.cumsum(sizes)
        found = (sums[ends] - sums[ends - sizes]).astype(np.int32)
        both, again = np.unique((doc << 32) | flat, return_counts=True)
        doc, flat = both >> 32, both & 0xFFFFFFFF
        n = (first[flat + 1] - first[flat]).astype(np.int64)
        at = np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, weight = (np.repeat(doc, n) << 32) | pair[at], np.repeat(again, n) * times[at]
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(weight[order], starts) if len(starts) else weight
        key = key[starts]
        doc, own = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        if (most := len(words.pairs)) > len(self.held_in):
            self.held_in = np.concatenate([self.held_in, np.zeros(2 * most - len(self.held_in), np.int32)])
        self.held_in[:most] += np.bincount(own, minlength=most).astype(np.int32)
        gaps = np.diff(own, prepend=0)
        gaps[np.diff(doc, prepend=-1) > 0] = own[np.diff(doc, prepend=-1) > 0]
        self.size += sum(len(x) for x in texts if x)
        id_of, none = np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids])
        sha = np.frombuffer(b"".join(digests), np.uint8)
        per = np.bincount(doc, minlength=len(ids)).astype(np.int32)
        return _packed(id_of, none, found, sha, per, gaps.astype(np.int32), weight.astype(np.int32))

    def full(self) -> bool:
        return self.size >= CHUNK_BYTES or len(self.words.number) >= CHUNK_WORDS

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B of every pair by its number, and documents of this chunk that hold it."""
        key = np.fromiter(self.words.pairs, np.int64, len(self.words.pairs))
        return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), self.held_in[: len(key)]


_CODED = "chunk long, pair int, a int, b int, n int, part binary"
_ROWS = 50_000


def _coded(files):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, chunk, made = Tokenizers(files.value), None, 0
        names = ["chunk", "pair", "a", "b", "n", "part"]

        def settled() -> Iterator[pa.RecordBatch]:
            a, b, n = chunk.counts()
            for at in range(0, len(n), _ROWS):
                k = len(n[at : at + _ROWS])
                cols = [pa.array(np.full(k, chunk.number)), pa.array(np.arange(at, at + k, dtype=np.int32)), *(pa.array(x[at : at + k]) for x in (a, b, n)), pa.nulls(k, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, after, _, _ in arrow.slices(texts, PART_BYTES):
                if chunk is None:
                    chunk, made = Chunk(tokenizers, (TaskContext.get().partitionId() << 32) | made), made + 1
                part = chunk.part(ids.slice(first, after - first).to_pylist(), texts.slice(first, after - first).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([chunk.number]), *[pa.nulls(1, pa.int32())] * 4, pa.array([part], pa.binary())], names)
                if chunk.full():
                    yield from settled()
                    chunk = None
        if chunk is not None:
            yield from settled()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by chunk, counts by pair number first, then documents, to the result."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    chunk, counts, tops = None, [], []
    held: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        chunks, n, top = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
        is_part = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(is_part) != 0)) + 1).tolist(), len(chunks)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if chunks[a] != chunk:
                chunk, counts, tops, held = chunks[a], [], [], None
            if not is_part[a]:
                counts.append(n.slice(a, b - a).to_numpy())
                tops.append(top.slice(a, b - a).to_numpy(zero_copy_only=False))
                continue
            if held is None:
                none = [np.zeros(0, np.int64)]
                held = np.concatenate(counts or none), np.concatenate(tops or none)
            for blob in batch.column(4).slice(a, b - a):
                yield _documents(blob.as_buffer().to_pybytes(), *held, names)


def _documents(blob: bytes, count: np.ndarray, top: np.ndarray, names: list[str]) -> pa.RecordBatch:
    ids, none, facts, sha, per, gaps, times = _unpacked(blob, *_PART)
    facts = facts.reshape(-1, 4).astype(np.int64)
    ends = np.cumsum(per, dtype=np.int64)
    run = np.cumsum(gaps, dtype=np.int64)
    base = np.concatenate([[0], run])[ends - per]  # gaps start anew with each document
    own = run - np.repeat(base, per)
    each = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([times * top[own].astype(np.int64), times * count[own].astype(np.int64)], 1), 0)])
    sums = each[ends] - each[ends - per]
    has = facts[:, 0] > 0
    text, place, digests = sha.tobytes(), 0, []
    for ok in has.tolist():
        digests.append(text[place : place + 32].hex() if ok else "")
        place += 32 * ok
    cols = [pa.array(ids, mask=none), *(pa.array(facts[:, i]) for i in range(4)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(digests)]
    return pa.RecordBatch.from_arrays(cols, names)


def _files(spark: SparkSession, a: str, b: str):  # noqa: ANN202
    return spark.sparkContext.broadcast(Vocabularies.load(a, b))  # two vocabulary files of fixed size


def groups(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, text: str = "text", to: str = "groups") -> DataFrame:
    """``docs`` with the groups of every text: ids of A, ids of B, and the bytes (of a space and the text) that they cover."""
    from pyspark.sql import types as T

    files = _files(docs.sparkSession, a, b)
    whole = T.ArrayType(T.LongType())
    kind = T.ArrayType(T.StructType([T.StructField("a", whole), T.StructField("b", whole), T.StructField("n_bytes", T.LongType())]))
    held: list[Tokenizers] = []

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Tokenizers(files.value))
        found = [align_text(held[0], x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        rows = [[{"a": x, "b": y, "n_bytes": int(held[0].a_size[x].sum())} for x, y in f] for f in found]
        ids = pa.list_(pa.int64())
        return [pa.array(rows, pa.list_(pa.struct([("a", ids), ("b", ids), ("n_bytes", pa.int64())])))]

    return arrow.with_columns(docs, [T.StructField(to, kind)], columns)


def _coded_table(docs: DataFrame, a: str, b: str, doc_id: str, text: str) -> DataFrame:
    arrow.check_integer(docs, doc_id)
    files = _files(docs.sparkSession, a, b)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return scratch.written(arrow.mapped(rows, _CODED, _coded(files)), "aligned")  # texts are tokenized once


def _counted(coded: DataFrame) -> DataFrame:
    """``a, b, n, top``: documents that hold each pair linked, and whether no pair of ``a`` has more."""
    counts = coded.filter("part is null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("a") == F.col("_a")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("top"))


def pair_counts(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``a, b, n, top`` for every pair of ids that is linked somewhere."""
    return _counted(_coded_table(docs, a, b, doc_id, text)).filter("n > 0")  # words of texts without tokens hold some that none has


def alignments(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document tokens, groups and links, links that are an A id's most frequent, and pair counts summed over links."""
    spark = docs.sparkSession
    coded = _coded_table(docs, a, b, doc_id, text)
    pairs = coded.filter("part is null").select("chunk", "pair", F.col("a").alias("_a"), F.col("b").alias("_b"))
    told = scratch.written(_counted(coded), "pair-counts")
    met = pairs.join(told, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")))
    known = met.select("chunk", "pair", "n", "top", F.lit(None).cast("binary").alias("part"))
    parts = coded.filter("part is not null").select("chunk", F.lit(None).cast("int").alias("pair"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("top"), "part")
    dealt = known.unionByName(parts).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    dealt = dealt.sortWithinPartitions("chunk", F.col("pair").asc_nulls_last())
    return arrow.mapped(dealt, RESULT, _told)
