"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree with frozen counts is
learned; a text's score under a language is its exact code length in bits. A
byte is coded in the longest context of up to ``order`` bytes that the
language's tree holds; where the byte was not seen there, the escape
probability of that context is paid and the next shorter one is tried (method
C), down to a uniform code over 256 values. A-Z count as a-z.

All trees share one numbering of their strings: string ``x + b`` gets its
number from the number of ``x`` and the byte, one table lookup per order. A
number then leads to the finished code lengths of all languages, escapes
included, so a whole batch of texts is scored by a few array lookups per byte.

Learning uses a sample of labelled rows: up to ``ROWS_PER_LANG`` of each
language, the first ones by a hash of id and text, and of a longer text a piece
of ``CHARS_PER_ROW`` characters at a place drawn by that hash; ``SAMPLE_CHARS``
bounds all pieces together, so pieces get shorter (to ``LEAST_CHARS``) and then
fewer where languages are many. No
language is left out: they are learned in blocks of ``BLOCK`` trees, each scored
on its own. Scoring reads every whole text, a long one in stretches.

The worst code length per byte that a learning text of a language has, times
``SLACK``, is what a text may cost to fit that language (``fits``), beside
``FREE_BITS`` for the start of a text.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
so is every text if no language could be learned. Ties go to the language that
sorts first. Rows with null ``lang`` or null text are not learned from; equal
rows are drawn one by one. ``text`` and the added columns apart, columns pass.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm import arrow

UNKNOWN = "und"
ORDER = 3
#: Bounds of the sample that the trees are learned from.
ROWS_PER_LANG = 800
CHARS_PER_ROW = 20_000
SAMPLE_CHARS = 64_000_000
LEAST_CHARS = 200
#: Languages whose trees share one numbering.
BLOCK = 32
#: Bytes of a text that are scored at a time.
STRETCH = 1 << 20
SLACK = 1.5
FREE_BITS = 200.0
#: Strings seen less often in a language are no part of its tree.
MIN_COUNT = 2
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())]


def _fold() -> np.ndarray:
    table = np.arange(256)
    table[65:91] += 32
    return table


@dataclass
class ContextTrees:
    """Frozen context trees of several languages."""

    langs: list[str]
    lut: np.ndarray  # byte -> symbol, 0 for bytes never seen
    steps: list[np.ndarray]  # per string length >= 2: (number of prefix, symbol) -> number
    codes: list[np.ndarray]  # per string length >= 1: number -> bits of its last symbol, by language
    escapes: list[np.ndarray]  # per context length >= 0: number -> bits of an escape, by language
    most: np.ndarray  # bits a byte of the learning text that costs most, by language

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language."""
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        out, starts = np.zeros((len(offsets) - 1, len(self.langs))), offsets[full]
        for at in range(0, len(raw), STRETCH):
            since, to = max(0, at - len(self.steps)), min(len(raw), at + STRETCH)  # contexts reach back that far
            first, after = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, to, "left"))
            inside = starts[first:after]
            cost = self._each(raw[since:to], inside[inside >= since] - since)[at - since :]
            out[full[first:after]] += np.add.reduceat(cost, np.maximum(inside - at, 0), axis=0, dtype=np.float64)
        return out

    def _each(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        symbol = self.lut[raw]
        numbers, contexts = [symbol], []
        for step in self.steps:
            before = np.empty_like(symbol)
            before[0], before[1:] = 0, numbers[-1][:-1]
            before[starts] = 0
            contexts.append(before)
            numbers.append(step[before * 256 + symbol])
        cost = self.codes[-1][numbers[-1]]
        left = np.flatnonzero(numbers[-1] == 0)
        for k in range(len(self.steps) - 1, -1, -1):
            if not len(left):
                return cost
            at = numbers[k][left]
            cost[left] += self.escapes[k + 1][contexts[k][left]] + self.codes[k][at]
            left = left[at == 0]
        cost[left] += self.escapes[0][0] + 8.0
        return cost


def _counted(texts: list[bytes], lut: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length up to ``order + 1``, the strings of symbols seen often enough, and how often."""
    sizes = np.array([len(t) for t in texts], np.int64)
    symbol = lut[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint16)
    since = np.arange(len(symbol), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    out, key = [], symbol.astype(np.uint64)
    for k in range(1, order + 2):
        if k > 1:
            key = (key[:-1] << np.uint64(8)) | symbol[k - 1 :].astype(np.uint64)
        found, times = np.unique(key[since[k - 1 :] >= k - 1], return_counts=True)
        some = times >= (MIN_COUNT if k > 1 else 1)
        out.append((found[some], times[some]))
    return out


def learn(samples: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
    """Context trees from sample texts of each language."""
    langs, fold = sorted(samples), _fold()
    seen = np.zeros(256, bool)
    for lang in langs:
        for text in samples[lang]:
            seen[fold[np.frombuffer(text, np.uint8)]] = True
    number = np.zeros(256, np.int64)
    number[np.flatnonzero(seen)] = np.arange(1, seen.sum() + 1)
    lut = number[fold].astype(np.int32)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
    for lang in langs:
        for k, found in enumerate(_counted(samples[lang], lut, order)):
            counts[k].append(found)
    keys = [np.unique(np.concatenate([f for f, _ in each])) if each else np.zeros(0, np.uint64) for each in counts]
    steps, codes, escapes = [], [], []
    nl = len(langs)
    for k in range(1, order + 2):
        own = keys[k - 1]
        tally = np.zeros((len(own), nl))
        for j, (found, times) in enumerate(counts[k - 1]):
            tally[np.searchsorted(own, found), j] = times
        if k == 1:
            parent = np.zeros(len(own), np.int64)
            total, kinds = tally.sum(0, keepdims=True), (tally > 0).sum(0, keepdims=True)
            shorter = np.full((len(own), nl), 8.0)
            assert not len(own) or np.array_equal(own.astype(np.int64), np.arange(1, len(own) + 1))
        else:
            up = keys[k - 2]
            parent = np.searchsorted(up, own >> np.uint64(8)) + 1
            total, kinds = np.zeros((len(up) + 1, nl)), np.zeros((len(up) + 1, nl))
            np.add.at(total, parent, tally)
            np.add.at(kinds, parent, tally > 0)
            suffix = np.searchsorted(up, own & np.uint64((1 << (8 * (k - 1))) - 1)) + 1
            shorter = codes[-1][suffix]
            step = np.zeros((len(up) + 1) * 256, np.int32)
            step[parent * 256 + (own & np.uint64(255)).astype(np.int64)] = np.arange(1, len(own) + 1)
            steps.append(step)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            code = np.where(tally > 0, -np.log2(tally / (total + kinds)[parent]), escape[parent] + shorter)
        escapes.append(escape.astype(np.float32))
        codes.append(np.vstack([np.zeros((1, nl)), code]).astype(np.float32))
    trees = ContextTrees(langs, lut, steps, codes, escapes, np.zeros(nl))
    for j, lang in enumerate(langs):
        sizes = np.array([len(t) for t in samples[lang]], np.int64)
        if sizes.any():
            own = trees.bits(np.frombuffer(b"".join(samples[lang]), np.uint8), np.cumsum([0, *sizes]))[:, j]
            trees.most[j] = (np.maximum(own - FREE_BITS, 0) / np.maximum(sizes, 1)).max()
    return trees


def _letter_in(text: np.ndarray) -> bool:
    """Whether some character is a letter; a long text is read in stretches."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return any(any(map(str.isalpha, reader.decode(text[at : at + STRETCH].tobytes()))) for at in range(0, len(text), STRETCH))


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.zeros(len(offsets) - 1, bool)
    if len(raw):
        out[full] = np.logical_or.reduceat(((raw | 32) >= 97) & ((raw | 32) <= 122), offsets[full])
    for i in full[~out[full]]:
        text = raw[offsets[i] : offsets[i + 1]]
        out[i] = bool((text > 127).any()) and _letter_in(text)
    return out


def predictions(trees: list[ContextTrees] | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and posterior of every text, and whether it fits; the posterior weighs all languages alike."""
    lang, score, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not trees:
        return lang, score, fits
    names, most = [x for t in trees for x in t.langs], np.concatenate([t.most for t in trees])
    for first, after, raw, offsets in arrow.slices(texts):
        bits = np.concatenate([t.bits(raw, offsets) for t in trees], 1)
        best = bits.argmin(1)
        weight = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000.0))
        letters = _has_letter(raw, offsets)
        score[first:after] = np.where(letters, 1.0 / weight.sum(1), 0.0)
        fits[first:after] = letters & (bits.min(1) <= SLACK * most[best] * np.diff(offsets) + FREE_BITS)
        lang[first:after] = [names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return lang, score, fits


def sample(docs: DataFrame, learnable: Column, rows: int = ROWS_PER_LANG, chars: int = CHARS_PER_ROW, most: int = SAMPLE_CHARS) -> dict[str, list[bytes]]:
    """Up to ``rows`` pieces of text of each language, the first ones by a hash of id and text.

    Rows are counted by the number of digits of their hash, 40 sums a language at
    most; the least number of digits that covers ``rows`` leaves about twice as
    many, of which the first are taken.
    """
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 40))
    labelled = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), "text", place.alias("_place"))
    digits: dict[str, dict[int, int]] = {}
    for r in labelled.groupBy("lang", F.length(F.bin("_place")).alias("d")).count().collect():  # rows of the model's size
        digits.setdefault(r["lang"], {})[r["d"]] = r["count"]
    if not digits:
        return {}
    chars = max(min(chars, LEAST_CHARS), min(chars, most // (rows * len(digits))))
    rows = max(1, min(rows, most // (chars * len(digits))))
    limits = []
    for lang, counts in digits.items():
        held = np.cumsum([counts.get(d, 0) for d in range(42)])
        limits.append((lang, 1 << int(np.searchsorted(held, min(rows, held[-1])))))
    limit = docs.sparkSession.createDataFrame(limits, "lang string, _limit long")
    near = labelled.join(F.broadcast(limit), "lang").filter("_place < _limit")
    since = F.pmod(F.xxhash64(F.lit("piece"), "_place"), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    near = near.select("lang", "_place", F.substr("text", since, F.lit(chars)).alias("piece"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "piece"))
    found = near.withColumn("_n", first).filter(F.col("_n") <= rows).select("lang", "_n", "piece").toPandas().sort_values(["lang", "_n"])
    return {str(k): [t.encode() for t in g["piece"]] for k, g in found.groupby("lang")}


def train(docs: DataFrame, learnable: Column | None = None, order: int = ORDER, **bounds) -> list[ContextTrees] | None:
    """Trees learned from the labelled rows of ``docs``, in blocks of languages, or None where there are none."""
    texts = {k: t for k, t in sample(docs, F.lit(True) if learnable is None else learnable, **bounds).items() if any(t)}
    langs = sorted(texts)
    return [learn({k: texts[k] for k in langs[at : at + BLOCK]}, order) for at in range(0, len(langs), BLOCK)] or None


def identify(docs: DataFrame, trees: list[ContextTrees] | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fits``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        lang, score, fits = predictions(shared.value, batch.column(batch.schema.get_field_index("text")))
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(fits)]

    return arrow.with_columns(docs, FIELDS, columns)
