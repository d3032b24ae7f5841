"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, context windows.

A lexicon is learned from labelled documents: words, and beginnings of words
(``MIN_STEM`` to ``MAX_STEM`` letters), that far more toxic than clean documents
hold (log-likelihood ratio), each with its log odds. Its terms form a trie. A
word of a text is looked up

* as it is, with the longest-odds beginning that the lexicon has;
* with digits and signs read as the letters they stand for and letters said
  once that stand three times in a row;
* by intersecting the Levenshtein automaton of the word with the trie of words in
  ``MIN_SHARE`` of the toxic documents or more: both are walked at once, and a
  branch is left where the automaton has no state. States do not depend on the
  word (positions relative to the first one, and which of the next letters
  agree), so their steps are computed once for all words.

Every hit is weighed by its window of ``WINDOW`` words each side: quotation marks
around it and words of reporting speak for quotation, words that address someone
and other hits for abuse. A document's features (abuse, quotation, disguised
hits, density, strongest hit, weak hits, length) go through a logistic model.

The lexicon and the model are fitted to at most ``PER_LABEL`` documents of each
label, the first by a hash of the id; features for the model are computed with a
lexicon that was learned on the other half of them, so a term that is toxic by
chance counts for little. Labels are weighted by how many there are. Scoring
reads whole texts, those over ``STRETCH`` characters in stretches cut at white
space, where windows end too.

Defined cases: null and empty text has no words and is scored as such; without
labels of both kinds every score is 0; null labels and ids are ignored; rows
that repeat an id are examples each, and so is a document for each of several
label rows. ``text`` and the added column apart, columns pass untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm import arrow, scratch

PER_LABEL = 4000
MIN_STEM, MAX_STEM = 4, 8
#: Terms of a lexicon at most; least log-likelihood ratio, toxic documents and log odds of one.
TERMS = 600
MIN_RATIO = 9.0
MIN_DOCS = 3
MIN_ODDS = 1.0
#: Log odds of a term whose hits count by themselves; others only add up.
STRONG = 3.0
#: Share of the toxic documents that hold a word whose misspellings are looked for.
MIN_SHARE = 0.02
WINDOW = 6
STRETCH = 1 << 20
#: Words whose finding is kept by a task.
KNOWN = 600_000
#: Letters of a word from which one and two errors are allowed.
ONE_ERROR, TWO_ERRORS = 5, 9
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W_][\w$@!*]*")
#: Letters that digits and signs stand for.
LETTERS = str.maketrans("013457@$!", "oieastasi")
#: Words that report speech, and words that address someone, in four languages.
REPORTING = frozenset(
    "said says saying wrote writes called calls quoted quote quotes word words term insult insults "
    "sagte sagt schrieb nannte nennt zitat wort begriff dit disait écrit appelé cite citation mot terme "
    "dijo dice escribió llamó cita palabra término".split()
)
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr euch tu te toi ton vous votre tú ti tus usted ustedes vosotros".split())
_QUOTED = re.compile(r'["“”„«»‹›][^"“”„«»‹›\n]{0,400}["“”„«»‹›]')
_MARKS = set('"“”„«»‹›')


# --- Levenshtein automata -------------------------------------------------------


class Automata:
    """Levenshtein automata of up to ``k`` errors for any word.

    A state is a set of (place, errors), places relative to the smallest; a
    step depends only on which of the next ``2 k + 1`` letters of the word equal
    the letter that is read.
    """

    def __init__(self, k: int):
        self.k, self.width = k, 2 * k + 1
        self._steps: dict[tuple, tuple | None] = {}
        self.start = frozenset({(0, 0)})

    def step(self, state: frozenset, equal: int, left: int) -> tuple[frozenset, int] | None:
        """The next state and how far its places moved on; None if no word can follow.

        ``equal`` has bit j set where the word's j-th letter from the state's
        base is the letter read; ``left`` letters of the word remain there.
        """
        key = (state, equal, min(left, self.width))
        if key in self._steps:
            return self._steps[key]
        reached = set()
        for i, e in state:
            if equal >> i & 1:
                reached.add((i + 1, e))
                continue
            if e < self.k:
                reached.add((i, e + 1))  # a letter too many
                if i < left:
                    reached.add((i + 1, e + 1))  # another letter
                for j in range(1, self.k - e + 1):  # letters left out
                    if equal >> (i + j) & 1:
                        reached.add((i + j + 1, e + j))
                        break
        kept = {(i, e) for i, e in reached if not any(f < e and abs(i - j) <= e - f for j, f in reached)}
        found = None
        if kept:
            base = min(i for i, _ in kept)
            found = frozenset((i - base, e) for i, e in kept), base
        self._steps[key] = found
        return found

    def accepts(self, state: frozenset, left: int) -> int | None:
        """Errors of the best match if the word ends ``left`` letters from the base, or None."""
        best = min((e + left - i for i, e in state if i <= left), default=self.k + 1)
        return best if best <= self.k else None


class Trie:
    """Words as nested letters; a word's number is kept at its end."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for n, word in enumerate(words):
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def near(self, word: str, automata: Automata) -> Iterator[tuple[int, int]]:
        """Numbers and distances of the words within the automata's errors: both are walked at once."""
        size, width = len(word), automata.width
        todo = [(self.root, automata.start, 0)]
        while todo:
            node, state, base = todo.pop()
            for c, child in node.items():
                if c == "":
                    errors = automata.accepts(state, size - base)
                    if errors is not None:
                        yield child, errors
                    continue
                equal = 0
                for j in range(min(width, size - base)):
                    if word[base + j] == c:
                        equal |= 1 << j
                found = automata.step(state, equal, size - base)
                if found is not None:
                    todo.append((child, found[0], base + found[1]))


def errors_allowed(size: int) -> int:
    return 0 if size < ONE_ERROR else 1 if size < TWO_ERRORS else 2


def _letters(word: str) -> int:
    """The set of letters of a word, folded to 64 bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


class _Pieces:
    """Which words can be within the allowed errors of a term at all.

    Of a term's ``k + 1`` pieces ``k`` errors leave one as it is: the first one
    at the word's start, the last one at its end, or one in between. Lengths then
    differ by ``k`` at most, and sets of letters by ``2 k``.
    """

    def __init__(self, terms: list[str]):
        self.heads, self.tails, self.middles = {}, {}, {}
        for t in terms:
            k = errors_allowed(len(t))
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            parts = [t[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for table, part in ((self.heads, parts[0]), (self.tails, parts[-1]), *((self.middles, p) for p in parts[1:-1])):
                table.setdefault(len(part), {}).setdefault(part, []).append((len(t), _letters(t), k))

    def may(self, word: str) -> bool:
        size, letters = len(word), None
        found = [x for n, t in self.heads.items() if (x := t.get(word[:n]))]
        found += [x for n, t in self.tails.items() if (x := t.get(word[-n:]))]
        if size >= TWO_ERRORS - 2:
            found += [x for n, t in self.middles.items() for i in range(1, size - n) if (x := t.get(word[i : i + n]))]
        for terms in found:
            for n, own, k in terms:
                if -k <= n - size <= k:
                    if letters is None:
                        letters = _letters(word)
                    if (own ^ letters).bit_count() <= 2 * k:
                        return True
        return False


# --- lexicon --------------------------------------------------------------------


@dataclass
class Term:
    text: str
    stem: bool
    odds: float
    share: float = 1.0  # of the toxic documents


def _ratio(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    """Log-likelihood ratio of a term's documents against independence."""
    total = 0.0
    both, n = toxic + clean, n_toxic + n_clean
    for seen, row, column in ((toxic, both, n_toxic), (clean, both, n_clean), (n_toxic - toxic, n - both, n_toxic), (n_clean - clean, n - both, n_clean)):
        if seen > 0:
            total += seen * math.log(seen * n / (row * column))
    return 2 * total


def chosen(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[Term]:
    """The lexicon: terms by log-likelihood ratio, beginnings only where no longer term stands for nearly all their documents."""
    found = []
    for term, toxic, clean in counts:
        odds = math.log((toxic + 0.1) / (n_toxic + 0.2)) - math.log((clean + 0.5) / (n_clean + 1.0))
        ratio = _ratio(toxic, clean, n_toxic, n_clean)
        if toxic >= MIN_DOCS and odds >= MIN_ODDS and ratio >= MIN_RATIO:
            found.append((term, toxic, odds, ratio))
    longer: dict[str, int] = {}  # most documents that a longer term of such a beginning has
    for term, toxic, _, _ in found:
        bare = term.rstrip("*")
        for k in range(MIN_STEM, len(bare) + (not term.endswith("*"))):
            longer[bare[:k]] = max(longer.get(bare[:k], 0), toxic)
    kept = [x for x in found if not (x[0].endswith("*") and longer.get(x[0][:-1], 0) >= 0.9 * x[1])]
    kept.sort(key=lambda x: (-x[3], x[0]))
    return [Term(t.rstrip("*"), t.endswith("*"), o, toxic / n_toxic) for t, toxic, o, _ in kept[:TERMS]]


class Lexicon:
    """Looks words up: as they are, with letters restored, and with errors."""

    def __init__(self, terms: list[Term]):
        self.words = {t.text: t.odds for t in terms if not t.stem}
        self.stems = {t.text: t.odds for t in terms if t.stem}
        covered = lambda w: any(w[:k] in self.stems for k in range(MIN_STEM, len(w)))  # noqa: E731  one form of many
        self.strong = sorted(t.text for t in terms if not t.stem and t.odds >= STRONG and t.share >= MIN_SHARE and len(t.text) >= ONE_ERROR and not covered(t.text))
        self.trie, self.pieces = Trie(self.strong), _Pieces(self.strong)
        self.automata = {k: Automata(k) for k in (1, 2)}
        self.known: dict[str, tuple[float, bool] | None] = {}

    def _exact(self, word: str) -> float:
        odds = self.words.get(word, 0.0)
        for k in range(MIN_STEM, min(MAX_STEM, len(word) - 1) + 1):
            odds = max(odds, self.stems.get(word[:k], 0.0))
        return odds

    def _look(self, token: str) -> tuple[float, bool] | None:
        word = token.rstrip("!*$@_")
        if odds := self._exact(word):
            return odds, False
        plain = re.sub(r"(.)\1{2,}", r"\1", word.translate(LETTERS))
        if plain != word and (odds := self._exact(plain)) >= STRONG:
            return odds, True
        best = 0.0
        if len(word) >= ONE_ERROR - 1 and self.pieces.may(word):
            for k in (1, 2)[: 2 if len(word) >= TWO_ERRORS - 2 else 1]:
                for n, errors in self.trie.near(word, self.automata[k]):
                    term = self.strong[n]
                    if errors <= errors_allowed(len(term)):
                        best = max(best, self.words[term] / (1 + errors))
        return (best, True) if best else None

    def look(self, tokens: list[str]) -> dict[str, tuple[float, bool] | None]:
        known = self.known
        new = {w for w in tokens if w not in known}
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(tokens)
        for w in new:
            known[w] = self._look(w)
        return known


# --- documents --------------------------------------------------------------------


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH:
        cut = next((i for i in range(at + STRETCH, max(at, at + STRETCH - 1000), -1) if text[i].isspace()), at + STRETCH)
        yield text[at:cut]
        at = cut
    yield text[at:]


def context(words: list[str], at: int, quoted: bool, hits: set[int]) -> float:
    """Share of abuse, not quotation, in the hit at a place."""
    low, high = max(0, at - WINDOW), at + WINDOW + 1
    near = words[low:high]
    score = 1.5 - 3.0 * quoted - min(3.0, 1.5 * sum(w in REPORTING for w in near))
    score += 0.5 * any(w in ADDRESS for w in near) + 0.5 * any(i in hits for i in range(low, high) if i != at)
    return 1 / (1 + math.exp(-score))


N_FEATURES = 10
#: What weights are drawn to, in the order of ``features``, and how strongly.
PRIOR = np.array([-3.0, 2.0, 0.0, 1.0, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0])
RIDGE = 0.5


def features(lexicon: Lexicon, text: str | None) -> np.ndarray:
    """One document: 1, abuse, quotation, disguised hits, density, strongest, weak hits and their density, length, no words."""
    abuse = quotation = disguised = strongest = weak = 0.0
    n_words = 0
    for piece in _stretches(text) if text else ():
        low = piece.lower()
        words = _WORD.findall(low)
        n_words += len(words)
        known = lexicon.look(words)
        found = [(i, x) for i, w in enumerate(words) if (x := known[w])]
        strong = {i for i, (odds, hidden) in found if odds >= STRONG or hidden}
        weak += sum(odds for i, (odds, _) in found if i not in strong)
        if not strong:
            continue
        inside: set[int] = set()
        if not _MARKS.isdisjoint(low):
            spans = [m.span() for m in _QUOTED.finditer(low)]
            starts = np.array([a for a, _ in spans] or [0])
            ends = np.array([b for _, b in spans] or [0])
            for i, m in enumerate(_WORD.finditer(low)):
                if i in strong:
                    k = int(np.searchsorted(starts, m.start(), "right")) - 1
                    if k >= 0 and m.end() <= ends[k]:
                        inside.add(i)
        for i, (odds, hidden) in found:
            if i in strong:
                share = context(words, i, i in inside, strong)
                if hidden:
                    disguised += odds * share
                else:
                    abuse += odds * share
                quotation += odds * (1 - share)
                strongest = max(strongest, odds * share)
    per = 100 / max(n_words, 20)
    out = np.array([1, math.log1p(abuse), math.log1p(quotation), math.log1p(disguised), math.log1p((abuse + disguised) * per), strongest / 4, math.log1p(weak), math.log1p(weak * per), math.log1p(n_words) / 5, not n_words], float)
    return out


@dataclass
class Model:
    """What scoring needs: the lexicon's terms and the weights of features."""

    terms: list[Term] = field(default_factory=list)
    weights: np.ndarray | None = None

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.stack([features(lexicon, t) for t in texts]) if texts else np.zeros((0, N_FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to ``PRIOR``."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (label - p)) - RIDGE * (w - PRIOR)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


# --- learning -----------------------------------------------------------------------


def _terms_of(text: str | None) -> set[str]:
    out: set[str] = set()
    for piece in _stretches(text) if text else ():
        for w in set(_WORD.findall(piece.lower())):
            w = w.rstrip("!*$@_")
            if 2 < len(w) <= 40:
                out.add(w)
            out.update(w[:k] + "*" for k in range(MIN_STEM, min(MAX_STEM, len(w) - 1) + 1))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per term in how many documents of each half and label it occurs."""
    held: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(t, *(c[i] for i in range(4))) for t, c in held.items()]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["term", "c0", "t0", "c1", "t1"])

    for batch in batches:
        for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for term in _terms_of(text):
                held.setdefault(term, Counter())[2 * half + toxic] += 1
            if len(held) > 200_000:
                yield flush()
                held = {}
    if held:
        yield flush()


def _sample(docs: DataFrame, labels: DataFrame, learnable: Column | None, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    known = labels if learnable is None else labels.filter(learnable)
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    some = None
    for q in (0, 1):
        one = known.filter(F.col("toxic") == q).orderBy(F.xxhash64(F.lit("toxic"), F.col("doc_id").cast("string")), "doc_id").limit(per_label)
        some = one if some is None else some.unionByName(one)
    near = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 * per_label label rows
    place = F.xxhash64(F.lit("toxic"), F.col("doc_id").cast("string"), F.col("text"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("toxic").orderBy(place, "doc_id"))).filter(F.col("n") <= per_label)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id").cast("string")), F.lit(2)).cast("int")
    near = near.select("text", "toxic", half.alias("half"), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return scratch.written(near, "toxic-sample"), total


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A lexicon and a logistic model from a bounded sample of labelled documents."""
    sample, total = _sample(docs, labels, learnable, per_label)
    n = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}  # four rows at most
    size = lambda toxic, halves=(0, 1): sum(n.get((h, toxic), 0) for h in halves)
    if not size(0) or not size(1):
        return Model()
    counts = arrow.mapped(sample.select("text", "toxic", "half"), "term string, c0 long, t0 long, c1 long, t1 long", _count)
    counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    share = size(1) / (size(0) + size(1))
    ahead = (F.col("t0") + F.col("t1")) - share * (F.col("c0") + F.col("c1") + F.col("t0") + F.col("t1"))
    lift = ahead / F.sqrt(F.col("c0") + F.col("c1") + F.col("t0") + F.col("t1"))
    best = counts.filter(F.col("t0") + F.col("t1") >= MIN_DOCS).filter(ahead > 0).orderBy(lift.desc(), "term").limit(20 * TERMS)
    rows = best.collect()  # at most 20 * TERMS
    of = {
        0: chosen([(r.term, r.t0, r.c0) for r in rows], size(1, (0,)), size(0, (0,))),
        1: chosen([(r.term, r.t1, r.c1) for r in rows], size(1, (1,)), size(0, (1,))),
    }
    terms = chosen([(r.term, r.t0 + r.t1, r.c0 + r.c1) for r in rows], size(1), size(0))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {h: Lexicon(t) for h, t in of.items()}
        for batch in batches:
            text, toxic, half, doc = (batch.column(i).to_pylist() for i in range(4))
            x = [features(held[1 - h], t).tobytes() for t, h in zip(text, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(toxic, pa.int32()), pa.array(x, pa.binary())], ["doc_id", "toxic", "x"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = arrow.mapped(sample, f"doc_id {kind}, toxic int, x binary", columns).collect()  # at most 2 * per_label rows of N_FEATURES numbers
    got.sort(key=lambda r: (str(r.doc_id), r.toxic, bytes(r.x)))
    scratch.discard(sample)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), float).reshape(-1, N_FEATURES)
    label = np.array([r.toxic for r in got])
    weight = np.where(label == 1, total[1] / size(1), total[0] / size(0))
    return Model(terms, fit(x, label, weight * len(label) / weight.sum()))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` without their texts, with a toxicity score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms
    held: list[Lexicon] = []

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Lexicon(shared.value.terms))
        column = batch.column(batch.schema.get_field_index(text))
        parts = [shared.value.scores(column.slice(a, b - a).to_pylist(), held[0]) for a, b, _, _ in arrow.slices(column)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

    return arrow.with_columns(docs, [T.StructField(to, T.DoubleType())], columns, read_only=(text,))


def toxicity(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_label: int = PER_LABEL) -> DataFrame:
    """``docs`` with ``score``, by a model learned from ``labels`` (``doc_id``, ``toxic``)."""
    return score(docs, train(docs, labels, learnable, per_label))
