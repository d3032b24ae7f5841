"""Quality scores from preference pairs (Bradley-Terry).

Of two documents the better one is preferred with probability
``sigmoid(w . (x_better - x_worse))``; ``w`` is found by Newton steps on the
logistic loss of feature differences. Pairs are drawn from labelled documents,
each of label 1 with some of label 0. A document's raw score is ``w . x``.

Raw scores are cut at a quantile: the one at the share that label 0 has among
all learnable labels, over the raw scores of all learnable labelled documents
(both counted in distributed passes, neither on the sample). They are put on a
0..1 scale on which that cut is ``CUT``.

Features read every byte of a text, a long one in stretches: frequencies of
pairs of character classes, and how much words repeat. Neither ids nor other
columns are features.

The sample that weights are fitted to is bounded (``PER_LABEL`` documents of
each label, the first by a hash of id and text); everything else covers all
documents. Defined cases: null and empty text has features of its own and gets
a score; without labelled documents of both kinds every score is ``CUT``; null
labels and ids are ignored, every row of a repeated id is an example of its
label, and so is a document for each of several label rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm import arrow, scratch
from paperloom.llm.decontamination import word_hashes

PER_LABEL = 2000
PAIRS = 30_000
#: Pairs whose differences are held at a time.
PAIR_CHUNK = 3000
RIDGE = 1e-2
CUT = 0.3
#: Bytes whose classes are counted at a time.
STRETCH = arrow.SLICE_BYTES
#: One over the error, in ranks, of the quantile.
ACCURACY = 100_000
#: Characters with a class of their own; letters, digits and the rest have six more.
OWN_CLASS = b" \n.,!|*#$%&?'\"-:;()/"
_SIDE = 6 + len(OWN_CLASS)


def _classes() -> np.ndarray:
    table = np.full(256, 4, np.int64)  # other ASCII
    table[128:] = 3
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[np.frombuffer(OWN_CLASS, np.uint8)] = np.arange(6, _SIDE)
    return table


_CLASS = _classes()
N_FEATURES = _SIDE * _SIDE + 5


def _class_pairs(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each pair of classes follows one another in every text."""
    n = len(offsets) - 1
    out, starts = np.zeros((n, _SIDE * _SIDE)), offsets[:-1][np.diff(offsets) > 0]
    for at in range(0, len(raw), STRETCH):
        to = min(len(raw), at + STRETCH)
        kind = _CLASS[raw[at:to]]
        before = np.empty_like(kind)
        before[0], before[1:] = _CLASS[raw[at - 1]] if at else 5, kind[:-1]
        before[starts[(starts >= at) & (starts < to)] - at] = 5  # the class of a text's start
        doc = np.searchsorted(offsets, np.arange(at, to), "right") - 1 if n > 1 else np.zeros(to - at, np.int64)
        low = int(doc[0])
        rows = int(doc[-1]) - low + 1
        out[low : low + rows] += np.bincount(((doc - low) * _SIDE + before) * _SIDE + kind, minlength=rows * _SIDE * _SIDE).reshape(rows, -1)
    return out


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, N_FEATURES))
    if not len(raw):
        out[:, -1] = 1.0
        return out
    out[:, :-5] = np.sqrt(_class_pairs(raw, offsets) / np.maximum(sizes, 1)[:, None])
    words, at = word_hashes(raw, offsets)
    count = np.diff(at)
    of = np.repeat(np.arange(n), count)
    if len(words):
        same = (of[1:] == of[:-1]) & (words[1:] == words[:-1])
        order = np.lexsort((words, of))
        first = np.ones(len(words), bool)
        first[1:] = (of[order][1:] != of[order][:-1]) | (words[order][1:] != words[order][:-1])
        out[:, -5] = np.bincount(of[1:][same], minlength=n) / np.maximum(count, 1)
        out[:, -4] = np.bincount(of[order][first], minlength=n) / np.maximum(count, 1)
    out[:, -3] = np.log1p(sizes) / 10
    out[:, -2] = np.log1p(count) / 10
    out[:, -1] = sizes == 0
    return out


@dataclass
class Ranking:
    """Learned weights, and how raw scores become 0..1."""

    weights: np.ndarray
    centre: np.ndarray
    cut: float
    slope: float

    def raw(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return (features(raw, offsets) - self.centre) @ self.weights

    def scaled(self, raw_scores: np.ndarray) -> np.ndarray:
        at = np.clip(self.slope * (raw_scores - self.cut) + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-at))

    def scaled_column(self, raw_score: Column) -> Column:
        at = F.lit(self.slope) * (raw_score - F.lit(self.cut)) + F.lit(float(np.log(CUT / (1 - CUT))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), at))))


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Ranking:
    """Fit the ranking to labelled feature rows; its cut is at the share of label 0 among them."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    centre = x.mean(0) if len(x) else np.zeros(N_FEATURES)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(x.shape[1] if x.size else N_FEATURES), centre, 0.0, 0.0)
    rng, n = np.random.default_rng(seed), x.shape[1]
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(n)
    for _ in range(12):
        slope, curve = -ridge / 10 * w, ridge / 10 * np.eye(n)
        for at in range(0, pairs, PAIR_CHUNK):
            diff = x[better[at : at + PAIR_CHUNK]] - x[worse[at : at + PAIR_CHUNK]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            slope += (1 - p) @ diff / pairs
            diff *= np.sqrt(p * (1 - p) / pairs)[:, None]
            curve += diff.T @ diff
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    raw = (x - centre) @ w
    cut = float(np.quantile(raw, len(bad) / (len(good) + len(bad))))
    spread = float(np.median(raw[good]) - np.median(raw[bad]))
    return Ranking(w, centre, cut, 8.0 / max(spread, 1e-9))


def _known(labels: DataFrame, learnable: Column | None) -> DataFrame:
    """``doc_id`` and ``quality`` of the labels that may be learned from."""
    known = labels if learnable is None else labels.filter(learnable)
    return known.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_label: int = PER_LABEL, pairs: int = PAIRS) -> Ranking:
    """A ranking learned from a bounded sample of labelled documents.

    Labels are drawn first, so few texts are read; rows that repeat a drawn id
    are bounded by a second draw.
    """
    known, some = _known(labels, learnable), None
    for q in (0, 1):
        one = known.filter(F.col("quality") == q).orderBy(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")), "doc_id").limit(per_label)
        some = one if some is None else some.unionByName(one)
    near = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 2 * per_label label rows
    place = F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string"), F.col("text"))
    drawn = F.row_number().over(Window.partitionBy("quality").orderBy(place, "doc_id"))
    near = near.withColumn("n", drawn).filter(F.col("n") <= per_label).drop("n")

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [features(raw, off) for _, _, raw, off in arrow.slices(batch.column(batch.schema.get_field_index("text")))]
        return [pa.array([row.tobytes() for rows in found for row in rows], pa.binary())]

    rows = arrow.with_columns(near, [T.StructField("x", T.BinaryType())], columns)
    got = rows.select("doc_id", "quality", "x").toPandas().assign(x=lambda t: t["x"].map(bytes))  # at most 2 * per_label rows
    got = got.sort_values(["doc_id", "quality", "x"], kind="stable")
    return learn(np.frombuffer(b"".join(got["x"]), float).reshape(-1, N_FEATURES), got["quality"].to_numpy(), pairs)


def raw_scores(docs: DataFrame, ranking: Ranking, text: str = "text", to: str = "raw_score") -> DataFrame:
    """``docs`` with the unscaled score."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = [shared.value.raw(raw, off) for _, _, raw, off in arrow.slices(batch.column(batch.schema.get_field_index(text)))]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

    return arrow.with_columns(docs, [T.StructField(to, T.DoubleType())], columns)


def score(docs: DataFrame, ranking: Ranking, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a quality score between 0 and 1."""
    raw = arrow.unused(docs, "raw_score")
    found = raw_scores(docs, ranking, text, raw)
    kept = [F.col(c) for c in found.columns if c not in (raw, to)]
    return found.select(*kept, ranking.scaled_column(F.col(raw)).alias(to))


def cut_at_label_share(scored: DataFrame, labels: DataFrame, learnable: Column | None = None, raw: str = "raw_score", accuracy: int = ACCURACY) -> float | None:
    """The quantile of the labelled documents' raw scores at the share of label 0; None without both labels."""
    known = _known(labels, learnable)
    met = scored.select("doc_id", F.col(raw).alias("raw")).join(known, "doc_id")
    share = met.agg(F.avg((F.col("quality") == 0).cast("int"))).first()[0]
    if not share or share == 1:
        return None
    return met.agg(F.percentile_approx("raw", F.lit(share), F.lit(accuracy))).first()[0]


def scored_by_quantile(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, **options) -> DataFrame:
    """``docs`` without their texts, with ``score``: weights from the sample, the cut from all labelled documents."""
    ranking = train(docs, labels, learnable, **options)
    found = raw_scores(docs, ranking)
    found = scratch.written(found.drop("text"), "raw-scores")  # texts are read once, the cut needs scores only
    cut = cut_at_label_share(found, labels, learnable)
    ranking.cut = ranking.cut if cut is None else cut
    return found.select(*[c for c in found.columns if c not in ("raw_score", "score")], ranking.scaled_column(F.col("raw_score")).alias("score"))


def above_quantile(scored: DataFrame, quantile: float, score_column: str = "score", accuracy: int = 10_000) -> DataFrame:
    """The rows whose score is at least the given quantile of all scores."""
    cut = scored.agg(F.percentile_approx(score_column, quantile, accuracy)).first()[0]
    return scored.filter(F.col(score_column) >= cut) if cut is not None else scored.limit(0)
