"""Mixing sources to target weights by iterative proportional fitting.

Token counts are aggregated into cells (source x language x topic). Raking
multiplies the cells' weights, margin by margin, until the weighted tokens of
every source, language and topic have the target shares. Documents are then
sampled, each with its cell's probability ``min(1, keep * weight)``. The bound
is part of the raking: a margin's factor is the one under which the *bounded*
probabilities give ``keep`` times all tokens in the target shares, so what cells
at 1 lack comes from the other cells of the same value. The draw is a hash of
the document, so a repeated run takes the same ones.

A value whose target is more tokens than it has is taken whole, and the rest of
its margin scaled up to ``keep`` (``reachable``); such values, and margins that
cannot all be met at once, are logged, and ``shares`` gives wanted and reached.

Targets default to the observed shares, flattened by the exponents of
``FLATTEN``; ``targets`` gives other shares by margin and value. Up to
``MAX_CELLS`` cells are raked by the driver, which sees no more than the cells;
more are raked by joins, written each round.

Defined cases: null source or language is the value ``(none)``; null or empty
text has no tokens, topic ``brief``, and its cell's probability; equal rows
share their fate; target shares of values that do not occur are left out and
the rest scaled, and if none occurs all values get equal shares; other columns
pass through, whatever their names, except that ``topic``, ``n_tokens``,
``weight`` and ``probability`` are replaced.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm import scratch

LOG = logging.getLogger(__name__)
MARGINS = ("source", "lang", "topic")
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.9}
KEEP = 0.7
ROUNDS = 50
TOLERANCE = 1e-6
MAX_CELLS = 200_000
#: Weights are held below this where margins cannot all be met; and a share off by more than this part is logged.
MOST_WEIGHT = 1e30
OFF = 0.001
NONE = "(none)"
ADDED = ("topic", "n_tokens", "weight", "probability")


def n_tokens(text: Column) -> Column:
    """Words, as runs between blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of text, where the corpus has no topics of its own."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    times = lambda c: size - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (
        F.when(size < 300, "brief")
        .when(times("|") * 40 > size, "table")
        .when(times("!") * 20 > size, "loud")
        .when(times("\n") * 250 > size, "lines")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with ``topic`` and ``n_tokens``."""
    return docs.drop(*ADDED).withColumns({"topic": topic(F.col("text")), "n_tokens": n_tokens(F.col("text"))})


def _keys(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias(f"_{m}") for m in MARGINS]


def cells(docs: DataFrame) -> DataFrame:
    """Tokens by cell; ``_source``, ``_lang``, ``_topic``, ``tokens``."""
    return docs.groupBy(*_keys(docs)).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def target_shares(totals: dict, alpha: float, wanted: dict | None) -> dict:
    """The share of every value that occurs."""
    if wanted is not None:
        shares = {k: float(wanted.get(k, 0.0)) for k in totals}
    else:
        whole = sum(totals.values()) or 1.0
        shares = {k: (v / whole) ** alpha if v else 0.0 for k, v in totals.items()}
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()} if total else dict.fromkeys(totals, 1 / max(1, len(totals)))


def rake(table: pd.DataFrame, targets: dict[str, dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights under which every margin's weighted tokens have the target shares."""
    tokens = table["tokens"].to_numpy(float)
    whole, weight = tokens.sum(), np.ones(len(table))
    codes = []
    for m in MARGINS:
        values, code = np.unique(table[f"_{m}"].to_numpy(str), return_inverse=True)
        codes.append((code, np.array([targets[m].get(v, 0.0) for v in values]) * whole))
    for _ in range(rounds):
        worst = 0.0
        for code, want in codes:
            have = np.bincount(code, tokens * weight, len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            weight = weight * factor[code]
        if worst < tolerance:
            break
    return weight


def calibrated(weight: np.ndarray, tokens: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities ``min(1, c * weight)`` that keep the given part of all tokens."""
    want, low, high = keep * tokens.sum(), 0.0, 1.0
    while (np.minimum(1, high * weight) * tokens).sum() < want and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * weight) * tokens).sum() < want else (low, mid)
    return np.minimum(1, high * weight)


def reachable(want: np.ndarray, have: np.ndarray) -> np.ndarray:
    """``want`` with no value above the tokens it has, the others scaled up to the same sum."""
    out, whole = np.minimum(want, have), min(want.sum(), have[want > 0].sum())
    for _ in range(len(want)):
        free = (out < have) & (want > 0)
        left = whole - out[~free].sum()
        if not free.any() or abs(out[free].sum() - left) <= 1e-12 * whole:
            break
        out[free] = np.minimum(want[free] * (left / want[free].sum()), have[free])
    return out


def bounded(table: pd.DataFrame, targets: dict[str, dict], keep: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights under which ``min(1, keep * weight)`` keeps every margin's target tokens.

    The factor of a value solves ``sum(tokens * min(1, factor * w)) = target``: of
    all sets of its cells the cells at 1 are the ones with the largest factor,
    and these are the first cells in descending order of weight.
    """
    tokens = table["tokens"].to_numpy(float)
    w, margins = np.full(len(table), float(keep)), []
    for m in MARGINS:
        values, code = np.unique(table[f"_{m}"].to_numpy(str), return_inverse=True)
        want = np.array([targets[m].get(v, 0.0) for v in values]) * keep * tokens.sum()
        margins.append((code, reachable(want, np.bincount(code, tokens, len(values)))))
    for _ in range(rounds):
        worst = 0.0
        for code, want in margins:
            have = np.bincount(code, tokens * np.minimum(1, w), len(want))
            off = np.divide(have, want, out=np.ones_like(want), where=want > 0)
            worst = max(worst, float(np.abs(off - 1).max(initial=0)), float((have[want == 0] > 0).any()))
            order = np.lexsort((-w, code))
            at, t = code[order], tokens[order]
            first = np.searchsorted(at, np.arange(len(want)))
            ones, free = np.cumsum(t) - t, np.cumsum((t * w[order])[::-1])[::-1]
            ones, free = ones - ones[first][at], free - np.append(free, 0.0)[np.append(first, len(at))[1:]][at]
            some = t * w[order] > 0
            factor = np.full(len(want), -np.inf)
            np.maximum.at(factor, at[some], (want[at] - ones)[some] / np.maximum(free, (t * w[order]))[some])
            w = np.minimum(w * np.where(np.isfinite(factor), factor, 1.0)[code], MOST_WEIGHT)
        if worst < tolerance:
            break
    return w / keep if keep else w


def _rake_joined(table: DataFrame, targets: dict[str, DataFrame], keep: float, rounds: int, tolerance: float) -> DataFrame:
    """``bounded`` for more cells than a driver should hold."""
    whole, want = table.agg(F.sum("tokens")).first()[0] or 0.0, {}
    for m in MARGINS:
        have = table.groupBy(f"_{m}").agg(F.sum("tokens").alias("_all"))
        now = have.join(targets[m], f"_{m}", "left").select(f"_{m}", "_all", (F.coalesce("_share", F.lit(0.0)) * keep * whole).alias("_raw"))
        now = now.withColumn("_want", F.least("_raw", "_all"))
        for at in range(rounds):  # as in reachable
            now = scratch.written(now, f"reach-{m}-{at}")
            free = (F.col("_want") < F.col("_all")) & (F.col("_raw") > 0)
            got = now.agg(F.sum("_raw"), F.sum(F.when(F.col("_raw") > 0, F.col("_all"))), F.sum(F.when(~free, F.col("_want"))), F.sum(F.when(free, F.col("_want"))), F.sum(F.when(free, F.col("_raw")))).first()
            most, full, taken, rest, raw = (v or 0.0 for v in got)
            left = min(most, full) - taken
            if not raw or abs(rest - left) <= 1e-12 * min(most, full):
                break
            now = now.withColumn("_want", F.when(free, F.least(F.col("_raw") * F.lit(left / raw), F.col("_all"))).otherwise(F.col("_want")))
        want[m] = now.select(f"_{m}", "_want")
    now = table.withColumn("weight", F.lit(float(keep)))
    for at in range(rounds):
        for m in MARGINS:
            down = Window.partitionBy(f"_{m}").orderBy(F.desc("weight"), *[f"_{n}" for n in MARGINS])
            here = F.col("tokens") * F.col("weight")
            ones = F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
            ranked = now.join(want[m], f"_{m}").select(f"_{m}", "tokens", "weight", "_want", here.alias("_here"), ones.alias("_ones"), F.sum(here).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_free"))
            factor = ranked.groupBy(f"_{m}").agg(
                F.max(F.when(F.col("_here") > 0, (F.col("_want") - F.col("_ones")) / F.col("_free"))).alias("_factor"),
                F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight"))).alias("_have"),
                F.max("_want").alias("_want"),
            )
            off = F.when(F.col("_want") > 0, F.abs(F.col("_have") / F.col("_want") - 1)).otherwise((F.col("_have") > 0).cast("double"))
            factor = factor.select(f"_{m}", F.coalesce("_factor", F.lit(1.0)).alias("_factor"), off.alias("_off"))
            worst_now = F.greatest("_worst", "_off") if "_worst" in now.columns else F.col("_off")
            now = now.join(factor, f"_{m}").withColumns({"weight": F.least(F.lit(MOST_WEIGHT), F.col("weight") * F.col("_factor")), "_worst": worst_now}).drop("_factor", "_off")
            now = scratch.written(now, f"rake-{at}-{m}")
        done = (now.agg(F.max("_worst")).first()[0] or 0.0) < tolerance
        now = now.select(*[f"_{m}" for m in MARGINS], "tokens", "weight")
        if done:
            break
    return now.select(*[f"_{m}" for m in MARGINS], (F.col("weight") / (keep or 1.0)).alias("weight"), F.least(F.lit(1.0), F.col("weight")).alias("probability"))


def shares(table: pd.DataFrame, targets: dict[str, dict]) -> pd.DataFrame:
    """``margin``, ``value``, ``wanted`` and ``reached`` share of the sample's expected tokens."""
    kept = table["tokens"] * table["probability"]
    rows = [(m, v, targets[m].get(v, 0.0), k / (kept.sum() or 1.0)) for m in MARGINS for v, k in kept.groupby(table[f"_{m}"]).sum().items()]
    return pd.DataFrame(rows, columns=["margin", "value", "wanted", "reached"])


def mixture(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, flatten: dict[str, float] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Per cell its ``weight`` and sampling ``probability``."""
    spark, targets, flatten = docs.sparkSession, targets or {}, flatten or FLATTEN
    table = scratch.written(cells(docs), "cells")
    names = [f"_{m}" for m in MARGINS]
    if table.count() <= max_cells:
        got = table.toPandas().sort_values(names, ignore_index=True)
        wanted = {m: target_shares(got.groupby(f"_{m}")["tokens"].sum().to_dict(), flatten[m], targets.get(m)) for m in MARGINS}
        got["weight"] = bounded(got, wanted, keep)
        got["probability"] = np.minimum(1, keep * got["weight"])
        for r in shares(got, wanted).itertuples():
            if abs(r.reached - r.wanted) > OFF * r.wanted:
                LOG.warning("%s %s: share %.4f wanted, %.4f reached", r.margin, r.value, r.wanted, r.reached)
        rows = got[[*names, "weight", "probability"]]
        return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", weight double, probability double"))
    wanted = {}
    for m in MARGINS:
        if m in targets:
            rows = [(str(k), float(v)) for k, v in targets[m].items()]
            want = spark.createDataFrame(rows, f"_{m} string, _raw double").join(table.select(f"_{m}").distinct(), f"_{m}", "left_semi")
        else:
            want = table.groupBy(f"_{m}").agg(F.pow(F.sum("tokens"), F.lit(flatten[m])).alias("_raw"))
        total = want.agg(F.sum("_raw")).first()[0]
        if total:
            wanted[m] = want.select(f"_{m}", (F.col("_raw") / total).alias("_share"))
        else:  # no target occurs: equal shares
            values = table.select(f"_{m}").distinct()
            wanted[m] = values.withColumn("_share", F.lit(1.0 / max(1, values.count())))
    return _rake_joined(table, wanted, keep, ROUNDS, TOLERANCE)


def sample(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, seed: int = 0, **options) -> DataFrame:
    """The sampled documents, with ``topic``, ``n_tokens``, ``weight`` and ``probability``."""
    told = described(docs)
    mixed = mixture(told, keep, targets, **options).select(*[F.col(f"_{m}").alias(f"_key{i}") for i, m in enumerate(MARGINS)], "weight", "probability")
    draw = F.pmod(F.xxhash64(F.lit(seed), told["doc_id"], told["text"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
    keys = [k.alias(f"_own{i}") for i, k in enumerate(_keys(told))]
    keyed = told.select(F.struct(*[told[c] for c in told.columns]).alias("_row"), draw.alias("_draw"), *keys)
    met = keyed.join(mixed, [keyed[f"_own{i}"] == mixed[f"_key{i}"] for i in range(len(MARGINS))]).filter(F.col("_draw") < F.col("probability"))
    return met.select(*[F.col("_row")[c].alias(c) for c in told.columns], "weight", "probability")
