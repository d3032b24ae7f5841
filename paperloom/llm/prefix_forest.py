"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt to blocks of about ``BLOCK`` rows. A block holds a forest of
``TREES`` trees; a tree is the sorted array of long bit strings, one per
distinct vector, whose bits say on which side of the block's median a random
projection falls. A query descends every tree by binary search to its longest
matching prefix, and then all trees ascend together, bit by bit: at each prefix
length the vectors that share that prefix in any tree become candidates, until
there are enough (``SHARE`` of the block's distinct vectors, ``LEAST`` at any
rate). Distances of candidates are exact; a block sends on its best rows only,
and they are merged by query.

How large ``SHARE`` must be depends on the data: vectors without clusters have
no near neighbours to speak of, and any index must then look at much of them.

Queries are sent to every block in the shuffle that deals the rows, sorted
behind the block's vectors: a task builds a forest once, streams the queries
past it and drops it at the next block. Nothing is broadcast and no vector
reaches the driver. Equal vectors are one entry of the forest with all their
ids, so a vector that many rows share neither crowds out others nor loses a tie.

Defined cases: ``vec_id`` is of an integer type (any other raises); query rows
that share an id are one query at several places: each is searched, and a row
found from several has the smallest distance; vectors that are null, empty, all zero, of another length than
most, or that hold null or non-finite components take no part; a row is no
candidate for a query of its own id; ties go to the smaller id; rows with null
id take no part; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import arrow

TREES = 48
BITS = 40
BLOCK = 25_000
SHARE = 0.5
LEAST = 300
TOP = 10
SEED = 11


class PrefixForest:
    """The forest of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.vectors, self.of = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(self.of, kind="stable")  # ids of an entry stay ascending
        self.ids, self.first = ids[by], np.searchsorted(self.of[by], np.arange(len(self.vectors) + 1))
        self.repeated = set(ids[1:][ids[1:] == ids[:-1]].tolist())
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, vectors.shape[1], bits))
        self.bits, self.middle, self.sorted, self.order = bits, [], [], []
        for t in range(trees):
            side = self.vectors @ self.planes[t]
            self.middle.append(np.median(side, axis=0))
            code = self._codes(side, t)
            at = np.argsort(code, kind="stable")
            self.order.append(at)
            self.sorted.append(code[at])

    def _codes(self, side: np.ndarray, t: int) -> np.ndarray:
        return (side > self.middle[t]).astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def ranges(self, queries: np.ndarray) -> np.ndarray:
        """Per query, tree and prefix length, the run of entries that share the prefix."""
        shift = np.arange(self.bits, -1, -1, dtype=np.uint64)  # prefix lengths 0..bits
        out = np.empty((len(queries), len(self.sorted), self.bits + 1, 2), np.int32)
        for t, codes in enumerate(self.sorted):
            low = (self._codes(queries @ self.planes[t], t)[:, None] >> shift) << shift
            high = low | ((np.uint64(1) << shift) - np.uint64(1))
            out[:, t, :, 0] = np.searchsorted(codes, low, "left")
            out[:, t, :, 1] = np.searchsorted(codes, high, "right")
        return out

    def candidates(self, runs: np.ndarray, enough: int) -> np.ndarray:
        """Entries met while all trees ascend together from their longest matches."""
        met = np.zeros(len(self.vectors), bool)
        if enough >= len(met):
            return np.arange(len(met))
        done = np.zeros((len(runs), 2), np.int32)
        done[:] = runs[:, -1, :1]
        for length in range(self.bits, -1, -1):
            now = runs[:, length]
            for t in np.flatnonzero((now[:, 0] < done[:, 0]) | (now[:, 1] > done[:, 1])).tolist():
                met[self.order[t][now[t, 0] : done[t, 0]]] = True
                met[self.order[t][done[t, 1] : now[t, 1]]] = True
            done = now
            if np.count_nonzero(met) >= enough:
                break
        return np.flatnonzero(met)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, top: int = TOP, share: float = SHARE, least: int = LEAST) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per query row its nearest rows among the candidates, as ids, distances, and their places here."""
        enough = max(least, int(np.ceil(share * len(self.vectors))))
        for at in range(0, len(queries), 128):
            some = queries[at : at + 128]
            runs = self.ranges(some) if enough < len(self.vectors) else [None] * len(some)
            for q, name, run in zip(some, query_ids[at : at + 128].tolist(), runs, strict=True):
                entry = self.candidates(run, enough)
                far = np.sqrt(((self.vectors[entry] - q) ** 2).sum(1))
                own = self.first[entry + 1] - self.first[entry]
                if name in self.repeated:  # rows of the query's own id must not use up the nearest entries
                    own = own - np.array([np.count_nonzero(self.ids[self.first[e] : self.first[e + 1]] == name) for e in entry])
                    entry, far, own = entry[own > 0], far[own > 0], own[own > 0]
                if len(far) > top + 1:
                    edge = np.partition(far, top)[top]  # one entry may be the query's own row
                    entry, far = entry[far <= edge], far[far <= edge]
                place = np.concatenate([np.arange(self.first[e], self.first[e + 1]) for e in entry] or [self.first[:0]])
                dist = np.repeat(far, self.first[entry + 1] - self.first[entry])
                keep = self.ids[place] != name
                place, dist = place[keep], dist[keep]
                best = np.lexsort((self.ids[place], dist))[:top]
                yield name, self.ids[place[best]], dist[best], place[best]


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows that take part."""
    arrow.check_integer(df, vec_id)
    v = F.col("embedding")
    good = (
        v.isNotNull()
        & F.col("vec_id").isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0.0)
    )
    cast = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = cast.filter(F.coalesce(good, F.lit(False)))
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (most["n"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """Stretches of a sorted batch of one block and kind, as block, whether queries, ids and vectors."""
    block, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (asked[1:] != asked[:-1])) + 1
    for first, after in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if first < after:
            some = batch.slice(first, after - first)
            yield int(block[first]), bool(asked[first]), some.column(2).to_numpy(zero_copy_only=False), _matrix(some.column(3))


def nearest(rows: DataFrame, is_query: Column, top: int = TOP, share: float = SHARE, least: int = LEAST, block: int = BLOCK, trees: int = TREES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest rows found for every query row."""
    rows = usable(rows)
    blocks = max(1, -(-rows.count() // block))
    entries = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("asked"), "vec_id", "embedding")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    asked = rows.filter(is_query).distinct().select(everywhere.alias("block"), F.lit(1).alias("asked"), "vec_id", "embedding")
    dealt = entries.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for batch in batches:
            for block, asked, ids, vectors in _runs(batch):
                if block != now:
                    now, held, forest = block, [], None
                if not asked:
                    held.append((ids, vectors))
                    continue
                if forest is None:
                    if not held:
                        continue  # no row was dealt to this block
                    forest, held = PrefixForest(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), trees), []
                out = list(forest.search(ids, vectors, top, share, least))
                found, far, place = (np.concatenate([x[k] for x in out]) for k in (1, 2, 3))
                of = np.repeat([x[0] for x in out], [len(x[1]) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(found, pa.int64()), pa.array(far, pa.float64()), pa.array(place, pa.int64())], ["query_id", "vec_id", "score", "place"])

    found = arrow.mapped(dealt, "query_id long, vec_id long, score double, place long", run)
    # rows of one id lie in one block, so id and place tell rows apart; a row met from several places counts once
    found = found.repartition("query_id").groupBy("query_id", "vec_id", "place").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
