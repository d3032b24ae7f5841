"""SimHash near-dedup at a Jaccard similarity, checked on whole sets.

Two documents are linked where their sets of ``SHINGLE``-word shingles have a
Jaccard similarity of at least ``LEAST``, which is checked on the whole sets.
Candidates are, first, the links that the Gray-order index finds between the
SimHash fingerprints of the sets. A similarity of 0.8 makes two fingerprints
differ in ten bits of 64 on average, where the index drops hardly a group, so
its radius stays at three bits; what lies beyond comes from min-hash bands: of
``BANDS`` bands of ``ROWS`` minima each, a linked pair agrees in one but for a
probability of ``(1 - LEAST ** ROWS) ** BANDS``, 3.7e-7 at the threshold itself
and less above it.

Only distinct sets take part; copies are one value. Of the sets of a fingerprint
the smallest stands for all in the index's links, and of a bucket (a band's value)
each member is first checked against the bucket's smallest, so a large group of
near copies gives a number of pairs linear in its size. Where a bucket is then not of one component, the
members outside its largest component are checked against all others, in chunks
of ``CHUNK`` members of which two meet in a task of their own, so no link is
missed and no task is given an unbounded bucket.

Defined cases: null and blank text has the empty set, one group; a text of
fewer words than a shingle is one shingle; rows with the same or with null
``doc_id`` are separate documents, told apart by id and 128 bits of the text,
and a group of null ids only has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm import arrow, scratch, simhash_index
from paperloom.llm.components import components

SHINGLE = 5
LEAST = 0.8
SEED = 42
ROWS = 4
BANDS = 28
CHUNK = 500
#: Bytes of a shingle's hash that are sent.
WIDTH = 6
#: Shingles per column block of a product, and per block that minima are taken of.
SLAB = 2048
BLOCK = 128
#: Keys of texts to fetch or to drop are broadcast up to this size on disk; beyond it Spark's own threshold decides.
BROADCAST_BYTES = 8 << 20

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SET = [T.StructField("fp", T.LongType()), T.StructField("grams", T.BinaryType())]
_KEYS = [T.StructField("fp", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]


def _joined(words: np.ndarray, n: int, shingle: int) -> np.ndarray:
    """Hashes of ``n`` runs of ``shingle`` words, from the words' hashes."""
    x = np.full(n, shingle, np.uint64)
    for i in range(shingle):
        x = (x + words[i : i + n]) * _STEP  # the place of a word is the power of its factor
        x ^= x >> np.uint64(32)
    return x


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; every word is hashed once."""
    text, at, words, out = text.lower(), 0, np.zeros(0, np.uint64), []  # on bytes: A-Z only
    while at < len(text):
        end = simhash_index._BLANK.search(text, at + simhash_index.STRETCH)
        to = end.start() if end else len(text)
        found = text[at:to].split()
        words, at = np.concatenate([words, np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))]), to
        n = len(words) - shingle + 1
        if n > 0:
            out.append(_joined(words, n, shingle))
            words = words[n:]
    if len(words) and not out:
        out.append(_joined(words, 1, len(words)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _fp(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def _packed(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a set of ``_packed``."""
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return np.unique(wide.view("<u8").reshape(-1))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key per band; none for the empty set."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    low = grams.astype(np.uint32)  # odd multiples and sums permute 32-bit values
    least, held = np.full(ROWS * BANDS, np.iinfo(np.uint32).max), np.empty((min(BLOCK, len(low)), ROWS * BANDS), np.uint32)
    for at in range(0, len(low), BLOCK):
        some = low[at : at + BLOCK, None]
        moved = np.multiply(some, _TIMES, out=held[: len(some)])
        np.minimum(least, np.add(moved, _PLUS, out=moved).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for first, after, raw, off in arrow.slices(batch.column(batch.schema.get_field_index("text"))):
        for i in range(after - first):
            yield shingles(raw[off[i] : off[i + 1]].tobytes())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``fp``, a hash of the set of shingles, ``sim``, its fingerprint, its ``size`` and the ``keys`` of its bands."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        fps, sims, sizes, keys = [], [], [], []
        for grams in _each(batch):
            fps.append(_fp(grams))
            sims.append(simhash_index.bits_of(grams[at : at + SLAB] for at in range(0, len(grams), SLAB)))
            sizes.append(len(grams))
            keys.append(band_keys(grams))
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return [_longs(fps), _longs(sims), _longs(sizes), pa.ListArray.from_arrays(ends, flat.view(np.int64))]

    return arrow.with_columns(docs, _KEYS, columns, ("text",))


def _sets(texts: DataFrame) -> DataFrame:
    """``fp`` and ``grams`` (the set's bytes) of every text."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        grams = list(_each(batch))
        return [_longs([_fp(g) for g in grams]), pa.array([_packed(g) for g in grams], pa.binary())]

    return arrow.with_columns(texts, _SET, columns, ("text",)).select("fp", "grams")


def _is_near(shared: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return shared >= LEAST * (one + other - shared) - 1e-9


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of rows ``a, b, x, y`` (two sets and their bytes) that are near."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            g, h = _unpacked(x[i].as_py()), _unpacked(y[i].as_py())
            if min(len(g), len(h)) >= LEAST * max(len(g), len(h)) - 1e-9:
                keep[i] = _is_near(len(np.intersect1d(g, h, assume_unique=True)), len(g), len(h))
        yield batch.select([0, 1]).filter(pa.array(keep))


def spanning_links(fps: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Pairs whose components are those of all near pairs of the given sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], float)
    of = np.repeat(np.arange(n), sizes.astype(int))
    found, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # a shingle of one set is in no intersection
    some = times[place] > 1
    of, place = of[some], column[place[some]]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    shared = np.zeros((n, n))
    for at in range(0, int((times > 1).sum()), SLAB):
        low, high = np.searchsorted(place, [at, at + SLAB])
        part = np.zeros((n, SLAB), np.float32)
        part[of[low:high], place[low:high] - at] = 1
        shared += part @ part.T
    near, left, out = _is_near(shared, sizes[:, None], sizes), np.ones(n, bool), []
    for i in range(n):
        if left[i]:
            left[i], edge = False, np.array([i])
            while len(edge):
                edge = np.flatnonzero(near[edge].any(0) & left)
                left[edge] = False
                out += [(fps[i], fps[j]) for j in edge]
    return np.array(out, np.int64).reshape(-1, 2)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within buckets of rows ``key, part, fp, grams``; rows come sorted by bucket."""

    def links(rows: dict[int, bytes]) -> pa.RecordBatch:
        found = spanning_links(np.array(list(rows), np.int64), [_unpacked(g) for g in rows.values()])
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    at, rows = None, {}
    for batch in batches:
        for key, part, fp, grams in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (key, part) != at:
                if len(rows) > 1:
                    yield links(rows)
                at, rows = (key, part), {}
            rows[fp] = grams
    if len(rows) > 1:
        yield links(rows)


def _gray_pairs(values: DataFrame) -> DataFrame:
    """Pairs of sets ``(a, b)`` that the Gray-order index links: fewer than two for every distinct set.

    Each fingerprint is represented by its smallest set, which meets the others of
    the fingerprint, and those of the fingerprints that the index links it to.
    """
    found = simhash_index.links(values.select(F.col("sim").alias("fp")).distinct())
    reps = scratch.written(values.groupBy("sim").agg(F.min("fp").alias("rep"), F.count("*").alias("n")), "gray-values")
    one = lambda to: reps.select(F.col("sim").alias(f"_{to}"), F.col("rep").alias(to))
    linked = found.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(one("a"), "_a").join(one("b"), "_b").select("a", "b")
    equal = values.join(reps.filter("n > 1"), "sim").filter("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    both = linked.unionByName(equal)
    return scratch.written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "gray-pairs")


def _small(keys: DataFrame) -> DataFrame:
    """A table of ``scratch.written``, to be broadcast if its size on disk is within the bound."""
    return F.broadcast(keys) if scratch.bytes_of(keys) <= BROADCAST_BYTES else keys


def _links(values: DataFrame, docs: DataFrame, chunk: int) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all near pairs of the distinct ``fp``."""
    spark = values.sparkSession
    dealt = values.select("fp", F.explode("keys").alias("key"))
    gray = _gray_pairs(values)
    # most keys are of one set: they are counted alone, and only sets of the others travel
    shared = scratch.written(dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "jaccard-keys")
    met = scratch.written(dealt.join(shared, "key"), "jaccard-met")
    buckets = met.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("rep"), F.bit_xor(F.xxhash64("fp")).alias("sig"))
    buckets = buckets.groupBy("n", "rep", "sig").agg(F.min("key").alias("key")).drop("sig")  # near copies share many bands: one bucket of each membership
    members = scratch.written(met.join(scratch.written(buckets, "jaccard-buckets"), "key"), "jaccard-members")
    # written, so that Spark knows how small these tables are and need not move texts or sets to them
    ends = members.select("fp").unionByName(gray.select(F.col("a").alias("fp"))).unionByName(gray.select(F.col("b").alias("fp"))).distinct()
    wanted = scratch.written(values.join(ends, "fp").select("th").distinct(), "jaccard-wanted")
    own = docs.withColumn("th", F.xxhash64("text")).join(_small(wanted), "th", "left_semi")
    sets = scratch.written(_sets(own.select("text").distinct()), "jaccard-sets")
    side = lambda fp, to: sets.select(F.col("fp").alias(fp), F.col("grams").alias(to))
    size = lambda fp, to: values.select(F.col("fp").alias(fp), F.col("size").alias(to))
    pairs = members.filter("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b")).unionByName(gray).distinct()
    pairs = pairs.join(size("a", "m"), "a").join(size("b", "n"), "b").filter(F.least("m", "n") >= LEAST * F.greatest("m", "n") - 1e-9)
    pairs = scratch.written(pairs.select("a", "b"), "jaccard-pairs")
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    near = scratch.written(arrow.mapped(met, "a long, b long", _checked), "jaccard-stars")
    of = components(near)
    now = members.filter("n > 2").join(of, members["fp"] == of["node"], "left").select("key", "fp", F.coalesce("component", "fp").alias("part"))
    now = scratch.written(now.join(size("fp", "size"), "fp"), "jaccard-now")
    sizes = now.groupBy("key", "part").agg(F.count("*").alias("c"), F.min("size").alias("low"), F.max("size").alias("high"))
    main = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("_main"), F.max("c").alias("_c"), F.sum("c").alias("_n"), F.count("*").alias("_k"))
    is_main = F.col("part") == F.col("_main")
    span = lambda of_main: [f(F.when(is_main == of_main, F.col(c))).alias(f"_{c}_{of_main}") for f, c in ((F.min, "low"), (F.max, "high"))]
    mixed = sizes.join(main.filter("_k > 1"), "key").groupBy("key", "_main", "_c", "_n", "_k").agg(*span(True), *span(False))
    fits = lambda of_main: (F.col("size") >= LEAST * F.col(f"_low_{of_main}") - 1e-9) & (LEAST * F.col("size") - 1e-9 <= F.col(f"_high_{of_main}"))
    # sets whose sizes alone rule out every set they would meet stay away
    some = F.when(is_main, fits(False)).otherwise((F.col("_k") > 2) | fits(True))
    chunks = lambda c: F.ceil(c / chunk).cast("int")
    mixed = mixed.withColumns({"p": chunks(F.col("_c")), "q": chunks(F.col("_n") - F.col("_c"))})
    rest = now.join(mixed, "key").filter(some).withColumn("own", F.pmod(F.xxhash64("fp"), F.when(is_main, F.col("p")).otherwise(F.col("q"))).cast("long"))
    task = lambda kind, x, y: (F.lit(kind) * (1 << 60) + x * (1 << 30) + y).alias("part")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(i.cast("long")))
    with_main = F.when(is_main, each(F.col("q"), lambda i: task(0, F.col("own"), i))).otherwise(each(F.col("p"), lambda m: task(0, m, F.col("own"))))
    between = F.filter(each(F.col("q"), lambda i: F.when(i != F.col("own"), task(1, F.least(i, "own"), F.greatest(i, "own")))), lambda t: t.isNotNull())
    meets = F.when(is_main, with_main).otherwise(F.concat(with_main, between))
    rest = rest.select("key", F.explode(meets).alias("part"), "fp")
    rest = scratch.written(rest, "jaccard-rest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = rest.join(sets, "fp").select("key", "part", "fp", "grams").repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    return near.unionByName(arrow.mapped(full, "a long, b long", _bucket_links))


def _keyed_groups(docs: DataFrame, chunk: int) -> DataFrame:
    """Per document ``doc_id``, two hashes of its text, ``fp``, ``part`` (its group) and ``component_id``."""
    docs = docs.select("doc_id", "text")
    hashes = {"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(1), "text")}
    told = scratch.written(keyed(docs.withColumns(hashes)).select("doc_id", "th", "th2", "fp", "sim", "size", "keys"), "jaccard")
    first = told.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("th").alias("th"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    first = scratch.written(first, "jaccard-values")
    of = components(_links(first, docs, chunk))
    grouped = first.join(of, first["fp"] == of["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("first").alias("component_id"))
    owner = scratch.written(grouped.join(smallest, "part").select(F.col("fp").alias("_fp"), "part", "component_id"), "jaccard-groups")
    return told.join(owner, told["fp"] == owner["_fp"]).select("doc_id", "th", "th2", "fp", "part", "component_id")


def near_duplicate_groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, its group's smallest id."""
    return _keyed_groups(docs, chunk).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row of ``docs`` for every group: the smallest id (null last), then the smallest hash of the text.

    The keys of the others are few beside the texts, and meet them by an
    anti-join that broadcasts them only if their written size is within
    ``BROADCAST_BYTES``. Of rows with the same id and text one stays, by a hash of the
    whole row.
    """
    key = ["doc_id", "th", "th2"]
    groups = scratch.written(_keyed_groups(docs, chunk).groupBy(*key, "part").agg(F.count("*").alias("n")), "jaccard-rows")
    best = groups.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *key, "n")).alias("k"))
    best = best.select("k.*").select(F.col("doc_id").alias("_id"), F.col("th").alias("_a"), F.col("th2").alias("_b"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_a")) & (F.col("th2") == F.col("_b"))
    gone = groups.select(*key).join(best.drop("n"), same, "left_anti")
    gone = scratch.written(gone.toDF("_id", "_a", "_b"), "jaccard-gone")
    twice = scratch.written(best.filter("n > 1").drop("n"), "jaccard-twice")
    own = [F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])]
    meets = lambda keys: docs["doc_id"].eqNullSafe(keys["_id"]) & (own[0] == keys["_a"]) & (own[1] == keys["_b"])
    alone = docs.join(_small(gone), meets(gone), "left_anti").join(twice, meets(twice), "left_anti")
    equal = docs.join(twice, meets(twice), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", *own).orderBy(F.xxhash64(*docs.columns)))
    number = arrow.unused(docs, "_n")
    return alone.unionByName(equal.withColumn(number, place).filter(F.col(number) == 1).drop(number))
