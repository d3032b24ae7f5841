"""Operators on texts against brute force, on rows with every awkward case."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import components, decontamination, line_dedup, mixing, packing, simhash_index, suffix_dedup

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_lines", T.StringType()))])
LONG = "the quick brown fox jumps over the lazy dog and runs away from every single hound in the wide green valley below "


def rows(seed=0, n=60):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(200)]
    out = []
    for i in range(n):
        body = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(rng.integers(1, 8))]
        if i % 3 == 0:
            body.insert(int(rng.integers(0, len(body) + 1)), "  SHARED line É \t" if i % 2 else "shared LINE É")
        if i % 4 == 0:
            body.append(LONG * int(rng.integers(1, 3)))
        out.append((i, "\n".join(body), ["en", "fr", None][i % 3], ["a", "a", "a", "b", None][i % 5], "clash"))
    out += [(n, None, None, None, None), (n + 1, "", "en", "a", ""), (n + 2, "   \t", "en", "a", ""), (n + 3, "x", "en", "b", "")]
    out += [(n + 4, out[8][1], "en", "b", ""), (n + 5, out[8][1], "en", "b", ""), (n + 6, "ab" * 300, "en", "b", ""), (None, LONG * 3, "en", "b", "")]
    out += [out[3], (n + 7, "\n\n\n", "en", "a", ""), (n + 8, LONG * 400, "de", "c", ""), (n + 9, "y\x00z " * 60, "en", "c", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- line dedup ---------------------------------------------------------------


def lines_brute(table, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for at, r in enumerate(table):
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            held.setdefault(k, set()).add(at)
    out = []
    for r in table:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if not (key(x) and len(held[key(x)]) >= least)]
        out.append((r[0], len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_lines(docs, batches):
    got = line_dedup.dedup_lines(docs.drop("n_lines"), min_docs=10, batches=batches).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, lines_brute(rows(), 10)))


def test_lines_of_nothing(none):
    assert line_dedup.dedup_lines(none.drop("n_lines")).count() == 0


def test_line_key_keeps_accents_apart(spark):
    table = [(i, ["É b", "é b", "É B"][i % 3]) for i in range(9)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=6).collect()}
    assert got == {i: int(i % 3 != 1) for i in range(9)}


# --- repeated bytes -----------------------------------------------------------


def repeats_brute(table, rank=None):
    seen, out = set(), {}
    order = sorted({(r[0] if r[0] is not None else -(10**9), r[1] or "") for r in table}, key=rank)
    for i, text in order:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i if rank is None else (i, text)] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("run_bytes", [1 << 10, 16 << 20])
def test_repeats(docs, monkeypatch, run_bytes):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    got = suffix_dedup.remove_repeats(docs).collect()
    want = repeats_brute(rows())
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else -(10**9)], r.doc_id


def test_repeats_of_hot_grams_in_pieces(docs):
    want = repeats_brute(rows())
    for r in suffix_dedup.remove_repeats(docs, hot=1).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else -(10**9)], r.doc_id


def test_repeats_of_rows_that_share_an_id(spark):
    """Two texts of one id, or of none, whose 32-bit hashes are equal."""
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    seen, pair = {}, None
    many = spark.range(200_000).select(F.concat(F.lit("a text "), F.col("id").cast("string"), F.lit(" " * 3)).alias("t")).select("t", F.hash("t").alias("h"))
    for r in many.collect():
        if r.h in seen:
            pair = (seen[r.h], r.t)
            break
        seen[r.h] = r.t
    assert pair
    shared, other = word(150), word(120)
    x, y = pair[0].ljust(20), pair[1].ljust(20)  # a hash read from the front: equal states stay equal under equal ends
    table = [(1, shared), (9, x + shared), (9, y + other), (9, y + shared), (None, x + other + shared), (None, y + shared), (9, x + shared)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    place = {r.text: (r.a, r.b) for r in docs.select("text", F.xxhash64("text").alias("a"), F.hash("text").alias("b")).collect()}
    want = repeats_brute(table, rank=lambda r: (r[0], place[r[1]]))
    assert len({place[t][1] for t in (x + shared, y + shared)}) == 1
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(want[(t[0] if t[0] is not None else -(10**9), t[1])] for t in table)


def test_repeats_need_integer_ids(spark):
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_a_gram_in_many_surroundings_stays_small():
    """One range with a gram of 200,000 members: blocks of bounded memory, and exact."""
    import resource

    rng = np.random.default_rng(12)
    n = 200_000
    strings = rng.integers(97, 101, (n, suffix_dedup.WIDTH), dtype=np.uint8)
    strings[:, : 8 + suffix_dedup.GRAM] = 120
    strings[n // 2 :, 40:] = strings[: n // 2, 40:]
    strings = strings[np.argsort(strings.view(f"S{suffix_dedup.WIDTH}").reshape(-1), kind="stable")]
    shared = suffix_dedup.shared_prefixes(strings)
    rank = rng.permutation(n)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = suffix_dedup.repeated_windows(strings, shared, rank, np.zeros(n, np.uint8), np.full(n, suffix_dedup.LEFT, np.uint8))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
    pair = rank.reshape(-1, 2)
    later = np.zeros(n, bool)
    later[np.arange(0, n, 2) + pair.argmax(1)] = True
    assert (shared[1::2] == suffix_dedup.WIDTH).all() and (found == later[:, None]).all()


def test_repeats_of_nothing(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(3)
    runs, every = [], []
    for _ in range(7):
        own = sorted({bytes(rng.integers(97, 100, rng.integers(1, 40), dtype=np.uint8)) for _ in range(80)})
        shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(own, own[1:])]
        runs.append(suffix_dedup.FrontCoded(shared, [s[k:] for s, k in zip(own, shared)]))
        every += own
    got = list(suffix_dedup.LoserTree(runs))
    assert [g[3] for g in got] == sorted(every)
    for (_, _, _, a), (k, _, _, b) in zip(got, got[1:]):
        assert k == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_anchor_chunks_agree():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 5000, dtype=np.uint8)
    off = np.array([0, 30, 130, 130, 2600, 5000])
    whole = suffix_dedup.anchors(raw, off)
    try:
        suffix_dedup.CHUNK, before = 333, suffix_dedup.CHUNK
        parts = suffix_dedup.anchors(raw, off)
    finally:
        suffix_dedup.CHUNK = before
    for a, b in zip(whole, parts):
        assert np.array_equal(a, b)


# --- benchmark passages ---------------------------------------------------------


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def leaks_brute(table, items):
    out = []
    for r in table:
        own, hit, named = words(r[1]), set(), set()
        for name, text in items:
            w = words(text)
            n = min(10, len(w))
            wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    named.add(str(name))
        out.append((r[0], len(own), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_leaks(spark, docs, block_bytes):
    table = rows()
    items = [(1, LONG), (2, "nothing of the kind is anywhere in here to be found at all"), (3, "lazy Dog, and"), (4, None), (5, "  ..."), (6, table[7][1]), (7, "x"), (7, "the wide green valley")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_hits(docs, bench, block_bytes=block_bytes).select("doc_id", "n_words", "hit_words", "items").collect()
    flat = [(r[0], r[1], len(r[2] or []), r[3] or []) for r in got]
    assert sorted(map(str, flat)) == sorted(map(str, leaks_brute(table, items)))


def test_words_of_long_texts_are_hashed_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["Ab é c", "", "x" * 90, " ,. ", "word " * 30 + "tail", "é" * 40, "a b"] + ["".join(rng.choice(list("aB é."), 50)) for _ in range(20)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    whole = decontamination.word_spans(raw, off)
    assert [lower(w) for t in texts for w in words(t)] == [lower(raw[a:b].tobytes().decode()) for a, b in zip(*whole[:2])]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(decontamination, "STRETCH", size)
        for x, y in zip(whole, decontamination.word_spans(raw, off)):
            assert np.array_equal(x, y)


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_leaks_keep_columns_whatever_their_names(spark, block_bytes):
    table = [(1, LONG, 5, 6, 7, "a", "b"), (2, "clean", 5, 6, 7, "a", "b"), (None, LONG, 8, 6, 7, "a", "b")]
    docs = spark.createDataFrame(table, "doc_id long, text string, _id long, _body long, _row long, items string, n_words string")
    bench = spark.createDataFrame([(1, LONG), (2, "another item of the benchmark that is not in there")], "item_id long, text string")
    got = decontamination.find_hits(docs, bench, block_bytes=block_bytes)
    assert set(got.columns) == {*docs.columns, "hit_words"} and len(got.columns) == 8
    assert sorted((r.doc_id or 0, r._id, r._body, r._row, r.items or []) for r in got.collect()) == [(0, 8, 6, 7, ["1"]), (1, 5, 6, 7, ["1"]), (2, 5, 6, 7, [])]


def test_leaks_of_nothing(docs, none):
    empty = none.select(F.col("doc_id").alias("item_id"), "text")
    assert decontamination.find_hits(docs, empty).filter("items is not null").count() == 0
    assert decontamination.find_hits(none, empty).count() == 0


# --- near duplicates ------------------------------------------------------------


def fingerprint_brute(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text or "")) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs):
    table = rows()
    got = simhash_index.near_duplicate_groups(docs).collect()
    assert len(got) == len(table)
    fps = [fingerprint_brute(r[1]) for r in table]
    part = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    want = []
    for i, r in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if part[j] == part[i] and table[j][0] is not None]
        want.append((r[0], fps[i], min(ids) if ids else None))
    assert sorted(map(str, [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("bucket", [50, 100_000])
def test_index_joins_what_brute_force_joins(spark, bucket):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    v = base[rng.integers(0, 6, 900)]
    for _ in range(5):
        v = v ^ ((np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) * (rng.random(900) < 0.6))
    v = np.unique(v)
    frame = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = {r.node: r.component for r in components.components(simhash_index.links(frame, bucket)).collect()}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    while True:
        now = np.array([label[n].min() for n in near])
        if np.array_equal(now, label):
            break
        label = now
    ids = v.view(np.int64)
    for k in range(len(v)):
        mates = ids[label == label[k]]
        assert got.get(int(ids[k]), int(ids[k])) == int(mates.min())


def test_near_duplicates_of_nothing(none):
    assert simhash_index.near_duplicate_groups(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(80)}}


# --- packing ----------------------------------------------------------------------


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_is_lossless(docs, length):
    encoder = packing.Encoder(packing.load_ranks())
    got = packing.pack(docs, length=length, window_tokens=5000).collect()
    parts = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == length and r.position_resets == r.cu_seqlens[:-1] and r.cu_seqlens[-1] <= length
        assert (ids[r.cu_seqlens[-1] :] == packing.END_OF_TEXT).all()
        assert len(packing.position_ids(r.cu_seqlens)) == r.cu_seqlens[-1]
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    table = rows()
    for d in {r[0] for r in table}:
        same = [r[1] for r in table if r[0] == d]
        want = sorted(encoder.encode(t or "").tolist() for t in same)
        flat = sorted(x for _, p in parts[d] for x in p)
        assert flat == sorted(x for w in want for x in w)
        if len(same) == 1:
            assert [x for _, p in sorted(parts[d]) for x in p] == want[0]
    assert len({(r.shard, r.row) for r in got}) == len(got)


def test_packing_of_nothing(none):
    assert packing.pack(none).count() == 0


def test_best_fit_decreasing_is_the_textbook_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        length = int(rng.choice([1, 2, 7, 33]))
        sizes = rng.integers(1, length + 1, rng.integers(0, 60)).tolist()
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms[rooms.index(min(fit))] -= s
            else:
                rooms.append(length - s)
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(length - sum(sizes[i] for i in r) for r in got) == sorted(rooms)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))


# --- mixing ------------------------------------------------------------------------


def test_raked_margins_meet_their_targets():
    import pandas as pd

    rng = np.random.default_rng(4)
    table = pd.DataFrame([(f"s{i}", f"l{j}", f"t{k}", float(rng.integers(1, 1000))) for i in range(5) for j in range(3) for k in range(2)], columns=["_source", "_lang", "_topic", "tokens"])
    targets = {m: mixing.target_shares(table.groupby(f"_{m}")["tokens"].sum().to_dict(), 0.5, None) for m in mixing.MARGINS}
    w = mixing.rake(table, targets)
    for m in mixing.MARGINS:
        have = (table["tokens"] * w).groupby(table[f"_{m}"]).sum() / table["tokens"].sum()
        assert have.to_dict() == pytest.approx(targets[m], abs=1e-5)
    p = mixing.calibrated(w, table["tokens"].to_numpy(), 0.4)
    assert (p * table["tokens"]).sum() == pytest.approx(0.4 * table["tokens"].sum()) and p.max() <= 1


def test_bounded_margins_meet_their_targets_with_a_hot_source(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    names = [(f"s{i}", f"l{j}", f"t{k}") for i in range(6) for j in range(4) for k in range(3)]
    table = pd.DataFrame([(*n, float(rng.integers(50, 1000)) * (20 if n[0] == "s0" else 1) * (0.01 if n[1] == "l3" else 1)) for n in names], columns=["_source", "_lang", "_topic", "tokens"])
    wanted = {m: mixing.target_shares(table.groupby(f"_{m}")["tokens"].sum().to_dict(), mixing.FLATTEN[m], None) for m in mixing.MARGINS}
    table["weight"] = mixing.bounded(table, wanted, 0.7)
    table["probability"] = np.minimum(1, 0.7 * table["weight"])
    whole, got = table["tokens"].sum(), mixing.shares(table, wanted)
    assert (table["tokens"] * table["probability"]).sum() == pytest.approx(0.7 * whole, rel=1e-6) and (table["probability"] == 1).any()
    for m in mixing.MARGINS:
        have = table.groupby(f"_{m}")["tokens"].sum()
        own = got[got["margin"] == m].set_index("value")
        short = 0.7 * whole * own["wanted"] > have  # such values are taken whole, the others keep their proportions
        assert np.allclose(own["reached"][short] * 0.7 * whole, have[short], rtol=1e-4)
        scale = (own["reached"] / own["wanted"])[~short]
        assert scale.max() == pytest.approx(scale.min(), rel=1e-4) and (short.any() or scale.max() == pytest.approx(1, rel=1e-4))
    assert (0.7 * whole * got["wanted"] > 0).all() and got["value"].eq("l3").any()
    frame = spark.createDataFrame(table[["_source", "_lang", "_topic", "tokens"]])
    joined = mixing._rake_joined(frame, {m: spark.createDataFrame(list(wanted[m].items()), f"_{m} string, _share double") for m in mixing.MARGINS}, 0.7, mixing.ROUNDS, 1e-4)
    many = {(r._source, r._lang, r._topic): r.probability for r in joined.collect()}
    assert [many[n] for n in names] == pytest.approx(table["probability"].tolist(), rel=1e-3, abs=1e-3)


def test_joined_raking_gives_what_the_driver_gives(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 8)
    monkeypatch.setattr(mixing.bounded, "__defaults__", (8, mixing.TOLERANCE))
    told = mixing.described(docs)
    key = lambda r: (r._source, r._lang, r._topic)
    few = {key(r): (r.weight, r.probability) for r in mixing.mixture(told).collect()}
    many = {key(r): (r.weight, r.probability) for r in mixing.mixture(told, max_cells=0).collect()}
    assert few.keys() == many.keys()
    for k, v in few.items():
        assert many[k] == pytest.approx(v, rel=1e-4, abs=1e-5)


def test_sample_keeps_rows_and_repeats(docs, none):
    every = mixing.sample(docs, keep=1.0)
    assert set(docs.columns) <= set(every.columns)
    one, two = (sorted(map(str, mixing.sample(docs, keep=0.5).select("doc_id", "text").collect())) for _ in range(2))
    assert one == two and 0 < len(one) < len(rows())
    assert mixing.sample(none).count() == 0


# --- near duplicates by Jaccard similarity -------------------------------------------


@pytest.mark.parametrize("chunk", [7, 500])
def test_pipeline_drops_near_copies_of_80_percent(spark, monkeypatch, chunk):
    import corpus_pipeline
    from paperloom.llm import simhash_checked

    monkeypatch.setattr(simhash_checked.one_per_group, "__defaults__", (chunk,))
    rng = np.random.default_rng(9)
    word = lambda: "w%x" % rng.integers(1 << 30)
    texts = []
    for edits in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):
        base = [word() for _ in range(200)]
        texts.append(base)
        for _ in range(3):
            near = list(base)
            for at in rng.choice(200, edits, replace=False):
                near[at] = word()
            texts.append(near)
    chain = [word() for _ in range(200)]
    for _ in range(25):  # each near the one before it, the last far from the first
        texts.append(list(chain))
        for at in rng.choice(200, 4, replace=False):
            chain[at] = word()
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(part) and len(kept) < len(texts) / 2


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    import corpus_pipeline

    base = " ".join(f"w{i}" for i in range(100))
    near = base + " tail"
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base, "en", "s", 1), (1, other, "en", "s", 2), (1, near, "en", "s", 3), (2, base, "en", "s", 4), (None, other, "en", "s", 5), (None, "one alone", "en", None, 6), (None, "one alone", "en", None, 6), (3, "two alone", None, "s", 7), (3, "two alone", None, "s", 7), (4, None, None, None, 0), (5, "  ", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    names = sorted((r.doc_id or 0, "base" if (r.text or "").startswith("w0") else r.text or "") for r in got)
    assert names == [(0, "one alone"), (1, "base"), (1, other), (3, "two alone"), (4, "")]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_shingles_of_long_texts_are_hashed_in_stretches(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [b"", b" ", b"One", b"a b c", b"x" * 50, " ".join(rng.choice(["aa", "B\u00e9", "c\x1fd"], 60)).encode()]
    for n in (1, 3, 5):
        want = [np.concatenate([*simhash_index.shingle_hashes(t, n), np.zeros(0, np.uint64)]) for t in texts]
        for size in (1, 4, 30):
            monkeypatch.setattr(simhash_index, "STRETCH", size)
            for t, w in zip(texts, want):
                assert np.array_equal(np.concatenate([*simhash_index.shingle_hashes(t, n), np.zeros(0, np.uint64)]), w)
        monkeypatch.setattr(simhash_index, "STRETCH", 1 << 20)


def test_lines_and_samples_keep_columns_whatever_their_names(spark, docs):
    got = line_dedup.dedup_lines(docs, min_docs=10)  # docs has a column n_lines
    assert len(set(got.columns)) == len(got.columns)
    have = got.select("doc_id", F.col("n_lines").cast("long").alias("n"), "n_dropped", "kept_text").collect()
    assert sorted(map(str, map(tuple, have))) == sorted(map(str, lines_brute(rows(), 10)))
    odd = docs.withColumns({"_source": F.lit(1), "_lang": F.lit(2), "_topic": F.lit(3), "_row": F.lit(4), "_draw": F.lit(5), "Weight": F.lit(6)})
    every = mixing.sample(odd, keep=1.0)
    assert {"_source", "_lang", "_topic", "_row", "_draw", "weight"} <= set(every.columns) and every.select("_source", "_topic", "weight").count() == len(rows())


def test_joined_raking_without_a_target_that_occurs(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    monkeypatch.setattr(mixing.bounded, "__defaults__", (4, mixing.TOLERANCE))
    told, wanted = mixing.described(docs), {"source": {"nowhere": 1.0}}
    key = lambda r: (r._source, r._lang, r._topic)
    few, many = ({key(r): r.probability for r in mixing.mixture(told, targets=wanted, max_cells=n).collect()} for n in (mixing.MAX_CELLS, 0))
    assert few.keys() == many.keys() and all(many[k] == pytest.approx(few[k], rel=1e-4, abs=1e-5) for k in few)


def test_packing_by_shards_depends_on_the_documents_alone(spark, docs):
    one, two = (sorted(map(str, packing.pack(docs.repartition(n), length=64, shards=2).collect())) for n in (1, 5))
    assert one == two and {r.shard for r in packing.pack(docs, length=64, shards=2).collect()} == {0, 1}
