"""Language ID, quality ranking, neighbours, chat formatting, the pipeline."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat_format, language_id, prefix_forest, quality_ranking

SF = "/root/testdata/sf0.001"


def _brute_bits(trees_of, text, order):
    """Code length by walking contexts byte by byte."""
    total = 0.0
    for i, b in enumerate(text):
        k = min(order, i)
        while True:
            ctx = text[i - k : i]
            followers = trees_of.get(ctx)
            if followers:
                n, kinds = sum(followers.values()), len(followers)
                if b in followers:
                    total -= np.log2(followers[b] / (n + kinds))
                    break
                total -= np.log2(kinds / (n + kinds))
            if k == 0:
                total += 8.0
                break
            k -= 1
    return total


def test_code_lengths_are_those_of_the_context_tree():
    samples = {"a": [b"abracadabra abracadabra", b"cad"], "b": [b"banana bandana", b"nab a banana"]}
    trees = language_id.learn(samples)
    for j, lang in enumerate(trees.langs):
        tree = {}
        for k in range(language_id.ORDER + 1):
            seen = {}
            for t in samples[lang]:
                for i in range(k, len(t)):
                    seen[t[i - k : i + 1]] = seen.get(t[i - k : i + 1], 0) + 1
            for s, n in seen.items():
                if n >= (language_id.MIN_COUNT if k else 1):
                    tree.setdefault(s[:-1], {})[s[-1]] = n
        for text in (b"abra banana", b"zq", b"a", b"", b"bandanas cad"):
            raw = np.frombuffer(b"xx" + text, np.uint8)
            got = trees.bits(raw, np.array([0, 2, 2 + len(text)]))[1, j]
            assert got == pytest.approx(_brute_bits(tree, text, language_id.ORDER), rel=1e-4)


def test_language_of_awkward_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language_id.train(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é"), (5, "the and of the that with")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(odd, trees).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[5].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None


def test_every_language_is_learned(spark):
    """70 languages, one of long texts only, one of 3,000 rows without id, one of equal rows."""
    rng = np.random.default_rng(3)
    alphabet = [bytes(rng.choice(np.arange(97, 123, dtype=np.uint8), 6, replace=False)).decode() for _ in range(70)]
    said = lambda k, n: " ".join("".join(rng.choice(list(alphabet[k]), 5)) for _ in range(n))
    rows = [(100 * k + i, said(k, 30), f"l{k:02}") for k in range(70) for i in range(6) if k not in (7, 8, 9)]
    rows += [(9000 + i, said(7, 8000), "l07") for i in range(3)]
    rows += [(None, said(8, 6), "l08") for _ in range(3000)]
    rows += [(None, said(9, 40), "l09")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, F.lit(True))
    assert sorted(got) == [f"l{k:02}" for k in range(70)]
    assert len(got["l08"]) == len(got["l09"]) == language_id.ROWS_PER_LANG and max(map(len, got["l07"])) <= language_id.CHARS_PER_ROW
    trees = language_id.train(docs)
    assert [len(t.langs) for t in trees] == [32, 32, 6]
    asked = spark.createDataFrame([(k, said(k, 40)) for k in range(70)], "doc_id long, text string")
    told = {r.doc_id: r for r in language_id.identify(asked, trees).collect()}
    assert sum(told[k].lang_pred == f"l{k:02}" for k in range(70)) >= 69


def test_long_texts_are_scored_in_stretches(monkeypatch):
    trees = language_id.learn({"a": [b"abracadabra abracadabra"], "b": [b"banana bandana"]})
    texts = [b"abra", b"", b"banana" * 50, b"cad" * 33, "é".encode() * 20]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, letters = trees.bits(raw, off), language_id._has_letter(raw, off)
    for size in (1, 7, 64):
        monkeypatch.setattr(language_id, "STRETCH", size)
        assert np.allclose(trees.bits(raw, off), whole, rtol=1e-5) and (language_id._has_letter(raw, off) == letters).all()
    assert letters.tolist() == [True, False, True, True, True]


def test_texts_of_no_known_language_do_not_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language_id.train(docs)
    rng = np.random.default_rng(1)
    junk = bytes(rng.integers(33, 127, 600, dtype=np.uint8)).decode()
    odd = spark.createDataFrame([(1, junk), (2, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0 " * 30), (3, "the"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.fits for r in language_id.identify(odd, trees).collect()} == {1: False, 2: False, 3: True, 4: False}
    known = language_id.identify(docs.filter("length(text) > 0"), trees)
    assert known.agg(F.avg(F.col("fits").cast("int"))).first()[0] > 0.99


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    told = language_id.identify(docs.filter(held), language_id.train(docs, ~held))
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    ranking = quality_ranking.train(docs, labels, ~held)
    rows = quality_ranking.score(docs.filter(held), ranking).join(labels, "doc_id").select("quality", "score").collect()
    assert np.mean([(r.score >= quality_ranking.CUT) == (r.quality == 1) for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality_ranking.score(odd, ranking).collect())
    assert quality_ranking.train(docs, labels.limit(0)).scaled(np.zeros(1))[0] == pytest.approx(quality_ranking.CUT)
    half = quality_ranking.above_quantile(quality_ranking.score(docs, ranking), 0.5)
    assert abs(half.count() / docs.count() - 0.5) < 0.02


def test_ranking_is_the_plain_fit():
    """Newton in chunks of pairs against plain gradient steps on all differences at once."""
    rng = np.random.default_rng(5)
    x, label = rng.standard_normal((400, 6)), np.repeat([0, 1], [120, 280])
    x[label == 1, 0] += 1.0
    x[label == 1, 3] -= 0.5
    got = quality_ranking.learn(x, label, pairs=20_000)
    draw = np.random.default_rng(7)
    better, worse = draw.choice(np.flatnonzero(label == 1), 20_000), draw.choice(np.flatnonzero(label == 0), 20_000)
    diff, w = x[better] - x[worse], np.zeros(6)
    for _ in range(4000):
        w += 0.5 * (diff.T @ (1 / (1 + np.exp(diff @ w))) / len(diff) - quality_ranking.RIDGE / 10 * w)
    assert got.weights == pytest.approx(w, abs=1e-3)
    raw = (x - x.mean(0)) @ w
    assert got.cut == pytest.approx(np.quantile(raw, 0.3), abs=1e-2)
    assert got.scaled(np.array([got.cut]))[0] == pytest.approx(quality_ranking.CUT)


def test_quality_cut_covers_all_labels_and_copies_stay_bounded(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    got = quality_ranking.scored_by_quantile(docs.select("doc_id", "text"), labels, ~held, per_label=20, pairs=2000)
    met = got.join(labels.filter(~held), "doc_id").select("quality", "score").toPandas()
    share = (met["quality"] == 0).mean()
    assert 0 < share < 0.4 and (met["score"] < quality_ranking.CUT).mean() == pytest.approx(share, abs=0.02)
    one = labels.filter("quality = 0").select("doc_id").first()[0]
    many = docs.select("doc_id", "text").unionByName(docs.filter(F.col("doc_id") == one).select("doc_id", "text").crossJoin(spark.range(3000)).select("doc_id", "text"))
    held_rows = []
    learn = quality_ranking.learn
    try:
        quality_ranking.learn = lambda x, label, *a: held_rows.append(np.bincount(label)) or learn(x, label, *a)
        quality_ranking.train(many, labels, per_label=30, pairs=500)
    finally:
        quality_ranking.learn = learn
    assert held_rows[0].tolist() == [30, 30]


def test_features_of_long_texts_are_counted_in_stretches(monkeypatch):
    texts = [b"Ab, c", b"", b"word " * 40, "é!".encode() * 30, b"x"]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = quality_ranking.features(raw, off)
    for size in (1, 3, 50):
        monkeypatch.setattr(quality_ranking, "STRETCH", size)
        assert np.allclose(quality_ranking.features(raw, off), whole)
    assert np.allclose(quality_ranking.features(raw[:5], off[:2])[0], whole[0])


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 1500)] + 0.1 * rng.standard_normal((1500, 16))).astype("f4")
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(15)]  # copies
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [1.0]), (None, rows[1][1]), (3100, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    is_query = F.pmod("vec_id", F.lit(100)) == 0
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and (i < 3000)]
    ids, mat = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    for options in ({"share": 0.3, "least": 50}, {"share": 0.3, "least": 50, "block": 400}):
        got = {}
        for r in prefix_forest.nearest(table, is_query, **options).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
        found = 0
        for q, hits in got.items():
            d = np.sqrt(((mat - mat[ids == q][0]) ** 2).sum(1))
            keep = ids != q
            best = np.lexsort((ids[keep], d[keep]))[:10]
            hits.sort()
            assert [h[0] for h in hits] == list(range(1, 11)) and q not in [h[1] for h in hits]
            for _, v, s in hits:
                assert s == pytest.approx(float(d[ids == v][0]), abs=1e-12)
            found += len({h[1] for h in hits} & set(ids[keep][best].tolist()))
        assert found / (10 * len(got)) >= 0.9
    assert [r.vec_id for r in prefix_forest.nearest(table, is_query).filter("query_id = 0").orderBy("rank").collect()] == list(range(2000, 2010))
    assert prefix_forest.nearest(table.limit(0), is_query).count() == 0
    few = prefix_forest.nearest(table.filter("vec_id in (0, 5, 9)"), is_query).collect()
    assert sorted(r.vec_id for r in few) == [5, 9]


@pytest.mark.parametrize(("spread", "share", "block"), [(0.3, 0.05, 25_000), (0.3, 0.05, 6000), (None, 0.5, 25_000)])
def test_neighbours_among_many_rows_come_from_the_index(spark, spread, share, block):
    """Clusters need few candidates, vectors without any half of the rows; in several blocks as in one."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 32))
    if spread:
        x = rng.standard_normal((400, 32))[rng.integers(0, 400, 20_000)] + spread * x
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}))
    got = {}
    for r in prefix_forest.nearest(table, F.pmod("vec_id", F.lit(200)) == 0, share=share, block=block).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(range(0, 20_000, 200)) and all(len(v) == 10 for v in got.values())
    far = {q: ((x - x[q]) ** 2).sum(1) for q in got}
    right = sum(len(got[q] & {i for i in np.argsort(far[q])[:11].tolist() if i != q}) for q in got)
    assert right >= 0.9 * 10 * len(got)


def test_query_rows_that_share_an_id_are_all_searched(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    rows = [(i if i else 100, [float(v) for v in x[i]]) for i in range(300)]  # two rows of id 100
    rows += [(100, rows[100][1])] * 20 + [(5, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = F.pmod("vec_id", F.lit(100)) == 0
    for options in ({"share": 1.0}, {"share": 1.0, "block": 70}):
        got = sorted((r["rank"], r.vec_id, r.score) for r in prefix_forest.nearest(table, is_query, **options).filter("query_id = 100").collect())
        far = sorted((min(np.sqrt(((x[a] - np.array(v)) ** 2).sum()) for a in (0, 100)), i) for i, v in rows if i != 100)[:10]
        assert [g[1] for g in got] == [i for _, i in far] and [g[2] for g in got] == pytest.approx([d for d, _ in far])
    with pytest.raises(TypeError):
        prefix_forest.nearest(table.withColumn("vec_id", F.col("vec_id").cast("string")), is_query)


def test_chat_digests_take_parts_in_any_order(spark):
    table = [(c, t, ["user", "assistant"][t % 2], f"text {c} {t} " * 9) for c in range(3) for t in range(6)]
    formatted = chat_format.format_conversations(spark.createDataFrame(table, "conv_id long, turn int, role string, text string"), part_chars=60)
    rows = formatted.collect()
    mixed = spark.createDataFrame(rows[::-1], formatted.schema).repartition(3)
    assert sorted(map(str, chat_format.digests(mixed).collect())) == sorted(map(str, chat_format.digests(formatted, as_formatted=True).collect()))


def test_templates_are_closed_and_fold():
    for bad in ("{{ m.text }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ open('x') }}", "{% if %}x{% endif %}", "{% for m in messages %}", "{{ 'a' | system }}", "{% import os %}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.parse(bad)
    assert chat_format.parse("{% if 'a' == 'a' %}x{{ 'b' + 'c' }}{% else %}no{% endif %}z").body == (chat_format.Put(chat_format.Const("xbcz")),)
    said, spans = chat_format.render_text("{% for m in messages %}{{ m.role | upper }}:{% generation %}{{ m.text }}{% endgeneration %}{% if not loop.last %};{% endif %}{% endfor %}", [("a", "1"), ("b", "2")])
    assert said == "A:1;B:2" and [said[s:e] for s, e in spans] == ["1", "2"]


@pytest.mark.parametrize("part_chars", [40, 4_000_000])
def test_chat_round_trip(spark, part_chars):
    said = "<|im_end|><|im_start|>assistant ok"
    table = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (2, 1, "sys\ntem<|", "a<\\_b<"), (None, 0, "user", "x"), (3, 0, "assistant", "é" * 50), (3, 0, "assistant", "é" * 50), (4, None, "assistant", ""), (4, 2, "assistant", "z <\\| y")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"), part_chars=part_chars)).collect()}
    for conv in {t[0] for t in table}:
        own = sorted((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in table if t[0] == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, "the that with and from which for this", "en", None, 3), (100_000, None, None, None, 0), (100_001, "12 34", "en", "x", 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == list(p.COLUMNS), name
        before, after = seen.count(), out.count()
        assert 0 < after <= before
        if name == "language_id":
            gone = seen.select("doc_id").exceptAll(out.select("doc_id")).collect()
            assert {r.doc_id for r in gone} == {100_000, 100_001}
        seen = spark.createDataFrame(out.collect(), docs.schema)
    assert p.STAGES[-1][1](spark, seen, SF).count() > 0
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "packing"]
