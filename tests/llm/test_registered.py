"""The registered queries on the smallest tables, against SQL or brute force, with code generation as in production."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_text_operators import fingerprint_brute, leaks_brute, lower, repeats_brute
from test_token_alignment import brute as alignment_brute

from paperloom.llm import packing, quality_ranking, queries, token_alignment, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents():
    return table("documents")


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "sales", "sale_lines", "clicks"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(r)) for r in found.fetchall())
    assert set(names) <= set(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_mixing_gives_every_cell_one_probability(spark, documents):
    got, by_id = run(spark, "op2_mix_sources"), {r["doc_id"]: r for r in documents}
    cells = {}
    for r in got:
        own = by_id[r.doc_id]
        assert (r.source, r.lang) == (own["source"], own["lang"])
        assert r.n_tokens == len((own["text"] or "").split())
        cells.setdefault((r.source, r.lang, r.topic), set()).add(r.probability)
    assert len({r.doc_id for r in got}) == len(got)
    assert all(len(p) == 1 and 0 < min(p) <= 1 for p in cells.values())
    kept = sum(r.n_tokens for r in got) / sum(len((r["text"] or "").split()) for r in documents)
    assert kept == pytest.approx(0.7, abs=0.15)  # few documents


def test_repeats_are_those_of_brute_force(spark, documents):
    want = repeats_brute([(r["doc_id"], r["text"]) for r in documents])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op3_suffix_dedup")}
    assert got == want


def test_neighbours_are_near_and_most_of_the_nearest(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    ids, vectors = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    got = {}
    for r in run(spark, "op4_prefix_forest"):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 100 == 0}
    found = 0
    for q, hits in got.items():
        hits.sort()
        far = np.sqrt(((vectors - rows[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][: len(hits)]
        assert [h[0] for h in hits] == list(range(1, 11)) and [(h[2], h[1]) for h in hits] == sorted((h[2], h[1]) for h in hits)
        assert all(s == pytest.approx(float(far[np.searchsorted(ids, v)]), abs=1e-12) for _, v, s in hits)
        found += len({v for _, v, _ in hits} & set(ids[order].tolist()))
    assert found >= 0.9 * sum(map(len, got.values()))


def test_packed_rows_hold_every_token(spark, documents):
    encoder, parts = packing.Encoder(packing.load_ranks()), {}
    for r in run(spark, "op6_pack_tokens"):
        ids = np.frombuffer(r.ids, "<u2")
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    for r in documents:
        assert [x for _, p in sorted(parts.get(r["doc_id"], [])) for x in p] == encoder.encode(r["text"] or "").tolist()


def test_fingerprints_and_groups_are_those_of_brute_force(spark, documents):
    ids = np.array([r["doc_id"] for r in documents])
    fps = np.array([fingerprint_brute(r["text"]) for r in documents], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label, before = ids.copy(), None
    while before is None or not np.array_equal(label, before):
        before, label = label, np.array([label[n].min() for n in near])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash_dedup")}
    assert got == {int(i): (f"{int(f):016x}", int(c)) for i, f, c in zip(ids, fps, label)}


def test_quality_columns(spark, documents):
    quality = {r["doc_id"]: r["quality"] for r in table("labels")}
    got = run(spark, "op9_quality_ranking")
    assert sorted(r.doc_id for r in got) == sorted(r["doc_id"] for r in documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= quality_ranking.CUT)
    right = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
    assert np.mean(right) > 0.9


def test_language_columns(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents}
    got = run(spark, "op10_language_id")
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got} <= {*lang.values(), "und"}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95


def test_alignments_are_those_of_brute_force(spark, documents):
    t = token_alignment.Tokenizers(token_alignment.Vocabularies.load())
    want = alignment_brute(t, [(r["doc_id"], r["text"]) for r in documents])
    assert Counter(map(tuple, run(spark, "op12_token_alignment"))) == want


def test_toxicity_columns(spark, documents):
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels")}
    got = run(spark, "op13_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(r["doc_id"] for r in documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD)
    right = [r.predicted == toxic[r.doc_id] for r in got if r.doc_id in toxic]
    assert np.mean(right) > 0.9


def jaccard_groups(rows):
    """The first of each group of texts whose 5-word shingles are alike by 0.8 or more, directly or through others."""
    sets = []
    for r in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(r.text or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return set(part)


def test_pipeline_is_its_stages_by_brute_force(spark, documents):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    seen = spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in documents], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = sorted(seen.collect(), key=lambda r: r.doc_id)
        out = stage(spark, seen, SF).collect()
        kept = {r.doc_id for r in out}
        assert len(kept) == len(out) and {tuple(r) for r in out} <= {tuple(r) for r in rows}  # whole rows, each once
        if name == "language_id":
            assert len(out) == len(rows)  # all are clean texts of the four languages
        if name == "near_duplicates":
            assert kept == {rows[i].doc_id for i in jaccard_groups(rows)}
        if name == "decontamination":
            assert kept == {d for d, _, hit, _ in leaks_brute([(r.doc_id, r.text) for r in rows], items) if not hit}
        seen = spark.createDataFrame(out, seen.schema)
    encoder, parts = packing.Encoder(packing.load_ranks()), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((o, ids[a:b].tolist()))
    assert set(parts) == kept
    for r in out:
        assert [x for _, p in sorted(parts[r.doc_id]) for x in p] == encoder.encode(r.text or "").tolist()
