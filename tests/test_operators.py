"""Known facts of the operators, and the choices where behaviour is easy to get wrong."""

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paperloom.functions import rules, scores, text
from paperloom.operators import bases, changes, documents, extraction, governance, graph, graph_store, jobs, retrieval, similarity
from paperloom.operators import index as indexes
from paperloom.operators.index import Index
from paperloom.plans import generations
from paperloom.sources import markdown
from paperloom.sources.tables import entries
from paperloom.streaming import events as streams

SHAPE = (
    "path string, title string, domain string, tags array<string>, related array<string>, contradictions array<string>, aggregated_from array<string>, "
    "level string, confidence string, quality_score double, status string, publish_status string, version int, created timestamp, updated timestamp, last_validated timestamp, body string"
)
DAY = dt.datetime(2024, 1, 1)


def entry(path, tags=(), related=(), contradictions=(), made_of=(), level="L1", confidence="medium", score=0.9, status="compiled", published="published", body="", title=None):
    return (path, title or path, path.split("/")[0], list(tags), list(related), list(contradictions), list(made_of), level, confidence, score, status, published, 1, DAY, DAY, None, body)


def kb(spark, *rows):
    return spark.createDataFrame(list(rows), SHAPE)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_two_linked_entries(spark):
    e = kb(spark, entry("it/a.md", ["rust", "systems"], ["it/b.md"]), entry("it/b.md", ["rust", "async"], ["IT/A.md"]))
    kinds = values(graph.edges(e), "src", "dst", "kind")
    assert kinds == [("it/a.md", "it/b.md", "related"), ("it/a.md", "it/b.md", "tag_cooccurrence"), ("it/b.md", "it/a.md", "related"), ("it/b.md", "it/a.md", "tag_cooccurrence")]


def test_tag_pairs_find_every_pair(spark):
    import itertools
    import random

    random.seed(1)
    sets = {f"d/{i}.md": random.sample("abcdefghij", random.randint(0, 6)) for i in range(60)}
    e = kb(spark, *(entry(p, t) for p, t in sets.items()))
    for least in (0.3, 0.5, 0.8):
        want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if set(sets[a]) & set(sets[b]) and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least)
        assert values(graph.tag_pairs(e, least), "a", "b") == want


def test_links_prefixed_with_wiki_resolve_only_in_bodies(spark):
    e = kb(spark, entry("it/a.md", related=["wiki/it/b.md"], body="see [[ wiki/it/b.md ]] and [[it/b]]"), entry("it/b.md"))
    assert values(graph.reference_edges(e), "src", "dst", "kind") == [("it/a.md", "it/b.md", "wikilink")]


def test_orphans_ignore_wikilinks(spark):
    e = kb(spark, entry("d/a.md", body="[[d/b.md]]"), entry("d/b.md"), entry("d/c.md", related=["d/d.md"]), entry("d/d.md"))
    assert values(graph.orphans(e), "path") == [("d/a.md",), ("d/b.md",)]


def test_confidence_flows_from_sources(spark):
    e = kb(spark, entry("s/low.md", level="L0", confidence="low"), entry("s/made.md", confidence="high", made_of=["wiki/s/low.md"]), entry("s/next.md", confidence="high", contradictions=["s/made.md"]))
    got = {r.path: r for r in graph.propagate_confidence(e).collect()}
    assert got["s/made.md"].effective == "low" and got["s/made.md"].downgraded and got["s/made.md"].needs_review
    assert got["s/next.md"].effective == "high" and not got["s/next.md"].downgraded


def test_communities(spark):
    paths = [f"d/{x}.md" for x in "abcdefgh"]
    e = kb(spark, *(entry(p) for p in paths))
    pair = lambda x, y: (f"d/{x}.md", f"d/{y}.md", "related")
    links = spark.createDataFrame([pair("a", "b"), pair("b", "c"), pair("c", "a"), pair("d", "e"), pair("f", "g")], "src string, dst string, kind string")
    got = values(graph.communities(e, links).select("community", "size").distinct(), "community", "size")
    assert got == [("d/a.md", 3), ("d/d.md", 2), ("d/f.md", 2)]
    assert graph.communities(e, links.limit(0)).count() == 0


def test_aggregation_takes_communities_with_two_plain_entries(spark):
    e = kb(spark, entry("x/a.md"), entry("y/b.md"), entry("x/c.md"), entry("x/d.md", level="L2"), entry("y/e.md"), entry("y/f.md", level="l1"))
    members = spark.createDataFrame([("x/a.md", "x/a.md", 3), ("y/b.md", "x/a.md", 3), ("x/c.md", "x/a.md", 3), ("x/d.md", "x/d.md", 2), ("y/e.md", "x/d.md", 2), ("y/f.md", "z", 1)], "path string, community string, size long")
    got = values(graph.aggregation_candidates(e, members), "community", "members", "domain")
    assert got == [("x/a.md", 3, "x")]


def test_context_of_an_entry(spark):
    long = "fox " * 2000
    e = kb(spark, entry("d/a.md", body=long), entry("d/b.md", body="hens"), entry("d/c.md", body="fox den"), entry("d/d.md", body="fox run", published="draft"))
    links = spark.createDataFrame([("d/a.md", "d/b.md", "related")], "src string, dst string, kind string")
    got = values(retrieval.agent_context(e, links, "d/a.md", "fox"), "path", "role", "chars", "tokens")
    assert got[:2] == [("d/a.md", "center", 4000, 1000), ("d/b.md", "neighbor", 200, 50)]
    assert ("d/c.md", "related", 150, 37) in got and not any(p == "d/d.md" for p, *_ in got)


def test_neighbours_have_fewest_hops(spark):
    links = spark.createDataFrame([("a", "b", "related"), ("b", "c", "related"), ("a", "c", "wikilink"), ("c", "d", "related"), ("d", "a", "related")], "src string, dst string, kind string")
    assert values(graph.neighbors(links, "a", 2), "path", "hop") == [("b", 1), ("c", 1), ("d", 2)]


def edges_of(store):
    return sorted(map(tuple, store.edges.select("src", "dst", "kind").collect()))


def test_the_stored_graph_follows_changes_as_a_rebuild_would(spark, tmp_path):
    old = [entry("d/a.md", ["x", "y"], ["D/B.md"], body="[[d/new.md]]"), entry("d/b.md", ["x", "z"], contradictions=["d/a.md"]), entry("d/c.md", ["q"], ["d/a.md", "d/a.md"]), entry("d/gone.md", ["x", "y"], ["d/a.md"])]
    changed = [entry("d/b.md", ["x", "y"], ["d/gone.md"], body="[[ wiki/d/c.md ]]"), entry("d/new.md", ["q", "q"], ["d/none.md"])]
    root = f"file://{tmp_path}/graph"
    store = graph_store.GraphStore.current(spark, root, lambda: kb(spark, *old))
    assert edges_of(store) == sorted(map(tuple, graph.edges(kb(spark, *old)).collect()))
    after = store.upserted(kb(spark, *changed), spark.createDataFrame([("d/gone.md",)], "path string")).publish(root)
    want = sorted(map(tuple, graph.edges(kb(spark, old[0], old[2], *changed)).collect()))
    assert edges_of(after) == want and edges_of(graph_store.GraphStore.current(spark, root, lambda: 1 / 0)) == want
    back = after.upserted(kb(spark, old[3]))  # an entry that others still name comes back
    assert edges_of(back) == sorted(map(tuple, graph.edges(kb(spark, old[0], old[2], old[3], *changed)).collect()))


def test_a_damaged_graph_is_built_anew(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    at = generations.begun(spark, root)
    spark.range(1).write.parquet(f"{at}/nodes")  # the other tables are missing
    generations.published(spark, root, at)
    store = graph_store.GraphStore.current(spark, root, lambda: kb(spark, entry("d/a.md", related=["d/a.md"])))
    assert edges_of(store) == [("d/a.md", "d/a.md", "related")]


def test_concept_map_text(spark):
    e = kb(spark, entry("d/a.md", title='say "a"'), entry("d/b.md", title="b", related=["d/a.md"]), entry("d/c.md", title="c", contradictions=["d/b.md"]))
    links = spark.createDataFrame(graph.reference_edges(e).collect(), "src string, dst string, kind string")
    draw = lambda center, depth: graph.concept_map_text(e, links, center, depth).first()["text"].split("\n")
    want = ["graph LR", "    n0[\"say 'a'\"]:::center", '    n1["b"]', "    n1 -->|relates| n0"]
    assert draw("d/a.md", 1) == [*want, "    classDef center stroke-width:2px"]
    assert draw("d/a.md", 2)[3:6] == ['    n2["c"]', "    n1 -->|relates| n0", "    n2 --x|contradicts| n1"]
    assert draw("d/none.md", 1) == ["graph LR", '    error["no such entry: d/none.md"]']


def test_positions_of_keywords(spark):
    docs = spark.createDataFrame([(1, ["ab.c AB", "", "xab", "cab"]), (2, None), (3, ["", None]), (4, ["a.c(ü)A.C"])], "doc long, pages array<string>")
    got = values(retrieval.keyword_positions(docs, ["ab", "a.c", "", "ab", "(ü)"], context=2), "doc", "keyword", "page", "position", "context")
    assert got == [
        (1, "ab", 1, 0, "ab.c"), (1, "ab", 1, 5, "c ABxa"), (1, "ab", 3, 8, "Bxabca"), (1, "ab", 4, 11, "bcab"),
        (4, "(ü)", 1, 3, ".c(ü)A."), (4, "a.c", 1, 0, "a.c(ü"), (4, "a.c", 1, 6, "ü)A.C"),
    ]
    assert values(retrieval.keyword_positions(docs, ["AB"], case_sensitive=True), "doc", "page", "position") == [(1, 1, 5)]
    assert values(retrieval.pages_with_matches(retrieval.keyword_positions(docs, ["ab", "cab"])), "doc", "matches", "pages") == [(1, 5, 3)]
    assert values(retrieval.page_starts(docs), "doc", "page", "start") == [(1, 1, 0), (1, 2, 7), (1, 3, 7), (1, 4, 10), (3, 1, 0), (3, 2, 0), (4, 1, 0)]
    assert retrieval.keyword_positions(docs, []).count() == 0


def test_jobs_are_folded_from_their_log(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    log = [
        ("a", 1, at(0), "start", "extract", None), ("a", 2, at(5), "succeed", "extract", None), ("a", 3, at(6), "start", "prompt_gen", None), ("a", 4, at(8), "fail", "prompt_gen", "no key"),
        ("a", 5, at(9), "start", "prompt_gen", None), ("a", 6, at(9), "start", "prompt_gen", None), ("a", 7, at(10), "succeed", "prompt_gen", None), ("a", 8, at(11), "await", None, None),
        ("a", 9, at(12), "complete", None, "completed"), ("a", 10, at(13), "start", "quality_gate", None), ("b", 1, at(0), "succeed", "extract", None), ("b", 2, at(1), "fail", "nowhere", "x"),
        ("b", 3, at(2), "complete", None, "unheard"), ("c", 1, at(0), "fail", "extract", "broken"),
    ]
    table = spark.createDataFrame(log, "job string, seq long, ts timestamp, action string, stage string, detail string")
    assert [tuple(r) for r in sorted(jobs.stages(table).filter("job <> 'b'").collect(), key=str)] == sorted(
        [
            ("a", "extract", "succeeded", at(0), at(5), 5000, None), ("a", "prompt_gen", "succeeded", at(9), at(10), 1000, None),
            ("a", "quality_gate", "running", at(13), None, None, None), ("c", "extract", "failed", None, at(0), None, "broken"),
        ], key=str,
    )
    assert values(jobs.states(table), "job", "status", "message", "stages_succeeded", "stages_failed", "stages_running") == [
        ("a", "running", "completed", 2, 0, 1), ("b", "unheard", "unheard", 1, 0, 0), ("c", "failed", "broken", 0, 1, 0),
    ]
    assert values(jobs.illegal_steps(table), "job", "seq", "reason") == [
        ("a", 6, "the stage is running"), ("a", 10, "the job has ended"), ("b", 1, "the stage was not started"), ("b", 2, "no such stage"), ("b", 3, "no such status"), ("c", 1, "the stage was not started"),
    ]


def test_hub_threshold(spark):
    few = kb(spark, entry("d/a.md"))
    assert graph.hub_threshold(few, graph.edges(few)).first().threshold == 5


def test_gate_decisions(spark):
    e = kb(spark, entry("d/a.md", score=0.9), entry("d/b.md", score=0.5), entry("d/c.md", score=0.0), entry("d/e.md", score=0.0, status="pending"), entry("d/f.md", score=0.8, status="pending"))
    assert values(governance.publish_gate(e), "path", "after") == [("d/a.md", "published"), ("d/b.md", "blocked"), ("d/c.md", "draft"), ("d/e.md", "blocked"), ("d/f.md", "draft")]
    assert values(governance.publish_gate(e, auto_publish=True), "path", "after")[2] == ("d/c.md", "published")
    assert values(retrieval.searchable(e), "path") == [("d/a.md",), ("d/f.md",)]


def test_decay(spark):
    row = spark.range(1).select(scores.time_decay(F.lit(180)).alias("a"), scores.time_decay(F.lit(-3)).alias("b"), scores.decay_score(F.lit(2.0), F.lit(0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.5, 1.0, 1.0)


def test_fnv_buckets(spark):
    def fnv(w):
        h = 0xCBF29CE484222325
        for b in [*w.encode(), 0xFF]:
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h % 256

    terms = ["rust", "http", "反向代理", "é", "", "x" * 50]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", scores.fnv_bucket(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == {t: fnv(t) for t in terms}


def test_chinese_search(spark):
    e = kb(spark, entry("it/n.md", body="春天的山谷里开满了杏花"), entry("it/o.md", body="other"))
    assert values(retrieval.scan_search(e, "杏", 5), "path") == [("it/n.md",)]
    assert retrieval.semantic_search(e, "山谷杏花", 1).first().path == "it/n.md"


def test_search_of_nothing(spark):
    none = kb(spark, entry("d/a.md")).limit(0)
    assert retrieval.hybrid_search(none, "anything", 5).count() == 0


def test_fusion_prefers_both_legs(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 8.0)], "path string, score double")
    b = spark.createDataFrame([("y", 0.9), ("z", 0.8)], "path string, score double")
    got = [(r.path, r.score) for r in retrieval.fuse(a, b).collect()]
    assert got == [("y", pytest.approx(1 / 62 + 1 / 61, abs=1e-8)), ("x", pytest.approx(1 / 61, abs=1e-8)), ("z", pytest.approx(1 / 62, abs=1e-8))]


def test_page_ranges(spark):
    for spec, most, want in (("1,3,5-7", 10, [1, 3, 5, 6, 7]), ("8-15", 10, [8, 9, 10]), ("1,1,2-3,3", 10, [1, 2, 3])):
        assert spark.range(1).select(documents.page_numbers(F.lit(spec), most)).first()[0] == want


def test_domain_of_path(spark):
    rows = [("it/concept.md", "it"), ("[IT] x.md", "IT"), ("concept.md", "未分类")]
    got = spark.createDataFrame(rows, "p string, d string").select(text.domain_of_path(F.col("p")).alias("g"), "d").collect()
    assert all(r.g == r.d for r in got)


def test_structure_counts_outside_fences(spark):
    body = "# A\n[[x]]\n```\n# no\n[[no]]\n```\n## B\n[[ y ]] [[z]] [[]]\n### C\n```\ncode\n```"
    e = kb(spark, entry("d/a.md", body=body))
    assert documents.structure(e).first()[1:] == (3, 3, 2)


def test_front_matter_round_trip(spark):
    e = kb(spark, entry("it/a.md", ["x", "y"], ["it/b.md"], body="# T\ntext --- more"), entry("it/b.md"))
    got = {r.path: r for r in documents.parse_entries(documents.to_markdown(e.withColumn("source", F.lit("s")).withColumn("page", F.lit("1")))).collect()}
    assert got["it/a.md"].tags == ["x", "y"] and got["it/a.md"].body == "# T\ntext --- more" and got["it/a.md"].created == DAY
    bad = spark.createDataFrame([("a", "no front"), ("b", "---\ntitle: x\n---\nbody"), ("c", "---\n: [\n---\n"), ("d", None)], "path string, content string")
    assert documents.parse_entries(bad).count() == 0


def test_sections_are_replaced_in_place(spark):
    body, none = F.lit("# A\nold\n## sub\nx\n# B\nkeep"), F.lit("plain")
    row = spark.range(1).select(text.with_section(body, F.lit("A"), "new").alias("a"), text.with_section(none, F.lit("A"), "new").alias("b")).first()
    assert (row.a, row.b) == ("# A\nnew\n# B\nkeep", "plain")


def test_markdown_reader(spark, tmp_path):
    for name, content in (("it/[IT] A.md", "a"), ("it/index.md", "i"), ("it/.versions/old.md", "o"), ("b c.md", "b"), ("x.txt", "t")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    assert values(markdown.markdown_files(spark, str(tmp_path)), "path", "content") == [("b c.md", "b"), ("it/[IT] A.md", "a")]


def test_raw_files(spark, tmp_path):
    for name in ("a.pdf", "b.MD", "b.compile_prompt.md", "c.png", "d.exe"):
        (tmp_path / name).write_bytes(b"%PDF-1.4" if name == "a.pdf" else b"x")
    got = markdown.raw_files(spark, str(tmp_path))
    assert sorted(r.kind for r in got.collect()) == ["image", "markdown", "pdf"]
    assert documents.valid_documents(got).count() == 1


def test_source_state(spark):
    sources = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    state = spark.createDataFrame([("a", "1", ["x"]), ("b", "0", ["x"]), ("c", "3", [])], "path string, source_hash string, outputs array<string>")
    assert values(changes.sources_to_compile(sources, state), "path", "reason") == [("b", "changed"), ("c", "no outputs"), ("d", "new")]


def test_roots_change_with_contents(spark):
    one = changes.manifest(spark.createDataFrame([(f"w/{i}", str(i)) for i in range(50)], "path string, content string"))
    two = one.withColumn("hash", F.when(F.col("path") == "w/7", F.lit("0" * 64)).otherwise(F.col("hash")))
    assert changes.merkle_root(one).first() != changes.merkle_root(two).first()
    assert changes.merkle_root(one.orderBy(F.desc("path"))).first() == changes.merkle_root(one).first()
    assert changes.sync_status(one, one).first().in_sync and not changes.sync_status(one, two).first().in_sync


def test_streams_add_up_to_the_batch(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(600)
    for i, part in enumerate(base.repartitionByRange(3, "ts").randomSplit([1.0])):
        part.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        assert i == 0
    stream = streams.read_events(spark, str(tmp_path / "in"))
    q = streams.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    batch = streams.tumbling(spark.read.parquet(str(tmp_path / "in")))
    assert values(spark.table("tumbled"), "start", "event_type", "n") == values(batch, "start", "event_type", "n")


def test_incremental_compile_sees_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    seen = []
    for _ in range(2):
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.incremental_compile(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "state"), lambda df, _: seen.append(df.count()))
        q.awaitTermination()
    assert sum(seen) == 4


def test_search_modes(spark):
    e = kb(spark, entry("d/a.md", body="alpha beta"), entry("d/b.md", body="gamma", published="draft"))
    assert [retrieval.search_mode(m) for m in ("fulltext", "vector", "wiki-first", "wiki", "other")] == ["keyword", "semantic", "wiki_first", "wiki_first", "hybrid"]
    for mode in ("keyword", "semantic", "wiki", "hybrid"):
        assert values(retrieval.search(e, "alpha", mode), "path") == [("d/a.md",)]


def test_saves_proposals_and_locks(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    e = kb(spark, entry("d/a.md", body="old text"), entry("d/b.md"))
    new = kb(spark, entry("d/a.md", body="new text", status="pending"), entry("../x.md"), entry("d/c.md"))
    after = {r.path: r for r in bases.saved(e, new, now).collect()}
    assert set(after) == {"d/a.md", "d/b.md", "d/c.md"} and after["d/a.md"].version == 2 and after["d/a.md"].status == "compiled" and after["d/c.md"].version == 0
    none = spark.createDataFrame([], "id string, path string, find string, put string, created timestamp, status string")
    offered = bases.submitted(none, spark.createDataFrame([("d/a.md", "old", "fresh", DAY)], "path string, find string, put string, created timestamp"))
    key = offered.first().id
    entries, proposals = bases.applied(e, offered, key)
    assert {r.path: (r.body, r.version) for r in entries.collect()}["d/a.md"] == ("fresh text", 2) and bases.listed(proposals, "pending").count() == 0
    again, _ = bases.applied(entries, proposals, key)
    assert {r.path: r.version for r in again.collect()}["d/a.md"] == 2
    locks = spark.createDataFrame([], "path string, holder string, taken timestamp, ttl int")
    locks = bases.acquired(locks, "d/a.md", "x", "2024-01-01 00:00:00")
    assert bases.acquired(locks, "d/a.md", "y", "2024-01-01 00:01:00").first().holder == "x"
    assert bases.acquired(locks, "d/a.md", "y", "2024-01-01 00:06:00").first().holder == "y"
    assert bases.released(locks, "d/a.md", "x").count() == 0


def test_config_and_export(spark, tmp_path):
    config = bases.set_config(spark.createDataFrame([("auto_publish", "true")], "key string, value string"), "min_quality_score", "x")
    assert bases.gate_config(config) == {"least": 0.7, "block_on_error": True, "auto_publish": True}
    assert bases.set_config(config, "auto_publish", None).count() == 1
    e = kb(spark, entry("d/a.md"))
    bases.export({"wiki": e}, str(tmp_path / "kb"))
    assert bases.imported(spark, str(tmp_path / "kb"), ("wiki",))["wiki"].count() == 1
    with pytest.raises(Exception, match="already exists"):
        bases.export({"wiki": e}, str(tmp_path / "kb"))
    assert "d/a.md" in bases.compile_prompt(kb(spark, entry("d/a.md", ["t"])), ["t"], "text")


def test_extraction(spark):
    pdf = b"%PDF-1.4\n1 0 obj<< /Type /Page >>\nstream\nBT (Hello \\(you\\)) Tj (there) Tj ET\nendstream"
    files = spark.createDataFrame([("a.pdf", bytearray(pdf)), ("b.txt", bytearray(b"one\ftwo")), ("c.bin", bytearray(b"\xff\xfe"))], "path string, content binary")
    got = {r.path: r for r in extraction.extract(files).collect()}
    assert got["a.pdf"].pages == ["Hello (you) there"] and got["b.txt"].pages == ["one", "two"] and got["c.bin"].error
    assert values(extraction.selected_pages(extraction.extract(files), "2"), "path", "text") == [("b.txt", "two")]
    assert {r.p: r.n for r in files.select(F.col("path").alias("p"), extraction.n_pages(F.col("content")).alias("n")).collect()}["a.pdf"] == 1
    row = spark.range(1).select(extraction.mixed_pages(F.array(F.lit("short"), F.lit("y" * 200)), F.array(F.lit("better"), F.lit("z"))).alias("m"), rules.escalation(F.lit(10), F.lit(0.9)).alias("o")).first()
    assert row.m == ["better", "y" * 200] and row.o == "ocr"


def test_rules(spark):
    u, none = F.lit("u1"), F.array().cast("array<string>")
    row = spark.range(1).select(
        rules.flag_on(F.lit("boolean"), F.lit(1), none, u).alias("a"),
        rules.flag_on(F.lit("percentage"), F.lit(100), none, u).alias("b"),
        rules.flag_on(F.lit("targeted"), F.lit(0), F.array(F.lit("u1")), u).alias("c"),
        rules.flag_on(F.lit("what"), F.lit(1), none, u).alias("d"),
        rules.camel(F.lit("search_wiki_now")).alias("e"),
        rules.megabytes(F.lit(3 << 20)).alias("f"),
        rules.backoff(F.lit(3), 1.0, 5.0).alias("g"),
        rules.tier(F.lit("x"), ["a"], ["x"]).alias("h"),
    ).first()
    assert tuple(row) == (True, True, True, False, "searchWikiNow", 3.0, pytest.approx(5.5), "code_only")


def test_index_written_read_and_upserted(spark, tmp_path):
    e = kb(spark, entry("d/a.md", body="alpha beta"), entry("d/b.md", body="gamma delta"), entry("d/c.md", body="alpha alpha"))
    built = Index.of(e).write(str(tmp_path / "one"))
    want = [(r.path, r.score) for r in retrieval.keyword_search(e, "alpha", 5).collect()]
    assert [(r.path, r.score) for r in built.keyword("alpha", 5).collect()] == want
    after = built.upserted(kb(spark, entry("d/b.md", body="alpha only"), entry("d/c.md", body="nothing here")))
    assert {r.path for r in after.keyword("alpha", 5).collect()} == {"d/a.md", "d/b.md"}
    assert {r.path for r in after.semantic("alpha only", 3).collect()} >= {"d/a.md", "d/b.md"}
    assert after.fields.select("path").distinct().count() == 3


def test_a_build_counts_once_it_is_whole_and_replaces_the_one_before(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/kb"
    assert Index.current(spark, root) is None
    Index.build(kb(spark, entry("d/a.md", body="alpha")), root)
    with monkeypatch.context() as m:
        m.setattr(Index, "write", lambda self, at: self.stats.write.parquet(f"{at}/stats") or 1 / 0)
        with pytest.raises(ZeroDivisionError):
            Index.build(kb(spark, entry("d/b.md", body="beta")), root)
    assert [r.path for r in Index.current(spark, root).keyword("alpha").collect()] == ["d/a.md"]
    for name in ("c", "d", "e"):
        Index.build(kb(spark, entry(f"d/{name}.md", body="alpha")), root)
    assert [r.path for r in Index.current(spark, root).keyword("alpha").collect()] == ["d/e.md"]
    assert len([p for p in (tmp_path / "kb").iterdir() if p.is_dir()]) == 1 + generations.KEPT
    assert not list((tmp_path / "kb").glob("*/_made"))


def test_every_text_is_tokenized_once_in_a_build(spark, tmp_path, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), text.tokens
    count = F.udf(lambda x: seen.add(int("alpha" in x)) or x, "string")
    monkeypatch.setattr(text, "tokens", lambda c: plain(count(c)))
    e = kb(spark, *[entry(f"d/{i}.md", body=f"alpha w{i}") for i in range(20)])
    Index.build(e, f"file://{tmp_path}/kb", tokens=text.tokens)
    assert seen.value == 20


def test_near_equal_hits_are_suppressed(spark):
    same = "t one two three four"
    rows = spark.createDataFrame([("d/a.md", 3.0, same), ("d/b.md", 2.0, same), ("d/c.md", 1.0, "u five six")], "path string, score double, said string")
    assert values(retrieval.without_duplicates(rows, "said"), "path") == [("d/a.md",), ("d/c.md",)]


def searched(spark, seed, n=300, words=40):
    """Entries whose words are Zipf-like, in zones of few entries."""
    import random

    rnd = random.Random(seed)
    pick = lambda k: " ".join(f"w{min(int(rnd.paretovariate(0.7)), words)}" for _ in range(k))
    return kb(spark, *[entry(f"d{i % 3}/{i}.md", [f"t{i % 5}"], title=pick(3), body=pick(rnd.randrange(1, 60))) for i in range(n)])


@pytest.mark.parametrize("listed", [0, 2000])
def test_pruned_search_is_exact_and_reads_few_blocks(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(indexes, "ZONE_ENTRIES", 4)
    monkeypatch.setattr(indexes, "LEAD", 3)
    monkeypatch.setattr(indexes, "LISTED", listed)
    e = searched(spark, 1)
    built = Index.of(e).write(f"file://{tmp_path}/kb")
    assert built.stats.first()["zones"] == 75
    for query, tops in (("w1 w2 w39", (1, 5, 1000)), ("w17 w23 w31", (5,)), ("missing", (5,))):
        for top in tops:
            want = [(r.path, r.score) for r in retrieval.keyword_search(e, query, top).collect()]
            assert [(r.path, r.score) for r in built.keyword(query, top).collect()] == want, (query, top)
    rare = e.select(F.explode(text.tokens(F.col("body"))).alias("t")).groupBy("t").count().filter("count <= 12").orderBy("count", "t").first()["t"]
    row = built.blocks_read(f"w1 {rare}", 3).first()
    assert 0 < row.blocks_read < row.blocks / 2


def held(row, field):
    return {"title": row.title, "body": row.body, "tags": " ".join(row.tags)}[field].lower().split()


def test_clauses_and_phrases_match_what_a_scan_finds(spark, tmp_path):
    e = searched(spark, 2, n=120, words=8)
    rows, built = e.collect(), Index.of(e).write(f"file://{tmp_path}/kb")
    runs = lambda r, f, ws: any(held(r, f)[i : i + len(ws)] == ws for i in range(len(held(r, f))))
    has = lambda r, ws, fields=("title", "body", "tags"): any(runs(r, f, ws.split()) for f in fields)
    cases = {
        '"w1 w2"': lambda r: has(r, "w1 w2"),
        '"w1 w1 w2"': lambda r: has(r, "w1 w1 w2"),
        "title:w3": lambda r: has(r, "w3", ["title"]),
        '+"w2 w1" -tags:t2 w4': lambda r: has(r, "w2 w1") and not has(r, "t2", ["tags"]),
        "w5 AND w6": lambda r: has(r, "w5") and has(r, "w6"),
        "w5 NOT w6": lambda r: has(r, "w5") and not has(r, "w6"),
        "w7 OR body:\"w3 w2 w1\"": lambda r: has(r, "w7") or has(r, "w3 w2 w1", ["body"]),
        "+w1 +missing": lambda r: False,
        "-w1": lambda r: False,
        "": lambda r: False,
    }
    for query, test in cases.items():
        assert {r.path for r in built.matches(query).collect()} == {r.path for r in rows if test(r)}, query
    one, two = (dict(map(tuple, built.matches(q).collect())) for q in ('"w1 w2"', "w1 w2"))
    assert one and all(0 < s <= two[p] + 1e-3 for p, s in one.items())  # a phrase's terms weigh no more than all their occurrences
    assert {r.path for r in built.find("w1 w2", 5, domain="d1").collect()} <= {r.path for r in rows if r.domain == "d1"}


def test_a_word_of_signs_or_characters_is_a_phrase(spark, tmp_path):
    e = kb(spark, entry("d/a.md", body="Nginx 反向代理与负载均衡"), entry("d/b.md", body="代理 反向"), entry("d/c.md", body="a-b c"), entry("d/d.md", body="a b-c"))
    built = Index.of(e).write(f"file://{tmp_path}/kb")
    assert [r.path for r in built.find("反向代理").collect()] == ["d/a.md"]
    assert [r.path for r in built.find("b-c").collect()] == ["d/d.md"]
    assert [str(c) for c in indexes.parsed('a "b c" -title:d')] == [str(indexes.Clause("", None, ("a",))), str(indexes.Clause("", None, ("b", "c"))), str(indexes.Clause("-", "title", ("d",)))]


def test_searches_of_an_empty_index(spark, tmp_path):
    built = Index.of(kb(spark).limit(0)).write(f"file://{tmp_path}/kb")
    assert built.keyword("x").count() == built.find('"x y" -z').count() == built.semantic("x").count() == built.search("x").count() == 0


@pytest.mark.parametrize("mode", ["hybrid", "keyword", "semantic", "wiki_first"])
def test_every_mode_shows_gated_hits_without_near_equal_ones(spark, tmp_path, mode):
    same = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [entry("d/a.md", body=same), entry("d/b.md", body=same, title="d/a.md"), entry("d/c.md", body="alpha beta and other words altogether"), entry("d/d.md", body=same, published="draft")]
    built = Index.of(kb(spark, *rows)).write(f"file://{tmp_path}/kb")
    got = built.search("alpha beta", mode, 10).collect()
    assert [r.path for r in got if r.path != "d/c.md"] == ["d/a.md"] and {r.path for r in got} == {"d/a.md", "d/c.md"}
    assert all(r.domain == "d" and r.title and r.snippet.startswith("alpha beta") for r in got)
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_wiki_first_takes_index_lines_then_titles_then_bodies_then_orphans(spark):
    e = kb(
        spark, entry("d/a.md", body="> [!ABSTRACT]\n  about Foxes \nx"), entry("d/b.md", title="foxes and hens"), entry("d/c.md", body="see foxes"),
        entry("d/d.md", related=["d/e.md"]), entry("d/e.md"), entry("d/foxes.md"),
    )
    found = lambda q: [(r.path, r.score) for r in retrieval.wiki_first_search(e, q, 10, graph.orphans(e)).collect()]
    assert found("foxes") == [("d/a.md", 1.0), ("d/foxes.md", 1.0), ("d/b.md", 0.95), ("d/c.md", 0.75)]
    assert found("no such words") == [("d/a.md", 0.1), ("d/b.md", 0.1), ("d/c.md", 0.1)]


@pytest.mark.parametrize("block", [30, 4000])
def test_near_duplicates_are_all_found_and_few_pairs_compared(spark, block):
    import numpy as np

    e = entries(spark, "/root/testdata/sf0.001")
    rows = retrieval.vectors(e).collect()
    paths = sorted({r.path for r in rows})
    x, at = np.zeros((len(paths), scores.DIM)), {p: i for i, p in enumerate(paths)}
    for r in rows:
        x[at[r.path], r.bucket] = r.weight
    for least in (0.92, 0.6):
        want = {(paths[i], paths[j]) for i, j in np.argwhere(np.round(x @ x.T, 4) >= least) if i < j}
        got = [(r.a, r.b) for r in similarity.near_duplicates(e, least, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    work = similarity.near_duplicate_work(e, block=block).first()
    assert work.compared <= work.met <= work.pairs and work.compared < 0.2 * work.pairs


@pytest.mark.parametrize("block", [2, 1000])
def test_drift_takes_every_tag_and_only_old_pairs(spark, block):
    day = lambda n: F.timestamp_add("DAY", F.lit(n), F.lit("2024-01-01").cast("timestamp"))
    rows = [(f"p{i}", f"w{i} x{i} y{i}", ["z", "hot"] if i % 2 else ["hot"], 89 * (i % 3 == 1) + 200 * (i % 3 == 2)) for i in range(9)]
    table = spark.createDataFrame(rows, "path string, title string, tags array<string>, n int").withColumns({"created": F.timestamp_add("DAY", F.col("n"), day(0)), "body": F.lit(""), "domain": F.lit("d")})
    got = sorted((r.a, r.b, r.tag) for r in similarity.drift_pairs(table, most=1.1, block=block).collect())
    assert got == sorted((x[0], y[0], "hot") for x in rows for y in rows if x[0] < y[0] and abs(x[3] - y[3]) >= 90)


def test_pairs_of_near_and_of_drifting_entries_are_not_shuffled(spark):
    e = entries(spark, "/root/testdata/sf0.001")
    for found in (similarity.drift_pairs(e), similarity.near_duplicates(e)):
        above = found._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
        assert "Exchange" not in above and "Join" not in above


def test_pairs_of_a_group_leave_it_in_several_rows(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "PAIRS", 2)
    block = pa.table({"path": ["b", "a", "c"], "title": ["B", None, "C"]})
    parts = [(np.array([0]), np.array([1]), np.array([0.5])), (np.array([0, 1]), np.array([2, 2]), np.array([0.1, 0.2])), (np.array([2]), np.array([1]), np.array([0.3]))]
    out = similarity._found(block, "t", iter(parts))
    assert len(out) == 2
    got = [(own[r["p"]]["path"], own[r["q"]]["path"], r["similarity"]) for own, pairs in zip(out["own"].to_pylist(), out["pairs"].to_pylist()) for r in pairs]
    assert got == [("a", "b", 0.5), ("b", "c", 0.1), ("a", "c", 0.2), ("a", "c", 0.3)]


def test_new_tag_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    from paperloom.operators import graph_store

    monkeypatch.setattr(graph_store, "CHUNK", 2)
    rows = [(f"p{i}", ["x", "y"] if i < 7 else ["x", "y", "z"] if i < 9 else ["w"]) for i in range(11)]
    nodes = spark.createDataFrame(rows, "path string, tags array<string>")
    found = graph_store._new_pairs(nodes.filter(F.col("path").isin([f"p{i}" for i in range(5)])), nodes)
    changed, tags = {f"p{i}" for i in range(5)}, {p: set(t) for p, t in rows}
    want = sorted((p, q) for p in tags for q in tags if p != q and {p, q} & changed and len(tags[p] & tags[q]) / len(tags[p] | tags[q]) >= 0.3)
    assert sorted((r.src, r.dst) for r in found.collect()) == want and len(want) > 20
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert "Aggregate" not in above and "Join" not in above


def test_terms_are_counted_in_place_and_shuffled_once_a_step(spark):
    e = kb(spark, entry("d/a.md", title="", body="b a b"), entry("d/b.md", title="", body=""), entry("d/c.md", title="", body="aa a, aa bb aa"))
    terms = retrieval.vector_terms(e)
    assert sorted((r.path, r.term, r.tf) for r in terms.collect() if r.path == "d/c.md" and r.term != "md") == [("d/c.md", "aa", 3), ("d/c.md", "bb", 1)]
    made = spark.range(0).select(F.lit("p").alias("path"), F.lit("t").alias("title"), F.lit("b").alias("body"))
    assert "Exchange" not in retrieval.vector_terms(made)._jdf.queryExecution().executedPlan().toString()
    postings = {(r.term, r.field): (r.tf, r.size, r.positions) for r in Index.of(e).postings.filter("path = 'd/c.md'").collect()}
    assert postings["aa", "body"] == (3, 6, [0, 3, 5]) and postings[",", "body"] == (1, 6, [2]) and postings["a", "body"] == (1, 6, [1])


def test_postings_and_vectors_are_made_where_the_text_is(spark):
    made = spark.range(3).select(
        F.concat(F.lit("p"), "id").alias("path"), F.lit("t").alias("title"), F.lit("d").alias("domain"), F.lit("published").alias("publish_status"), F.lit(1.0).alias("quality_score"), F.lit("aa bb aa").alias("body"), F.array(F.lit("x")).alias("tags")
    )
    built = Index.of(made)
    for df in (built.postings, built.bounds, built.vectors):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert values(built.bounds.filter("term = 'aa'").groupBy("term", "field").agg(F.sum("n"), F.max("tf"), F.min("size")), "term", "field", "sum(n)", "max(tf)", "min(size)") == [("aa", "body", 3, 2, 3)]


def test_vectors_are_the_same_where_few_terms_are_sent_to_the_tasks(spark, monkeypatch):
    e = entries(spark, "/root/testdata/sf0.001").limit(40).localCheckpoint()
    want = {(r.path, r.bucket): r.weight for r in retrieval.vectors(e).collect()}
    monkeypatch.setattr(retrieval, "LOCAL_TERMS", 20)
    found = retrieval.vectors(e).collect()
    assert {(r.path, r.bucket): r.weight for r in found} == pytest.approx(want) and len(found) == len(want)


def test_a_keyword_search_reads_every_text_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "string")
    e = kb(spark, *[entry(f"d{i % 2}/{i}.md", body=f"alpha w{i}") for i in range(20)])
    for search in (retrieval.keyword_search, retrieval.sharded_search):
        before = seen.value
        assert search(e.withColumn("body", count("body")), "alpha w3", 1).first().path == "d1/3.md"
        assert seen.value - before == 20


def test_a_phrase_brings_together_lists_of_places(spark):
    built = Index.of(kb(spark, entry("d/a.md", body="x y x y y"), entry("d/b.md", body="y x")))
    found = built.matches('"x y"')
    assert values(found, "path") == [("d/a.md",)]
    assert "flatten" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x)


def test_front_matter_is_read_by_the_loader_in_c(monkeypatch):
    import yaml

    source = "title: t\ndomain: d\ncreated: 2024-01-01\nupdated: 2024-01-02T00:00:00Z\n"
    if yaml.__with_libyaml__:
        with monkeypatch.context() as m:
            m.setattr(yaml.SafeLoader, "__init__", lambda self, stream: 1 / 0)
            assert documents.parse_front_matter(source)["title"] == "t"
    assert documents.parse_front_matter(source + "status: \tx\n") is None


def test_a_concept_map_needs_no_pairs_of_tags(spark, monkeypatch, tmp_path):
    from paperloom.plans import catalog

    e = kb(spark, entry("d/a.md", ["x"], ["d/b.md"]), entry("d/b.md", ["x"]))
    made = graph_store.GraphStore.of(e, tags=False)
    assert values(graph.concept_map(made.references, "d/a.md", 2), "src", "dst") == [("d/a.md", "d/b.md")] and made.pairs.count() == 0
    monkeypatch.setattr(graph, "tag_edges", lambda *_: 1 / 0)
    monkeypatch.setattr(catalog, "_graph_store", lambda *_: 1 / 0)
    monkeypatch.setattr(catalog.generations, "current", lambda *_: None)
    assert catalog.queries()["concept_map_edges"](spark, "/root/testdata/sf0.001").count() > 0


def test_tables_of_a_build_are_packed_by_zstd(spark, tmp_path, monkeypatch):
    packed, plain = {}, indexes._stored

    def stored(df, to):
        plain(df, to)
        for file in Path(to.removeprefix("file://")).glob("*.parquet"):
            packed.setdefault(to.rsplit("/", 1)[1], set()).update(of.row_group(i).column(0).compression for of in [pq.read_metadata(file)] for i in range(of.num_row_groups))

    monkeypatch.setattr(indexes, "_stored", stored)
    Index.build(kb(spark, entry("d/a.md", body="alpha beta"), entry("d/b.md", body="alpha")), f"file://{tmp_path}/kb")
    assert packed == dict.fromkeys([*indexes.STORED, "tokens"], {"ZSTD"})


def test_counts_of_terms_open_no_block(spark, tmp_path):
    e = kb(spark, entry("d/a.md", body="alpha beta alpha", tags=("alpha",)), entry("d/b.md", body="alpha"))
    built = Index.build(e, f"file://{tmp_path}/kb")
    for index in (built, built.upserted(kb(spark, entry("d/b.md", body="alpha")))):
        assert [(r.n, r.tf) for r in index.term_counts().filter("term = 'alpha'").collect()] == [(3, 4)]
    assert "Generate" not in built.term_counts()._jdf.queryExecution().executedPlan().toString()


def test_similarities_are_rounded_as_spark_rounds_and_pairs_survive_their_code(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    value = np.concatenate([np.round(rng.random(3000), 5), rng.random(3000), [0.00005, 0.12345, 0.99995, 1.0000000000000002, -0.00005, -1.0, 0.0]])
    want = [r.x for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "i int, v double").orderBy("i").select(F.round("v", 4).alias("x")).collect()]
    assert (similarity._units(value) / similarity.UNIT).tolist() == want
    monkeypatch.setattr(similarity, "SENT", 100)
    n = len(value)
    block = pa.table({"path": [f"p{i:05d}" for i in range(n)], "title": [None if i % 9 == 0 else f"t{i}" for i in range(n)]})
    parts = similarity._rounded(iter([(np.arange(n), (np.arange(n) + 5) % n, value)]), lambda x: x > -2)
    batches = list(similarity._sent(block, "t", parts))
    assert all(len(x) <= 100 for b in batches for x in b["pairs"].to_pylist()) and sum(len(x) for b in batches for x in b["pairs"].to_pylist()) == n
    rows = [r for b in batches for r in b.to_pylist()]
    got = sorted((r.a, r.b, r.b_title, r.tag, r.similarity) for r in similarity._named(spark.createDataFrame([(r["tag"], r["path"], r["title"], r["pairs"]) for r in rows[:3]], similarity._CODED)).collect())
    name = lambda i: (f"p{i:05d}", None if i % 9 == 0 else f"t{i}")
    assert got == sorted((name(i)[0], *name(i + 5), "t", want[i]) for i in range(300))


@pytest.mark.parametrize("block", [2, 1000])
def test_worst_drift_is_the_least_of_all_pairs_and_counts_them(spark, block):
    e = entries(spark, "/root/testdata/sf0.001")
    pairs = sorted((r.similarity, r.a, r.b) for r in similarity.drift_pairs(e, block=block).collect())
    found = similarity.worst_drift(e, block=block).collect()
    assert sum(r.n for r in found) == len(pairs) > 100
    assert min((r.similarity, r.a, r.b) for r in found) == pairs[0] and len(found) < len(pairs)


@pytest.mark.parametrize("cell_least", [5, 40])
def test_cells_lie_together_in_few_blocks_and_no_near_pair_is_lost(spark, monkeypatch, cell_least):
    monkeypatch.setattr(similarity, "CELL_LEAST", cell_least)
    e = entries(spark, "/root/testdata/sf0.001")
    want = sorted((r.a, r.b, r.similarity) for r in similarity.near_duplicates(e, 0.7, block=10**6).collect())
    for block in (25, 90):
        assert sorted((r.a, r.b, r.similarity) for r in similarity.near_duplicates(e, 0.7, block=block).collect()) == want and len(want) > 50
    dealt, _ = similarity._blocks(e, 0.7, 90)
    sent = dealt.groupBy("path").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    assert sent <= max(-(-200 // 90) + 2, int((2 * similarity.TILES * spark.sparkContext.defaultParallelism) ** 0.5) + 2)


def test_tag_pairs_are_turned_by_whole_arrays_and_few_are_held_at_a_time(spark):
    nodes = spark.createDataFrame([(f"p{i}", ["x", "y"]) for i in range(9)], "path string, tags array<string>")
    found = graph_store._new_pairs(nodes.filter(F.col("path").isin("p1", "p2")), nodes)
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert above.count("Generate") == 3 and above.index("explode(dst") < above.index("inline(") and graph_store.CHUNK**2 <= 50_000
    want = sorted((f"p{i}", f"p{j}") for i in range(9) for j in range(9) if i != j and {i, j} & {1, 2})
    assert sorted((r.src, r.dst) for r in found.collect()) == want


def test_an_index_is_built_of_small_batches_and_the_session_keeps_its_own(spark, tmp_path, monkeypatch):
    from paperloom import session

    e = entries(spark, "/root/testdata/sf0.001").coalesce(1)
    whole = Index.build(e, str(tmp_path / "whole"))
    monkeypatch.setattr(session, "BATCH_BYTES", 50_000)
    small = Index.build(e, str(tmp_path / "small"))
    paths = lambda x: x.blocks.select(F.explode("paths").alias("p")).distinct().count()
    zones = lambda x: x.blocks.select("zone").distinct().count()
    assert zones(small) > 2 * zones(whole) and paths(small) == paths(whole) == e.count()
    counts = lambda x: sorted((r.term, r.n, r.tf) for r in x.term_counts().collect())
    assert counts(small) == counts(whole)
    assert small.keyword("the and", 10).collect() == whole.keyword("the and", 10).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22)
    try:
        with session.bounded_batches(spark):
            assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 22)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 22)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
