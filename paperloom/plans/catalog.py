"""Registry of the engine's queries: operators applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import rules, text
from paperloom.operators import actions, bases, changes, documents, governance, graph, graph_store, jobs, relational, retrieval, similarity
from paperloom.operators import index as indexes
from paperloom.plans import generations, oracles
from paperloom.session import table
from paperloom.sources.tables import AS_OF, entries
from paperloom.streaming import events as streams

QUERY = "the thhentha estion worthless"
TERM = "estion"
KEYWORDS = ["estion", "worthless", "The"]
PHRASES = '"of the" "is the and"'
BOOLEAN = "+worthless +the -tags:src3 estion"
BY_FIELD = 'title:21 tags:src3 body:"and the"'
CENTER = "area0/21.md"

E = Callable[[DataFrame], DataFrame]


def _on_entries(fn: E) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(entries(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, own = F.concat(F.lit("raw/"), F.col("doc_id").cast("string")), F.sha2(F.coalesce("text", F.lit("")), 256)
    sources = docs.select(path.alias("path"), own.alias("hash"))
    outputs = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("entry.md")))
    state = docs.filter("doc_id % 3 <> 0").select(
        path.alias("path"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(own).alias("source_hash"),
        outputs.alias("outputs"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("v1")).when(F.col("doc_id") % 4 == 1, F.lit("v2")).alias("instruction_hash"),
    )
    return sources, state


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.lit("wiki/"), F.col("doc_id").cast("string")).alias("path")
    local = changes.manifest(docs.filter("doc_id % 4 <> 0").select(path, F.col("text").alias("content")))
    other = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return local, changes.manifest(docs.filter("doc_id % 5 <> 0").select(path, other.alias("content")))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("status"))


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as pages."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("pages"))


def _job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the steps of a job per user and day."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    action = F.when(kind == "click", "start").when(kind == "view", "succeed").when(kind == "error", "fail").when(kind == "signup", "complete").otherwise("await")
    stage = F.when(action.isin(*jobs.STEPS), F.element_at(F.array(*[F.lit(s) for s in jobs.STAGES]), (F.col("event_id") % 2 + F.hour("ts") % 2 * 2 + 1).cast("int")))
    detail = F.when(kind == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).when(kind == "signup", F.when(F.col("event_id") % 2 == 0, "completed").otherwise("partial"))
    job = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "dd"))
    return e.select(job.alias("job"), F.col("event_id").alias("seq"), "ts", action.alias("action"), stage.alias("stage"), detail.alias("detail"))


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("latency"), (F.col("event_id") % 10 == 0).alias("failed"))


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("holder"), F.col("ts").alias("taken"), F.lit(300).alias("ttl"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("page", "text"))
    return lines.select("doc", (F.col("page") + 1).cast("long").alias("page"), "text")


def _versions(e: DataFrame) -> DataFrame:
    return e.select("path", F.explode(F.sequence(F.lit(0), "version")).alias("version")).withColumn("hash", F.sha2(F.concat_ws("@", "path", F.col("version").cast("string")), 256))


def _graph(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = entries(spark, sf_dir)
        return fn(e, graph.edges(e))

    return query


def _references(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = entries(spark, sf_dir)
        return fn(e, graph.reference_edges(e))

    return query


def _embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    first = rows.orderBy("vec_id").first()
    return retrieval.embedding_topk(rows, list(first["embedding"])) if first else rows.select("vec_id", F.lit(0.0).alias("score"))


def _parsed(e: DataFrame) -> DataFrame:
    return documents.parse_entries(documents.to_markdown(e)).select("path", "title", "domain", "level", "quality_score", "version", F.array_join("tags", ",").alias("tags"), "created", "body")


def _upserted(e: DataFrame) -> DataFrame:
    own = retrieval.vectors(e)
    changed = own.filter(F.endswith("path", F.lit("7.md"))).withColumn("weight", F.lit(0.0))
    return retrieval.upserted(own, changed).groupBy("path").agg(F.count("*").alias("buckets"), F.round(F.sum("weight"), 3).alias("weight"))


def _near_query(e: DataFrame) -> DataFrame:
    return retrieval.presented(retrieval.keyword_search(e, QUERY, 20), e, QUERY)


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of an index, built anew."""
    made, rows = indexes.Index.build(entries(spark, sf_dir), indexes.new_root(spark, "build")), None
    for name in ("postings", "fields", "weights", "vectors", "shown"):
        one = getattr(made, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _index(spark: SparkSession, sf_dir: str) -> indexes.Index:
    """The stored index of a folder's entries, built at the first search of a session."""
    return indexes.stored(spark, "entries", lambda: entries(spark, sf_dir), [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")])


def _on_index(fn: Callable[[indexes.Index], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_index(spark, sf_dir))


def _graph_store(spark: SparkSession, sf_dir: str) -> graph_store.GraphStore:
    """The stored graph of a folder's entries, built at the first use in a session."""
    root = indexes.stored_root(spark, "graph", [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")])
    return graph_store.GraphStore.current(spark, root, lambda: entries(spark, sf_dir))


def _reference_store(spark: SparkSession, sf_dir: str) -> graph_store.GraphStore:
    """The stored graph for what follows references only: pairs of similar tags are not made for it."""
    files = [f"{sf_dir}/{t}.parquet" for t in ("documents", "labels")]
    if generations.current(spark, indexes.stored_root(spark, "graph", files)):
        return _graph_store(spark, sf_dir)
    return graph_store.GraphStore.current(spark, indexes.stored_root(spark, "references", files), lambda: entries(spark, sf_dir), tags=False)


def _on_references(fn: Callable[[graph_store.GraphStore], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_reference_store(spark, sf_dir))


def _on_graph(fn: Callable[[graph_store.GraphStore], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_graph_store(spark, sf_dir))


def _upserted_graph(spark: SparkSession, sf_dir: str) -> graph_store.GraphStore:
    """The stored graph after one domain's entries got other tags and links and some entries went."""
    e = entries(spark, sf_dir)
    tags, related = F.array(F.lit("src3"), F.lit("new")), F.array(F.lit("AREA0/21.md"))
    changed = e.filter("domain = 'area1' and doc_id % 50 <> 3").withColumns({"tags": tags, "related": related, "body": F.lit("[[area2/2.md]]")})
    return _graph_store(spark, sf_dir).upserted(changed, e.filter("doc_id % 50 = 3"))


def _upserted_index(spark: SparkSession, sf_dir: str) -> indexes.Index:
    """The stored index after the entries of one domain got another body."""
    changed = entries(spark, sf_dir).filter("domain = 'area1'").withColumn("body", F.lit("worthless estion"))
    return _index(spark, sf_dir).upserted(changed)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).search(QUERY, "hybrid", 10)


def _timed_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifests with times of change: every third remote file is newer."""
    local, remote = _manifests(spark, sf_dir)
    number = F.substring_index("path", "/", -1).cast("long")
    at = lambda days: F.timestamp_add("DAY", days, F.lit("2024-01-01").cast("timestamp"))
    return local.withColumn("modified", at(F.lit(5))), remote.withColumn("modified", at(F.when(number % 3 == 0, 9).otherwise(1)))


def _store_after_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    store = changes.pushed(docs.filter("doc_id % 5 <> 0"))
    return store.unionByName(changes.pushed(docs.filter("doc_id % 4 <> 0"), store)).select("object_key", F.octet_length("content").cast("long").alias("bytes"))


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".md", ".compile_prompt.md", ".webp", ".txt", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ends).alias("name"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 4 == 0, "boolean").when(i % 4 == 1, "percentage").when(i % 4 == 2, "targeted").otherwise("other")
    on = rules.flag_on(kind, F.when(i % 8 < 4, 0).otherwise(100), F.array(F.lit("1"), F.lit("2"), F.lit("3")), F.col("user_id").cast("string"))
    return e.select("event_id", on.alias("is_on"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for a layout model's answers: two boxes within a document's first words."""
    i, head = F.col("doc_id").cast("string"), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-zA-Z ]", ""), 1, 200)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(head, F.lit(" ["), i, F.lit(", 2,3 ,"), i, F.lit("] table ["), i, F.lit(",0,0,1] "), head).alias("answer"))


def _first_page(hits: DataFrame, e: DataFrame) -> DataFrame:
    return retrieval.with_entry(hits, e, TERM).select("path", "title", "score", "snippet")


def _listing(e: DataFrame) -> DataFrame:
    return e.select("path", "title", "domain", F.array_join("tags", ",").alias("tags"), "level")


def _state_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, state = _sources(spark, sf_dir)
    todo = changes.sources_to_compile(sources, state).select("path")
    new = sources.join(todo, "path", "left_semi").select("path", F.col("hash").alias("source_hash"))
    return changes.merged(state.select("path", "source_hash"), new)


def _queries() -> dict:
    search = lambda e: retrieval.keyword_search(e, QUERY, 10)
    return {
        # scans and projections
        "scan_fulltext_docs": _on_entries(lambda e: retrieval.searchable(e).select("path", "title", "domain", F.array_join("tags", " ").alias("tags"), F.length("body").cast("long").alias("chars"))),
        "scan_graph_nodes": _on_entries(lambda e: graph.nodes(e).select("path", "title", "domain", F.array_join("tags", ",").alias("tags"), "level")),
        "scan_embedding_docs": _on_entries(lambda e: retrieval.searchable(e).select("path", F.sha2(F.concat_ws(" ", "title", "body"), 256).alias("text_hash"))),
        "wiki_entry_listing": _on_entries(_listing),
        "entries_by_domain": _on_entries(lambda e: e.groupBy(text.domain_of_path(F.col("path")).alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("quality"))),
        "scan_quality_entries": _on_entries(lambda e: e.select("path", "quality_score", "status", "publish_status", F.size("tags").cast("long").alias("n_tags"))),
        "wiki_index_rows": _on_entries(lambda e: documents.index_page(e).select("domain", "place", "line")),
        "discover_domains": _on_entries(lambda e: e.select("domain").distinct()),
        "log_tail": lambda s, d: changes.log_tail(_jobs(s, d), 20).select("job", "seq", "status"),
        "entry_point_lookup": _on_entries(lambda e: e.filter((F.col("domain") == "area0") & (F.col("path") == CENTER)).select("path", "title", "version")),
        "domain_listing": _on_entries(lambda e: e.groupBy("domain").agg(F.count("*").alias("n"), F.min("path").alias("first"))),
        "reflow_text": _on_entries(lambda e: e.select("path", F.sha2(text.reflowed(F.col("body")), 256).alias("reflowed"))),
        "front_matter_split": _on_entries(lambda e: documents.to_markdown(e).select("path", *documents.front_matter(F.col("content"))).select("path", F.length("yaml").cast("long").alias("yaml_chars"), F.sha2("body", 256).alias("body_hash"))),
        "parse_light_meta": _on_entries(lambda e: documents.light_meta(documents.to_markdown(e))),
        "parse_entries": _on_entries(_parsed),
        "searchable_entries": _on_entries(lambda e: retrieval.searchable(e).select("path", "quality_score")),
        "minimal_quality": _on_entries(lambda e: retrieval.minimal_quality(e).select("path")),
        "page_range_select": _on_entries(lambda e: e.select("path", F.explode(documents.page_numbers(F.col("page"), 10)).alias("page"))),
        "path_safety": _on_entries(lambda e: e.select("path", documents.safe(F.concat(F.when(F.col("doc_id") % 10 == 0, "../").when(F.col("doc_id") % 10 == 1, "/").otherwise(""), "path")).alias("ok"))),
        "canonical_paths": _on_entries(lambda e: e.select("path", text.safe_path(F.col("domain"), F.col("title")).alias("canonical"))),
        "titles_of_paths": _on_entries(lambda e: e.select("path", text.title_of_path(text.safe_path(F.col("domain"), F.col("title"))).alias("title"))),
        "normal_tags": _on_entries(lambda e: e.select("path", F.array_join(text.normal_tags(F.transform("tags", lambda t: F.concat(F.lit(" "), F.upper(t)))), ",").alias("tags"))),
        "truncated_bodies": _on_entries(lambda e: e.select("path", text.truncated(F.col("body"), 120).alias("body"))),
        "patch_section": _on_entries(lambda e: documents.with_sections(e, F.col("title"), "put here").select("path", "version", "body")),
        "patch_front_matter": _on_entries(lambda e: documents.with_front_matter(e, level=F.lit("L1"), title=F.trim("title")).select("path", "title", "level", "version")),
        "layout_regions": lambda s, d: documents.regions(_answers(s, d)).select("id", "place", F.array_join("box", ",").alias("box"), "context"),
        "raw_sources_by_kind": lambda s, d: _raw_names(s, d).groupBy(rules.source_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n")).filter("kind is not null"),
        "markdown_structure": _on_entries(documents.structure),
        "file_info": lambda s, d: table(s, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"), rules.megabytes(F.octet_length("html")).alias("megabytes")),
        "escalations": lambda s, d: documents.page_facts(table(s, d, "pages")).select("page_id", rules.escalation(F.col("text_chars"), (F.col("page_id") % 10) / 10.0, 400).alias("escalate")),
        "result_previews": _on_entries(lambda e: e.select("path", F.sha2(rules.preview(F.regexp_replace("body", r"[^a-zA-Z ]", " "), 300), 256).alias("preview_hash"))),
        "longest_extraction": lambda s, d: table(s, d, "documents").select("doc_id", F.length(F.when(F.length(F.coalesce("text", F.lit(""))) >= F.length("source"), F.coalesce("text", F.lit(""))).otherwise(F.col("source"))).cast("long").alias("chars")),
        "page_facts": lambda s, d: documents.page_facts(table(s, d, "pages")),
        "probe_quality": lambda s, d: documents.page_facts(table(s, d, "pages")).join(table(s, d, "pages").select("page_id", F.octet_length("html").alias("size")), "page_id").select("page_id", documents.probe_quality(F.col("text_chars"), F.col("size")).alias("method")),
        "line_diff": _on_entries(lambda e: e.select("path", F.sha2(documents.line_diff(F.col("body"), F.replace("body", F.lit("the"), F.lit("THE"))), 256).alias("diff"))),
        "patch_search_replace": _on_entries(lambda e: documents.patched(e, "the ", "THE ").select("path", "version", F.sha2("body", 256).alias("body_hash"))),
        "wiki_tree": _on_entries(documents.tree),
        "highlight_hits": _on_entries(lambda e: e.filter(F.contains(F.lower("body"), F.lit(TERM))).select("path", F.sha2(text.highlighted(F.col("body"), TERM), 256).alias("marked"), F.regexp_count("body", F.lit(f"(?i){TERM}")).cast("long").alias("n"))),
        "search_snippets": _on_entries(lambda e: e.filter(F.contains(F.lower("body"), F.lit(TERM))).select("path", F.sha2(text.snippet(F.col("body"), TERM), 256).alias("snippet"))),
        # graph
        "edges_related": _on_entries(graph.related_edges),
        "edges_contradiction": _on_entries(graph.contradiction_edges),
        "edges_wikilink": _on_entries(graph.wikilink_edges),
        "edges_tag_cooccurrence": _on_entries(graph.tag_edges),
        "graph_edges": _graph(lambda e, g: g.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))),
        "graph_stats": _graph(graph.stats),
        "suggest_links": _on_entries(lambda e: graph.suggest_links(e, CENTER)),
        "suggest_links_by_tags": _on_entries(lambda e: graph.suggest_by_tags(e, ["src3", "g4", "h2"], 10)),
        "find_orphans": _on_entries(graph.orphans),
        "backlinks": _on_entries(lambda e: graph.backlinks(e, CENTER)),
        "reference_in_degree": _references(lambda e, g: graph.in_degree(g)),
        "load_bearing_entries": _references(lambda e, g: graph.load_bearing(g, 2)),
        "neighbors_nhop": _on_references(lambda g: graph.neighbors(g.references, CENTER, 3)),
        "concept_map_edges": _on_references(lambda g: graph.concept_map(g.references, CENTER, 2)),
        "concept_map_text": _on_references(lambda g: graph.concept_map_text(g.nodes, g.references, CENTER, 2).select(F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("chars"))),
        "graph_after_upsert": lambda s, d: _upserted_graph(s, d).counted(),
        "stored_graph_stats": _on_graph(lambda g: graph.stats(g.nodes, g.edges)),
        "confidence_propagation": _on_entries(graph.propagate_confidence),
        "propagation_write_back": _on_entries(lambda e: graph.written_back(e, graph.propagate_confidence(e)).select("path", "confidence", "status")),
        "domain_partitions": _graph(graph.domain_partitions),
        "domain_subgraph": _graph(lambda e, g: graph.subgraph(e, g, "area2").groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))),
        "propagation_summary": _on_entries(lambda e: graph.propagation_summary(graph.propagate_confidence(e))),
        "cognitive_diversity": _graph(graph.diversity),
        "diversity_warnings": _graph(graph.diversity_warnings),
        "communities": _graph(graph.communities),
        "aggregation_candidates": _graph(lambda e, g: graph.aggregation_candidates(e, graph.communities(e, g))),
        # governance
        "quality_issues": _on_entries(governance.issues),
        "quality_issues_filtered": _on_entries(lambda e: governance.list_issues(e, "warn").select("path", "severity", "message")),
        "list_quality_issues": _on_entries(governance.list_issues),
        "quality_snapshot": _on_entries(lambda e: governance.list_issues(e, limit=20).select("path", "severity", "message")),
        "fix_suggestions": _on_entries(lambda e: governance.fix_suggestions(governance.list_issues(e))),
        "broken_links": _on_entries(governance.broken_links),
        "referenced_paths": _on_entries(governance.referenced),
        "quality_orphans": _on_entries(governance.quality_orphans),
        "avg_quality_score": _on_entries(governance.average_quality),
        "distinct_domains": _on_entries(lambda e: e.agg(F.countDistinct("domain").alias("domains"))),
        "entries_per_domain": _on_entries(lambda e: e.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("n"))),
        "contradiction_pairs": _on_entries(governance.contradiction_pairs),
        "contradiction_pairs_enriched": _on_entries(governance.contradiction_pairs_titled),
        "contradictions_explicit": _on_entries(lambda e: governance.contradiction_pairs(e, resolved=False)),
        "contradiction_pair_count": _on_entries(lambda e: governance.contradiction_pairs(e, resolved=False).agg(F.count("*").alias("pairs"))),
        "contradiction_issues": _on_entries(governance.contradiction_issues),
        "publish_gate": _on_entries(governance.publish_gate),
        "gate_summary": _on_entries(lambda e: governance.gate_summary(governance.publish_gate(e))),
        "stale_entries": _on_entries(lambda e: governance.stale(e, AS_OF)),
        "drift_pairs": _on_entries(similarity.drift_pairs),
        "next_actions": _on_entries(governance.next_actions),
        "planned_actions": _on_entries(lambda e: actions.planned_actions(e, similarity.worst_drift(e))),
        "quality_report_full": _on_entries(lambda e: actions.full_report(e, similarity.drift_pairs(e))),
        "quality_snapshot_counts": _on_entries(governance.snapshot_counts),
        "quality_report_lines": _on_entries(governance.report_lines),
        "meta_lint": _graph(lambda e, g: governance.meta_lint(e, g, AS_OF)),
        "near_duplicate_pairs": _on_entries(similarity.near_duplicates),
        "missing_concept_hints": _on_entries(governance.missing_concepts),
        "lint_summary": _on_entries(lambda e: governance.lint_summary(e, AS_OF)),
        "health_report": _on_entries(governance.health_report),
        # retrieval
        "bm25_keyword_search": _on_index(lambda x: x.keyword(QUERY, 10)),
        "index_build": _built,
        "phrase_search": _on_index(lambda x: x.find(PHRASES, 20)),
        "boolean_search": _on_index(lambda x: x.find(BOOLEAN, 20)),
        "field_search": _on_index(lambda x: x.find(BY_FIELD, 20)),
        "scan_keyword_search": _on_entries(search),
        "scan_semantic_search": _on_entries(lambda e: retrieval.semantic_search(e, QUERY, 10)),
        "index_postings": _on_index(lambda x: x.term_counts()),
        "index_sizes": _on_index(lambda x: x.stats.select("field", F.round("mean", 6).alias("mean"), "total")),
        "index_upsert": lambda s, d: _upserted_index(s, d).fields.groupBy("field").agg(F.count("*").alias("n"), F.sum("size").alias("size")),
        "index_upsert_search": lambda s, d: _upserted_index(s, d).keyword("worthless", 5),
        "sharded_search": _on_entries(lambda e: retrieval.sharded_search(e, QUERY, 10)),
        "light_hits": _on_entries(lambda e: _first_page(retrieval.keyword_search(e, QUERY, 10), e)),
        "corpus_texts": _on_entries(lambda e: e.select("path", F.sha2(F.concat_ws(" ", "title", "body"), 256).alias("text_hash"))),
        "keyword_search_domain": _on_entries(lambda e: retrieval.keyword_search(e, QUERY, 10, "area3")),
        "search_gate_semi_join": _on_entries(lambda e: retrieval.gated(retrieval.keyword_search(e, QUERY, 100), e, 5)),
        "search_domain_facets": _on_entries(lambda e: retrieval.facets(retrieval.keyword_search(e, QUERY, 50), e)),
        "tfidf_document_frequency": _on_entries(lambda e: retrieval.document_frequency(retrieval.vector_terms(e))),
        "tfidf_term_frequency": _on_entries(lambda e: retrieval.vector_terms(e).select("path", "term", "tf")),
        "tfidf_idf": _on_entries(lambda e: retrieval.idf(e, retrieval.vector_terms(e)).select("term", F.round("idf", 6).alias("idf"), "bucket")),
        "tfidf_vectors": _on_entries(lambda e: retrieval.vectors(e).select("path", "bucket", F.round("weight", 6).alias("weight"))),
        "vector_upsert": _on_entries(_upserted),
        "semantic_search": _on_index(lambda x: x.semantic(QUERY, 10)),
        "embedding_topk": _embedding_query,
        "rrf_fusion": _on_entries(lambda e: retrieval.fuse(retrieval.keyword_search(e, QUERY, 20), retrieval.semantic_search(e, QUERY, 20))),
        "hybrid_search": flagship,
        "search_dedup": _on_entries(_near_query),
        "search_meta": _on_entries(lambda e: retrieval.search_meta(e, retrieval.search(e, QUERY, "keyword"), "fulltext")),
        "recompile_candidates": lambda s, d: bases.recompile_candidates(entries(s, d).withColumn("source", F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))).withColumn("source_hash", F.when(F.col("doc_id") % 3 == 0, F.lit("old"))), _sources(s, d)[0]),
        "wiki_first_search": _on_entries(lambda e: retrieval.wiki_first_search(e, "number 7", 10, graph.orphans(e))),
        "wiki_first_fallback": _on_entries(lambda e: retrieval.wiki_first_search(e, "no such words", 10, graph.orphans(e))),
        "fallback_scan_search": _on_entries(lambda e: retrieval.scan_search(e, QUERY, 10)),
        "keyword_hits_with_page": lambda s, d: retrieval.keyword_hits_with_page(_pages(s, d), TERM),
        "keyword_positions": lambda s, d: retrieval.keyword_positions(_paged(s, d), KEYWORDS, context=20),
        "pages_with_matches": lambda s, d: retrieval.pages_with_matches(retrieval.keyword_positions(_paged(s, d), KEYWORDS)),
        "api_catalog_search": lambda s, d: retrieval.catalog_search(table(s, d, "items").select("name", F.col("brand").alias("description"), F.col("kind").alias("category")).distinct(), "bolt"),
        "agent_context": lambda s, d: retrieval.agent_context(entries(s, d), _reference_store(s, d).references, CENTER, QUERY),
        # changes
        "sources_needing_compile": lambda s, d: changes.sources_to_compile(*_sources(s, d)),
        "stale_by_instruction": lambda s, d: changes.stale_by_instruction(_sources(s, d)[1], "v2"),
        "source_state_upsert": _state_after,
        "sync_manifest": lambda s, d: _manifests(s, d)[0],
        "sync_root_hash": lambda s, d: changes.root_hash(_manifests(s, d)[0]),
        "merkle_root": lambda s, d: changes.merkle_root(_manifests(s, d)[0]),
        "sync_conflicts": lambda s, d: changes.conflicts(*_manifests(s, d)),
        "sync_push_plan": lambda s, d: changes.push_plan(*_manifests(s, d)),
        "sync_pull_plan": lambda s, d: changes.pull_plan(*_manifests(s, d)),
        "sync_pull_newest": lambda s, d: changes.pull_plan(*_timed_manifests(s, d), policy="newest"),
        "sync_store_after_push": _store_after_push,
        "any_change": lambda s, d: changes.any_change(_manifests(s, d)[0], changes.merkle_root(_manifests(s, d)[1])),
        "flag_states": _flags,
        "tool_tiers": lambda s, d: table(s, d, "events").select("event_type").distinct().select("event_type", rules.tier(F.col("event_type"), ["click", "view"], ["purchase"]).alias("tier")),
        "camel_names": lambda s, d: table(s, d, "events").select("event_type").distinct().select("event_type", rules.camel(F.concat(F.lit("on_new_"), "event_type")).alias("camel")),
        "retry_delays": lambda s, d: table(s, d, "nation").select("n_nationkey", F.round(rules.backoff(F.col("n_nationkey").cast("int"), 0.5, 30.0), 6).alias("seconds")),
        "proposals_pending": lambda s, d: bases.listed(_jobs(s, d).withColumns({"id": F.col("seq"), "created": F.col("ts")}), "view").select("id", "job"),
        "sync_status": lambda s, d: changes.sync_status(*_manifests(s, d)),
        "job_states": lambda s, d: jobs.states(_job_log(s, d)),
        "job_stages": lambda s, d: jobs.stages(_job_log(s, d)),
        "illegal_steps": lambda s, d: jobs.illegal_steps(_job_log(s, d)),
        "job_current_state": lambda s, d: changes.job_state(_jobs(s, d)),
        "job_stage_durations": lambda s, d: changes.stage_durations(_jobs(s, d)),
        "job_history_last10": lambda s, d: changes.history(_jobs(s, d)),
        "status_changes": lambda s, d: changes.status_changes(_jobs(s, d)),
        "latest_versions": _on_entries(lambda e: changes.latest_versions(_versions(e))),
        "active_locks": lambda s, d: changes.active_locks(_locks(s, d), F.lit("2024-01-15").cast("timestamp")),
        "tool_latency_stats": lambda s, d: changes.call_stats(_tools(s, d)),
        "latency_histogram": lambda s, d: changes.latency_histogram(_tools(s, d), [10.0, 50.0, 100.0]),
        "compile_plan_tasks": lambda s, d: changes.compile_plan(entries(s, d), changes.sources_to_compile(*_sources(s, d))),
        "rebuild_stats": _on_entries(changes.rebuild_stats),
        # events and star schema
        "events_tumbling": lambda s, d: streams.tumbling(table(s, d, "events")),
        "events_sliding": lambda s, d: streams.sliding(table(s, d, "events")),
        "events_sessions": lambda s, d: streams.sessions(table(s, d, "events")),
        "pricing_summary": relational.pricing_summary,
        "revenue_by_nation": relational.revenue_by_nation,
        "customers_without_orders": relational.customers_without_orders,
        "segment_rollup": relational.segment_rollup,
        "part_cube": relational.part_cube,
        "top_orders_per_customer": relational.top_orders_per_customer,
        "running_order_total": relational.running_order_total,
        "brand_sets": relational.brand_sets,
        "status_pivot": relational.status_pivot,
        "last_order_before_event": relational.last_order_before_event,
        "distinct_parts": relational.distinct_parts,
    }


def queries() -> dict:
    return _queries()


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


