"""Link and tag graph over entries.

Edges are a table ``(src, dst, kind)``; every traversal is joins and aggregates
over it. Loops write each round to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scores
from paperloom.functions.text import wikilinks
from paperloom.plans.loops import settled

MIN_JACCARD = 0.3
MIN_SUGGESTION = 0.1
REFERENCE_KINDS = ("related", "contradiction", "wikilink")


def nodes(entries: DataFrame) -> DataFrame:
    return entries.select("path", "title", "domain", "tags", "level")


def _resolved(refs: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """References met with paths, whatever their case."""
    known = entries.select(F.col("path").alias("dst"), F.lower("path").alias("_key"))
    return refs.withColumn("_key", F.lower("ref")).join(known, "_key").select("src", "dst", F.lit(kind).alias("kind"))


def related_edges(entries: DataFrame) -> DataFrame:
    return _resolved(entries.select(F.col("path").alias("src"), F.explode("related").alias("ref")), entries, "related")


def contradiction_edges(entries: DataFrame) -> DataFrame:
    return _resolved(entries.select(F.col("path").alias("src"), F.explode("contradictions").alias("ref")), entries, "contradiction")


def wikilink_edges(entries: DataFrame) -> DataFrame:
    """Links in bodies; a leading ``wiki/`` is dropped, and only paths resolve."""
    refs = entries.select(F.col("path").alias("src"), F.explode(wikilinks(F.col("body"))).alias("ref"))
    return _resolved(refs.withColumn("ref", F.regexp_replace("ref", "^wiki/", "")), entries, "wikilink")


def _needed(own: Column, other: Column, jaccard: float) -> Column:
    """Shared tags that two sets of these sizes need for the similarity."""
    return F.greatest(F.lit(1), F.ceil(F.lit(jaccard) / (1 + jaccard) * (own + other) - 1e-9)).cast("int")


def tag_pairs(entries: DataFrame, jaccard: float = MIN_JACCARD) -> DataFrame:
    """Pairs of entries whose tag sets are similar: ``a``, ``b`` (a < b), ``jaccard``.

    Each entry is listed under its rarest tags only, for each size the partner
    may have, as many as must contain one shared tag. A tag that very many
    entries hold is therefore listed only where the similarity needs it, and no
    pair above the threshold is missed.
    """
    sets = entries.select("path", F.array_sort(F.array_distinct("tags")).alias("tags")).filter(F.size("tags") > 0)
    rarity = sets.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    listed = sets.select("path", F.size("tags").alias("own"), F.explode("tags").alias("tag")).join(rarity, "tag")
    listed = listed.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("n", "tag")))
    sizes = sets.select(F.size("tags").alias("other")).distinct()
    able = (F.least("own", "other") / F.greatest("own", "other")) >= jaccard - 1e-9
    keyed = listed.join(F.broadcast(sizes), able)  # as many rows as there are sizes of tag sets
    keyed = keyed.filter(F.col("place") <= F.col("own") - _needed(F.col("own"), F.col("other"), jaccard) + 1)
    left = keyed.select(F.col("path").alias("a"), "tag", F.col("own").alias("a_size"), F.col("other").alias("b_size"))
    right = keyed.select(F.col("path").alias("b"), "tag", F.col("other").alias("a_size"), F.col("own").alias("b_size"))
    pairs = left.join(right, ["tag", "a_size", "b_size"]).filter("a < b").select("a", "b").distinct()
    met = pairs.join(sets.select(F.col("path").alias("a"), F.col("tags").alias("_s")), "a").join(sets.select(F.col("path").alias("b"), F.col("tags").alias("_t")), "b")
    same = F.size(F.array_intersect("_s", "_t"))
    value = same / (F.size("_s") + F.size("_t") - same)
    return met.withColumn("jaccard", value).filter(F.col("jaccard") >= jaccard).select("a", "b", "jaccard")


def tag_edges(entries: DataFrame, jaccard: float = MIN_JACCARD) -> DataFrame:
    pairs = tag_pairs(entries, jaccard)
    one = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return one.select("e.src", "e.dst", F.lit("tag_cooccurrence").alias("kind"))


def edges(entries: DataFrame) -> DataFrame:
    """All edges of the graph; parallel edges stay."""
    return related_edges(entries).unionByName(contradiction_edges(entries)).unionByName(wikilink_edges(entries)).unionByName(tag_edges(entries))


def reference_edges(entries: DataFrame) -> DataFrame:
    return related_edges(entries).unionByName(contradiction_edges(entries)).unionByName(wikilink_edges(entries))


def in_degree(links: DataFrame) -> DataFrame:
    """References to each entry; tag edges do not count."""
    return links.filter(F.col("kind") != "tag_cooccurrence").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))


def load_bearing(links: DataFrame, least: int) -> DataFrame:
    """Entries that many others refer to, with their protection level."""
    found = in_degree(links).filter(F.col("in_degree") >= least)
    return found.withColumn("protection", scores.protection(F.col("in_degree"), least)).orderBy(F.desc("in_degree"), "path")


def hub_threshold(entries: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``threshold``: 5 below 50 entries, else twice the mean degree within 3..20."""
    n = entries.agg(F.count("*").alias("n"))
    e = links.agg(F.count("*").alias("e"))
    mean = F.greatest(F.lit(3), F.least(F.lit(20), F.ceil(2 * F.col("e") / F.col("n"))))
    return n.crossJoin(e).select(F.when(F.col("n") < 50, 5).otherwise(mean).cast("long").alias("threshold"))  # one row each


def orphans(entries: DataFrame) -> DataFrame:
    """Entries at neither end of a related or contradiction edge."""
    ends = related_edges(entries).unionByName(contradiction_edges(entries))
    used = ends.select(F.col("src").alias("path")).unionByName(ends.select(F.col("dst").alias("path")))
    return entries.select("path", "title", "domain").join(used, "path", "left_anti")


def suggest_links(entries: DataFrame, center: str, top: int = 5, jaccard: float = MIN_SUGGESTION) -> DataFrame:
    """Entries with similar tags that the centre does not link to yet."""
    own = entries.filter(F.col("path") == center).select(F.array_distinct("tags").alias("_own"))
    linked = edges_from(entries, center)
    same = F.size(F.array_intersect("tags", "_own"))
    value = same / F.size(F.array_union("tags", "_own"))
    rows = entries.filter(F.col("path") != center).crossJoin(F.broadcast(own.limit(1)))  # one row
    rows = rows.withColumn("score", F.round(value, 6)).filter((same > 0) & (F.col("score") >= jaccard))
    rows = rows.join(linked, rows["path"] == linked["dst"], "left_anti")
    return rows.select("path", "title", "score").orderBy(F.desc("score"), "path").limit(top)


def edges_from(entries: DataFrame, center: str) -> DataFrame:
    """Targets of the centre's related, contradiction, link and tag edges."""
    own = entries.filter(F.col("path") == center)
    refs = own.select(F.explode(F.concat("related", "contradictions", F.transform(wikilinks(F.col("body")), lambda x: F.regexp_replace(x, "^wiki/", "")))).alias("ref"))
    known = entries.select(F.col("path").alias("dst"), F.lower("path").alias("_key"))
    named = refs.select(F.lower("ref").alias("_key")).join(known, "_key").select("dst")
    tags = own.select(F.array_distinct("tags").alias("_own")).limit(1)
    same = F.size(F.array_intersect("tags", "_own"))
    near = entries.filter(F.col("path") != center).crossJoin(F.broadcast(tags)).filter((same > 0) & (same / F.size(F.array_union("tags", "_own")) >= MIN_JACCARD))
    return named.unionByName(near.select(F.col("path").alias("dst"))).distinct()


def suggest_by_tags(entries: DataFrame, tags: list[str], top: int = 5, jaccard: float = MIN_SUGGESTION) -> DataFrame:
    """Entries whose tags are similar to the given ones."""
    own = F.array(*[F.lit(t) for t in tags])
    same = F.size(F.array_intersect("tags", own))
    rows = entries.withColumn("score", F.round(same / F.size(F.array_union("tags", own)), 6))
    return rows.filter((same > 0) & (F.col("score") >= jaccard)).select("path", "title", "score").orderBy(F.desc("score"), "path").limit(top)


def backlinks(entries: DataFrame, target: str) -> DataFrame:
    """Entries that name the target as related or as a contradiction."""
    refs = entries.select("path", "title", F.explode(F.concat("related", "contradictions")).alias("ref"))
    plain = F.regexp_replace(F.replace("ref", F.lit("\\"), F.lit("/")), "^(wiki/)+/*", "")
    return refs.filter(plain == target).select("path", "title").distinct().orderBy("path")


def neighbors(links: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """Entries reached over outgoing edges: ``path``, fewest ``hop``, ``kind`` of the edge that reached it.

    One plan of as many joins as there are hops; each hop leaves out what an
    earlier one reached, so walks do not multiply.
    """
    spark = links.sparkSession
    seen = spark.createDataFrame([(start, 0, "")], "path string, hop int, kind string")
    front = None
    for hop in range(1, hops + 1):
        own = links.filter(F.col("src") == start) if front is None else links.join(front, links["src"] == front["_at"], "left_semi")
        step = own.groupBy(F.col("dst").alias("path")).agg(F.min("kind").alias("kind"))
        step = step.join(seen.select("path"), "path", "left_anti").select("path", F.lit(hop).alias("hop"), "kind")
        seen, front = seen.unionByName(step), step.select(F.col("path").alias("_at"))
    return seen.filter("hop > 0")


def concept_map(links: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Distinct edges among entries within ``depth`` steps in either direction."""
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    near = settled(neighbors(both, start, depth).select("path").unionByName(links.sparkSession.createDataFrame([(start,)], "path string")), "near")
    inside = links.join(near.select(F.col("path").alias("src")), "src", "left_semi").join(near.select(F.col("path").alias("dst")), "dst", "left_semi")
    arrow = F.when(F.col("kind") == "contradiction", "--x").when(F.col("kind") == "tag_cooccurrence", "-.->").otherwise("-->")
    return inside.select("src", "dst", "kind", arrow.alias("arrow")).distinct()


#: What edges are called in a diagram.
EDGE_NAMES = {"related": "relates", "contradiction": "contradicts", "tag_cooccurrence": "co-tags", "wikilink": "wikilink"}


def concept_map_text(entries: DataFrame, links: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """One row ``text``: the concept map as a Mermaid diagram, with ids by the order of paths.

    The nodes are those of the centre's surroundings, a bounded part of the graph.
    """
    edges = concept_map(links, start, depth)
    paths = edges.select(F.explode(F.array("src", "dst")).alias("path")).unionByName(links.sparkSession.createDataFrame([(start,)], "path string")).distinct()
    named = entries.join(paths, "path", "left_semi").select("path", "title").agg(F.array_sort(F.collect_list(F.struct("path", "title"))).alias("all"))
    numbered = named.select(F.posexplode("all").alias("n", "own")).select(F.col("own.path").alias("path"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("id"), "n", F.col("own.title").alias("title"))
    mark = F.when(F.col("path") == start, ":::center").otherwise("")
    boxes = numbered.select(F.lit(1).alias("part"), "n", F.concat(F.lit("    "), "id", F.lit('["'), F.replace("title", F.lit('"'), F.lit("'")), F.lit('"]'), mark).alias("line"))
    of = lambda side: numbered.select(F.col("path").alias(side), F.col("id").alias(f"{side}_id"))
    name = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in EDGE_NAMES.items()])
    arrows = edges.join(of("src"), "src").join(of("dst"), "dst")
    arrows = arrows.select(F.lit(2).alias("part"), F.lit(0).alias("n"), F.concat(F.lit("    "), "src_id", F.lit(" "), "arrow", F.lit("|"), name, F.lit("| "), "dst_id").alias("line"))
    ends = [(0, 0, "graph LR"), (3, 0, "    classDef center stroke-width:2px")]
    lines = boxes.unionByName(arrows).unionByName(links.sparkSession.createDataFrame(ends, "part int, n int, line string"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "line"))), lambda x: x["line"])
    found = lines.agg(F.array_join(whole, "\n").alias("text"), F.count_if(F.col("part") == 1).alias("_n"))
    return found.select(F.when(F.col("_n") > 0, F.col("text")).otherwise(F.lit(f'graph LR\n    error["no such entry: {start}"]')).alias("text"))


def communities(entries: DataFrame, links: DataFrame, rounds: int = 50, least_frequent: bool = False) -> DataFrame:
    """Label propagation: ``path``, ``community`` (its smallest member), size at least 2.

    All nodes take, in each round, the label most frequent among themselves and
    their neighbours (parallel edges count; ties go to the lowest label), until
    a state comes back (nothing changes, or labels swing between states).
    ``least_frequent`` turns the choice round.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = settled(both.groupBy("src", "dst").agg(F.count("*").alias("n")), "community-edges")
    labels = settled(entries.select("path", F.col("path").alias("label")), "labels")
    seen: set[int] = set()
    for at in range(rounds):
        votes = both.join(labels.select(F.col("path").alias("dst"), "label"), "dst").select(F.col("src").alias("path"), "label", "n")
        votes = votes.unionByName(labels.select("path", "label", F.lit(1).cast("long").alias("n"))).groupBy("path", "label").agg(F.sum("n").alias("n"))
        key = F.struct(F.col("n") if least_frequent else -F.col("n"), "label")
        labels = settled(votes.groupBy("path").agg(F.min_by("label", key).alias("label")), f"labels-{at}")
        state = labels.agg(F.sum(F.xxhash64("path", "label").cast("decimal(38,0)"))).first()[0]
        if state in seen:
            break
        seen.add(state)
    sized = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("path").alias("community")).filter("size >= 2")
    return labels.join(sized, "label").select("path", "community", "size")


def aggregation_candidates(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Communities with at least two L1 entries, named for their most frequent domain."""
    level1 = entries.filter(F.upper("level") == "L1").select("path", "domain")
    inside = members.join(level1, "path")
    size = inside.groupBy("community").agg(F.count("*").alias("members")).filter("members >= 2")
    domain = inside.groupBy("community", "domain").agg(F.count("*").alias("n")).groupBy("community").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"))
    return size.join(domain, "community").select("community", "members", "domain", F.concat("domain", F.lit(" 领域综合")).alias("title"))


def propagate_confidence(entries: DataFrame, depth: int = 2) -> DataFrame:
    """Confidence weakened by weaker sources, along references, in ``depth`` rounds.

    ``declared`` and ``effective`` confidence, whether it was lowered, and whether
    a contradiction asks for a review.
    """
    depth = min(8, max(1, depth))
    ranks = entries.select("path", scores.confidence_rank(F.col("confidence")).alias("declared")).withColumn("rank", F.col("declared"))
    sources = F.regexp_replace(F.col("ref"), "^(wiki/)+/*", "")
    made_of = entries.select(F.col("path").alias("dst"), F.explode("aggregated_from").alias("ref")).select(sources.alias("src"), "dst")
    links = related_edges(entries).unionByName(wikilink_edges(entries)).select("src", "dst").unionByName(made_of).distinct()
    links = settled(links, "references")  # found in all bodies once, joined in every round
    for _ in range(depth):
        low = links.join(ranks.select(F.col("path").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("rank").alias("_low"))
        ranks = ranks.join(low, "path", "left").select("path", "declared", F.least("rank", F.coalesce("_low", "rank")).alias("rank"))
    review = contradiction_edges(entries).select(F.col("dst").alias("path")).distinct().withColumn("_review", F.lit(True))
    return ranks.join(review, "path", "left").select(
        "path",
        scores.confidence_name(F.col("declared")).alias("declared"),
        scores.confidence_name(F.col("rank")).alias("effective"),
        (F.col("rank") < F.col("declared")).alias("downgraded"),
        F.coalesce("_review", F.lit(False)).alias("needs_review"),
    )


def written_back(entries: DataFrame, report: DataFrame, dry_run: bool = False) -> DataFrame:
    """Entries after a propagation is applied: effective confidence where lowered or in doubt, and those in doubt to recompile."""
    if dry_run:
        return entries
    own = report.filter("downgraded or needs_review").select("path", "effective", "needs_review")
    met = entries.join(own, "path", "left")
    status = F.when(F.col("needs_review"), "needs_recompile").otherwise(F.col("status"))
    return met.withColumns({"confidence": F.coalesce("effective", "confidence"), "status": status}).select(*entries.columns)


def domain_partitions(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Per domain its nodes, the edges inside it, and those that leave it."""
    of = entries.select("path", "domain")
    ends = links.join(of.select(F.col("path").alias("src"), F.col("domain").alias("domain")), "src").join(of.select(F.col("path").alias("dst"), F.col("domain").alias("other")), "dst")
    edges = ends.groupBy("domain").agg(F.count_if(F.col("domain") == F.col("other")).alias("inside"), F.count_if(F.col("domain") != F.col("other")).alias("leaving"))
    nodes_of = of.groupBy("domain").agg(F.count("*").alias("nodes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes_of.join(edges, "domain", "left").select("domain", "nodes", zero("inside"), zero("leaving"))


def subgraph(entries: DataFrame, links: DataFrame, domain: str) -> DataFrame:
    """The edges between entries of one domain."""
    own = entries.filter(F.col("domain") == domain).select("path")
    return links.join(own.withColumnRenamed("path", "src"), "src", "left_semi").join(own.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def propagation_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("entries"),
        F.count_if("downgraded").alias("downgraded"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(F.col("effective") == "low").alias("effective_low"),
    )


def diversity_warnings(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Hubs that no contradiction goes out from."""
    hubs = in_degree(links).crossJoin(F.broadcast(hub_threshold(entries, links))).filter("in_degree >= threshold")  # one row
    against = entries.filter(F.size("contradictions") > 0).select("path")
    return hubs.join(against, "path", "left_anti").select("path", "in_degree").orderBy(F.desc("in_degree"), "path")


def diversity(entries: DataFrame, links: DataFrame) -> DataFrame:
    """One row: entries, hubs and the share that are no hubs."""
    n = entries.agg(F.count("*").alias("entries"))
    hubs = in_degree(links).crossJoin(F.broadcast(hub_threshold(entries, links))).agg(F.count_if(F.col("in_degree") >= F.col("threshold")).alias("hubs"))
    index = F.when(F.col("entries") > 0, 1 - F.col("hubs") / F.col("entries")).otherwise(1.0)
    return n.crossJoin(hubs).select("entries", "hubs", F.round(index, 6).alias("diversity_index"))


def stats(entries: DataFrame, links: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("nodes")).crossJoin(links.agg(F.count("*").alias("edges")))
