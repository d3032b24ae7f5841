"""Quality, publishing and staleness of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scores, text

MIN_SCORE = 0.7
MAX_AGE_DAYS = 90


def issues(entries: DataFrame) -> DataFrame:
    """Rule findings, one row each: ``path``, ``severity``, ``message``."""
    rules = [
        (F.coalesce(F.length("title"), F.lit(0)) == 0, "ERROR", "missing title"),
        (F.coalesce(F.length("domain"), F.lit(0)) == 0, "ERROR", "missing domain"),
        (F.size("tags") == 0, "WARN", "no tags"),
        (F.col("quality_score") == 0, "INFO", "quality not scored"),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for c, s, m in rules]), lambda x: x.isNotNull())
    return entries.select("path", F.inline(found))


def broken_links(entries: DataFrame) -> DataFrame:
    """Related and contradiction references that no entry has as its path."""
    refs = entries.select("path", F.explode(F.concat("related", "contradictions")).alias("ref"))
    return refs.join(entries.select(F.col("path").alias("ref")), "ref", "left_anti").select("path", "ref")


def referenced(entries: DataFrame) -> DataFrame:
    """Distinct paths named as related or as a contradiction."""
    return entries.select(F.explode("related").alias("path")).union(entries.select(F.explode("contradictions").alias("path"))).distinct()


def quality_orphans(entries: DataFrame) -> DataFrame:
    """Entries above level 0 that nothing names by canonical path and that name nothing."""
    rows = entries.filter((F.upper("level") != "L0") & (F.size("related") == 0) & (F.size("contradictions") == 0))
    named = entries.select(F.explode("related").alias("_ref")).distinct()
    canonical = rows.withColumn("_canonical", text.safe_path(F.col("domain"), F.col("title")))
    return canonical.join(named, canonical["_canonical"] == named["_ref"], "left_anti").select("path")


def average_quality(entries: DataFrame) -> DataFrame:
    mean = F.avg(F.when(F.col("quality_score") > 0, F.col("quality_score")))
    return entries.agg(F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("avg_quality"), F.count_if(F.col("quality_score") > 0).alias("scored"))


def contradiction_pairs(entries: DataFrame, resolved: bool = True) -> DataFrame:
    """Unordered distinct pairs ``a``, ``b``; resolved ones name an entry."""
    refs = entries.select("path", F.explode("contradictions").alias("ref"))
    if resolved:
        refs = refs.join(entries.select(F.col("path").alias("ref")), "ref", "left_semi")
    return refs.select(F.least("path", "ref").alias("a"), F.greatest("path", "ref").alias("b")).distinct()


def contradiction_pairs_titled(entries: DataFrame) -> DataFrame:
    titles = entries.select(F.col("path").alias("b"), F.col("title").alias("b_title"))
    return contradiction_pairs(entries, resolved=False).join(titles, "b", "left").select("a", "b", "b_title")


def contradiction_issues(entries: DataFrame) -> DataFrame:
    pairs = contradiction_pairs(entries)
    return pairs.select(F.col("a").alias("path"), F.lit("ERROR").alias("severity"), F.concat(F.lit("contradicts "), "b").alias("message"))


def issue_id(path: Column, message: Column) -> Column:
    """A stable short id."""
    return F.substring(F.sha2(F.concat_ws("|", path, message), 256), 1, 16)


def list_issues(entries: DataFrame, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Findings, orphans and broken links with ids; a severity narrows only the findings."""
    found = issues(entries)
    if severity is not None:
        found = found.filter(F.lower("severity") == severity.lower())
    lost = quality_orphans(entries).select("path", F.lit("WARN").alias("severity"), F.lit("orphan").alias("message"))
    broken = broken_links(entries).select("path", F.lit("ERROR").alias("severity"), F.concat(F.lit("broken link: "), "ref").alias("message"))
    rows = found.unionByName(lost).unionByName(broken).withColumn("id", issue_id(F.col("path"), F.col("message")))
    return rows if limit is None else rows.orderBy("severity", "path", "message").limit(limit)


#: How many orphans the next actions name.
NEXT_ORPHANS = 5


def next_actions(entries: DataFrame) -> DataFrame:
    """What to do about the findings: ``place``, ``tool``, ``target``, in order."""
    lost = quality_orphans(entries).orderBy("path").limit(NEXT_ORPHANS).select(F.lit(1).alias("place"), F.lit("suggest_links").alias("tool"), F.col("path").alias("target"))
    broken = broken_links(entries).agg(F.min("path").alias("target")).filter("target is not null").select(F.lit(2).alias("place"), F.lit("patch_wiki_entry").alias("tool"), "target")
    always = entries.sparkSession.createDataFrame([(3, "hypothesis_test", None), (4, "rebuild_index", None)], "place int, tool string, target string")
    return lost.unionByName(broken).unionByName(always)


def snapshot_counts(entries: DataFrame) -> DataFrame:
    """One row of the counts that a snapshot keeps beside its listed issues."""
    parts = [
        issues(entries).agg(F.count("*").alias("issues")),
        quality_orphans(entries).agg(F.count("*").alias("orphans")),
        contradiction_pairs(entries).agg(F.count("*").alias("contradictions")),
        broken_links(entries).agg(F.count("*").alias("broken")),
        gate_summary(publish_gate(entries)).select("published", "blocked", "draft"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    return row


def report_lines(entries: DataFrame) -> DataFrame:
    """The quality report as Markdown lines: ``section``, ``line`` (sections in order, lines sorted within)."""
    head = health_report(entries).select(
        F.lit(0).alias("section"),
        F.inline(
            F.array(
                *[
                    F.struct(F.concat(F.lit(f"- **{name}**: "), value).alias("line"))
                    for name, value in (
                        ("Total entries", F.col("entries").cast("string")),
                        ("Domains", F.col("domains").cast("string")),
                        ("Average quality score", F.concat(F.round(F.col("avg_quality") * 100, 1).cast("string"), F.lit("%"))),
                        ("Orphan entries", F.col("orphans").cast("string")),
                        ("Broken links", F.col("broken").cast("string")),
                    )
                ]
            )
        ),
    )
    table = issues(entries).select(F.lit(1).alias("section"), F.concat(F.lit("| "), "severity", F.lit(" | "), "path", F.lit(" | "), "message", F.lit(" |")).alias("line"))
    lost = quality_orphans(entries).select(F.lit(2).alias("section"), F.concat(F.lit("- `"), "path", F.lit("`")).alias("line"))
    broken = broken_links(entries).select(F.lit(3).alias("section"), F.concat(F.lit("- `"), "path", F.lit("` → `"), "ref", F.lit("`")).alias("line"))
    return head.unionByName(table).unionByName(lost).unionByName(broken)


def meta_lint(entries: DataFrame, links: DataFrame, as_of: str) -> DataFrame:
    """One row: the lint counts beside those of load-bearing entries, confidence and diversity."""
    from paperloom.operators import graph

    row = lint_summary(entries, as_of)
    bearing = graph.load_bearing(graph.reference_edges(entries), 2).agg(F.count("*").alias("load_bearing"))
    lowered = graph.propagation_summary(graph.propagate_confidence(entries)).select("downgraded", "needs_review")
    for part in (bearing, lowered, graph.diversity(entries, links).select("hubs", "diversity_index")):
        row = row.crossJoin(part)  # one row each
    return row


def fix_suggestions(listed: DataFrame) -> DataFrame:
    """The operation that mends each issue (operation names are fixed values)."""
    m = F.col("message")
    tool = (
        F.when(m.startswith("broken link"), "patch_wiki_entry")
        .when(m == "orphan", "suggest_links")
        .when(m == "no tags", "patch_wiki_entry")
        .when(m == "quality not scored", "check_quality")
        .otherwise("save_wiki_entry")
    )
    return listed.select("id", "path", tool.alias("action"))


def publish_gate(entries: DataFrame, least: float = MIN_SCORE, block_on_error: bool = True, auto_publish: bool = False) -> DataFrame:
    """The status each entry should have, whether it changes, and its next version."""
    error = (F.length("title") == 0) | (F.length("domain") == 0)
    score, compiled = F.col("quality_score"), F.col("status") == "compiled"
    blocked = (error & block_on_error) | ((score > 0) & (score < least)) | ((score == 0) & ~compiled)
    gate = F.when(blocked, "blocked").when(F.lit(auto_publish) | (compiled & (score >= least)), "published").otherwise("draft")
    rows = entries.select("path", F.col("publish_status").alias("before"), gate.alias("after"), "version")
    changed = F.col("before") != F.col("after")
    return rows.select("path", "before", "after", changed.alias("changed"), (F.col("version") + changed.cast("int")).alias("version"))


def gate_summary(gate: DataFrame) -> DataFrame:
    return gate.agg(*[F.count_if(F.col("after") == s).alias(s) for s in ("published", "blocked", "draft")], F.count_if("changed").alias("changed"))


def stale(entries: DataFrame, as_of: str, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """Entries not validated for ``max_age`` days, with their decayed score."""
    days = F.timestamp_diff("DAY", F.coalesce("last_validated", "updated"), F.lit(as_of).cast("timestamp"))
    rows = entries.withColumn("days", days).filter(F.col("days") >= max_age)
    return rows.select("path", "days", F.round(scores.decay_score(F.col("quality_score"), F.col("days")), 6).alias("decayed")).orderBy(F.desc("days"), "path")


def missing_concepts(entries: DataFrame, least: int = 3, top: int = 15) -> DataFrame:
    """Frequent tags that no title carries."""
    tags = entries.select(F.explode("tags").alias("tag")).select(F.lower(F.trim("tag")).alias("tag")).filter(F.octet_length("tag") >= 3)
    often = tags.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    titles = entries.select(F.lower("title").alias("tag")).distinct()
    return often.join(titles, "tag", "left_anti").orderBy(F.desc("n"), "tag").limit(top)


def lint_summary(entries: DataFrame, as_of: str) -> DataFrame:
    """One row of counts."""
    found = issues(entries).agg(
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARN").alias("warnings"),
        F.count_if(F.col("severity") == "INFO").alias("infos"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(broken_links(entries), "broken"), one(quality_orphans(entries), "orphans"), one(contradiction_pairs(entries), "contradictions"), one(stale(entries, as_of), "stale")]
    for part in parts:
        found = found.crossJoin(part)  # one row each
    return found


def health_report(entries: DataFrame) -> DataFrame:
    """One row: entries, domains, mean score, orphans, broken links, contradictions, index size."""
    base = entries.agg(F.count("*").alias("entries"), F.countDistinct("domain").alias("domains"), F.sum(F.octet_length("body")).alias("body_bytes"))
    parts = [
        average_quality(entries).select("avg_quality"),
        quality_orphans(entries).agg(F.count("*").alias("orphans")),
        broken_links(entries).agg(F.count("*").alias("broken")),
        contradiction_pairs(entries).agg(F.count("*").alias("contradictions")),
    ]
    for part in parts:
        base = base.crossJoin(part)  # one row each
    return base
