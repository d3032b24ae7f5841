"""Incremental maintenance: change detection, manifests, jobs, plans, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import graph

KEPT_JOBS = 10


def sources_to_compile(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources that are new, changed, or were compiled to nothing.

    ``sources(path, hash)``; ``state(path, source_hash, outputs)``.
    """
    met = sources.join(state, "path", "left")
    reason = F.when(F.col("source_hash").isNull(), "new").when(F.col("hash") != F.col("source_hash"), "changed").when(F.size("outputs") == 0, "no outputs")
    return met.select("path", reason.alias("reason")).filter("reason is not null")


def stale_by_instruction(state: DataFrame, current: str) -> DataFrame:
    """Sources compiled under another instruction, or under none."""
    return state.filter(~F.col("instruction_hash").eqNullSafe(F.lit(current))).select("path", "instruction_hash")


def merged(store: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """The store after an upsert of the changed rows."""
    return store.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def manifest(files: DataFrame, path: str = "path", content: str = "content", left_out: str = r"(^|/)\.[^/]+(/|$)") -> DataFrame:
    """``path`` and SHA-256 of the content; paths that match ``left_out`` (hidden ones) are not listed."""
    return files.filter(~F.rlike(path, F.lit(left_out))).select(F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("hash"))


def root_hash(listed: DataFrame) -> DataFrame:
    """One hash over the sorted hashes of a manifest (which the driver of a sync compares)."""
    joined = F.array_join(F.sort_array(F.collect_list("hash")), "|")
    return listed.agg(F.sha2(joined, 256).alias("root_hash"), F.count("*").alias("objects"))


def merkle_root(listed: DataFrame) -> DataFrame:
    """Root of a hash tree: leaves fold within 4096 bins of their path's hash, bins into the root.

    The bins keep what one task gathers small; any changed, added or missing leaf
    changes the root.
    """
    leaf = F.sha2(F.concat_ws("|", "path", "hash"), 256)
    rows = listed.select("path", leaf.alias("node"))
    rows = rows.withColumn("bin", F.substring(F.sha2(F.col("path"), 256), 1, 3))
    fold = lambda nodes: F.sha2(F.array_join(nodes, ""), 256)
    level = rows.groupBy("bin").agg(fold(F.transform(F.sort_array(F.collect_list(F.struct("path", "node"))), lambda x: x["node"])).alias("node"))
    return level.agg(fold(F.transform(F.sort_array(F.collect_list(F.struct("bin", "node"))), lambda x: x["node"])).alias("merkle_root"))


def conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Paths on both sides with other contents."""
    met = local.join(remote.withColumnRenamed("hash", "remote_hash"), "path")
    return met.filter(F.col("hash") != F.col("remote_hash")).select("path", F.col("hash").alias("local_hash"), "remote_hash")


def push_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Objects that the remote store lacks, with their content address."""
    need = local.select("hash").distinct().join(remote.select("hash").distinct(), "hash", "left_anti")
    return need.select("hash", object_key(F.col("hash")).alias("object_key"))


def pull_plan(local: DataFrame, remote: DataFrame, policy: str = "remote") -> DataFrame:
    """What a pull does with each remote path: ``add``, ``replace``, ``keep`` or ``conflict``.

    ``newest`` needs a ``modified`` time on both sides; a tie keeps the local file.
    """
    own = local.withColumnRenamed("hash", "own")
    met = remote.join(own.withColumnRenamed("modified", "_own_modified") if policy == "newest" else own, "path", "left")
    if policy == "newest":
        clash = F.when(F.col("modified") > F.col("_own_modified"), "replace").otherwise("keep")
    else:
        clash = F.lit({"remote": "replace", "local": "keep", "abort": "conflict"}[policy])
    action = F.when(F.col("own").isNull(), "add").when(F.col("own") != F.col("hash"), clash).otherwise("same")
    return met.select("path", action.alias("action")).filter("action <> 'same'")


def object_key(hash: Column) -> Column:
    """The content address of an object: two characters, then the rest."""
    return F.concat(F.substring(hash, 1, 2), F.lit("/"), F.substring(hash, 3, 62))


def pushed(files: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """The objects ``(object_key, content)`` that a push appends to the store: one for each new content."""
    new = files.select(F.sha2("content", 256).alias("hash"), "content").groupBy("hash").agg(F.any_value("content").alias("content"))
    new = new.select(object_key(F.col("hash")).alias("object_key"), "content")
    return new if store is None else new.join(store.select("object_key"), "object_key", "left_anti")


def pulled(local: DataFrame, remote: DataFrame, store: DataFrame, policy: str = "abort") -> DataFrame:
    """The files ``(path, content)`` that a pull writes; under ``abort`` a conflict stops it."""
    lists = [t.select("path", F.sha2("content", 256).alias("hash"), *[c for c in t.columns if c == "modified"]) if "hash" not in t.columns else t for t in (local, remote)]
    plan = pull_plan(*lists, policy)
    if policy == "abort" and not plan.filter("action = 'conflict'").isEmpty():
        raise ValueError("local and remote differ; choose a policy")
    take = plan.filter(F.col("action").isin("add", "replace")).select("path").join(lists[1].select("path", object_key(F.col("hash")).alias("object_key")), "path")
    return take.join(store, "object_key").select("path", "content")


def any_change(local: DataFrame, stored_root: DataFrame) -> DataFrame:
    """One row: whether a manifest's root differs from the stored one."""
    return merkle_root(local).select(F.col("merkle_root").alias("now")).crossJoin(stored_root.select(F.col("merkle_root").alias("then"))).select((~F.col("now").eqNullSafe(F.col("then"))).alias("changed"))  # one row each


def sync_status(local: DataFrame, remote: DataFrame) -> DataFrame:
    mine, theirs = root_hash(local), root_hash(remote)
    theirs = theirs.select(F.col("root_hash").alias("_r"), F.col("objects").alias("remote_objects"))
    return mine.crossJoin(theirs).select((F.col("root_hash") == F.col("_r")).alias("in_sync"), F.col("objects").alias("local_objects"), "remote_objects")  # one row each


# --- jobs and logs --------------------------------------------------------------


def job_state(events: DataFrame) -> DataFrame:
    """The latest status of each job: ``job``, ``status``, ``at``."""
    return events.groupBy("job").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("at"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Seconds between a job's consecutive events."""
    w = Window.partitionBy("job").orderBy("ts", "seq")
    seconds = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return events.select("job", "seq", seconds.alias("seconds")).filter("seconds is not null")


def history(events: DataFrame, kept: int = KEPT_JOBS) -> DataFrame:
    """The last events of each job (row limits reach the map side)."""
    place = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("place", place).filter(F.col("place") <= kept).select("job", "seq", "place")


def status_changes(events: DataFrame) -> DataFrame:
    """Events whose status differs from the one before in their job."""
    before = F.lag("status").over(Window.partitionBy("job").orderBy("ts", "seq"))
    return events.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col("status"))).select("job", "seq", "status")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each path."""
    return versions.groupBy("path").agg(F.max("version").alias("version"), F.max_by("hash", "version").alias("hash"))


def active_locks(locks: DataFrame, now: Column) -> DataFrame:
    """Per entry, the newest lock that has not run out."""
    live = locks.filter(F.timestamp_add("SECOND", F.col("ttl"), F.col("taken")) > now)
    return live.groupBy("path").agg(F.max_by("holder", F.struct("taken", "holder")).alias("holder"), F.max("taken").alias("taken"))


def log_tail(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def call_stats(events: DataFrame) -> DataFrame:
    """Calls, errors and mean latency of each operation."""
    return events.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.round(F.avg("latency"), 4).alias("avg_latency"))


def latency_histogram(events: DataFrame, bounds: list[float]) -> DataFrame:
    """Calls of each operation by upper bound of latency (cumulative, as scraped metrics are)."""
    counts = [F.count_if(F.col("latency") <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return events.groupBy("tool").agg(*counts, F.count("*").alias("le_inf"))


# --- plans ----------------------------------------------------------------------


def compile_plan(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """Tasks: pending sources, domains without an L3 map, entries to recompile."""
    create = pending.select(F.lit("create_l1").alias("task"), F.col("path").alias("target"))
    mapped = entries.filter(F.upper("level") == "L3").select("domain")
    maps = entries.select("domain").distinct().join(mapped, "domain", "left_anti").select(F.lit("domain_map_l3").alias("task"), F.col("domain").alias("target"))
    again = entries.filter(F.col("status") == "needs_recompile").select(F.lit("recompile_entry").alias("task"), F.col("path").alias("target"))
    return create.unionByName(maps).unionByName(again)


def rebuild_stats(entries: DataFrame) -> DataFrame:
    """What a full rebuild yields: documents, nodes, edges."""
    return entries.agg(F.count("*").alias("documents")).crossJoin(graph.stats(entries, graph.edges(entries)))


def archived(raw: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An idempotent raw write: the store after it, and the old rows it archives."""
    new = incoming.join(raw.select("path", "hash"), ["path", "hash"], "left_anti")
    old = raw.join(new.select("path"), "path", "left_semi")
    return merged(raw, new), old
