"""Knowledge bases as tables: configuration, saves, proposals, locks, export.

State changes are functions from the old table to the new one; writing is left
to the caller (a table format with atomic commits, or a new folder per version).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import changes, documents

#: The parts of a base, and the gate's defaults.
PARTS = ("raw", "wiki", "schema")
GATE_DEFAULTS = {"min_quality_score": "0.7", "block_on_error": "true", "auto_publish": "false"}
LOCK_SECONDS = 300


def set_config(config: DataFrame, key: str, value: str | None) -> DataFrame:
    """``(key, value)`` rows after a key is set, or removed with None."""
    kept = config.filter(F.col("key") != key)
    return kept if value is None else kept.unionByName(config.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def gate_config(config: DataFrame) -> dict:
    """Typed settings of the publish gate; values that do not parse are the defaults."""
    keys = list(GATE_DEFAULTS)
    found = {r.key: r.value for r in config.filter(F.col("key").isin(keys)).collect()}  # three keys at most

    def number(text: str) -> float:
        try:
            return float(text)
        except ValueError:
            return float(GATE_DEFAULTS["min_quality_score"])

    return {
        "least": number(found.get(keys[0], GATE_DEFAULTS[keys[0]])),
        "block_on_error": found.get(keys[1], GATE_DEFAULTS[keys[1]]).lower() != "false",
        "auto_publish": found.get(keys[2], GATE_DEFAULTS[keys[2]]).lower() == "true",
    }


def saved(entries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Entries after a save: safe paths only, marked compiled, dated, in place of those they replace."""
    rows = new.filter(documents.safe(F.col("path"))).withColumns({"status": F.lit("compiled"), "updated": now})
    before = entries.select("path", F.col("version").alias("_before"))
    rows = rows.join(before, "path", "left").withColumn("version", (F.coalesce("_before", F.lit(-1)) + 1).cast("int")).select(*entries.columns)
    return changes.merged(entries, rows)


def recompile_candidates(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries that ask for it or whose source has another hash than they were made from."""
    met = entries.join(sources.select(F.col("path").alias("source"), F.col("hash").alias("_now")), "source", "left")
    moved = F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("source_hash"))
    reason = F.when(F.col("status") == "needs_recompile", "asked for").when(moved, "source changed")
    return met.select("path", reason.alias("reason"), (F.col("version") + 1).alias("version")).filter("reason is not null")


def submitted(proposals: DataFrame, new: DataFrame) -> DataFrame:
    """Proposals with new pending ones; ids are hashes of what is proposed."""
    key = F.substring(F.sha2(F.concat_ws("|", "path", "find", "put", F.col("created").cast("string")), 256), 1, 16)
    rows = new.withColumns({"id": key, "status": F.lit("pending")}).select(*proposals.columns)
    return changes.merged(proposals, rows, "id")


def listed(proposals: DataFrame, status: str | None = None) -> DataFrame:
    rows = proposals if status is None else proposals.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created"), "id")


def applied(entries: DataFrame, proposals: DataFrame, proposal: str) -> tuple[DataFrame, DataFrame]:
    """Entries after one pending proposal, and proposals with its status moved on."""
    found = proposals.filter((F.col("id") == proposal) & (F.col("status") == "pending")).select("path", "find", "put").limit(1)
    met = entries.join(F.broadcast(found), "path", "left")  # one row
    body = F.when(F.col("find").isNotNull(), F.replace("body", F.col("find"), F.col("put"))).otherwise(F.col("body"))
    after = met.withColumn("version", (F.col("version") + (body != F.col("body")).cast("int")).cast("int")).withColumn("body", body).select(*entries.columns)
    moved = F.when((F.col("id") == proposal) & (F.col("status") == "pending"), "applied").otherwise(F.col("status"))
    return after, proposals.withColumn("status", moved)


def acquired(locks: DataFrame, path: str, holder: str, now: str, ttl: int = LOCK_SECONDS) -> DataFrame:
    """Locks after a request; a live lock of another holder stands."""
    at = F.lit(now).cast("timestamp")
    live = locks.filter((F.col("path") == path) & (F.col("holder") != holder) & (F.timestamp_add("SECOND", F.col("ttl"), F.col("taken")) > at))
    one = locks.sparkSession.createDataFrame([(path, holder, ttl)], "path string, holder string, ttl int").withColumn("taken", at)
    return changes.merged(locks, one.join(live.select("path"), "path", "left_anti").select(*locks.columns))


def released(locks: DataFrame, path: str, holder: str) -> DataFrame:
    return locks.filter(~((F.col("path") == path) & (F.col("holder") == holder)))


def export(tables: dict[str, DataFrame], target: str, overwrite: bool = False) -> None:
    """The tables of a base as Parquet folders below ``target``."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{target}/{name}")


def imported(spark: SparkSession, source: str, names: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """The tables of an exported base."""
    return {name: spark.read.parquet(f"{source}/{name}") for name in names}


def compile_prompt(entries: DataFrame, tags: list[str], source_text: str, top: int = 5) -> str:
    """The prompt for writing entries of a source: near entries first, the text last."""
    from paperloom.operators import graph

    near = graph.suggest_by_tags(entries, tags, top).collect()  # at most ``top`` rows
    listing = "\n".join(f"| {r.path} | {r.title} | {r.score} |" for r in near)
    return f"# Related entries\n| path | title | similarity |\n| --- | --- | --- |\n{listing}\n\n# Source\n{source_text}"
