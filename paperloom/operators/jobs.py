"""Compile jobs as folds of their event log.

An event is ``(job, seq, ts, action, stage, detail)``: ``start``, ``succeed`` and
``fail`` are of a stage; ``await`` and ``complete`` are of the job (``complete``
with a final status as detail). All that a job is at the end follows from its
events in order of ``seq``; nothing is updated in place. Windows run over one job
(or one stage of one), which is as long as its own log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The stages in order, and statuses that end a job.
STAGES = ("extract", "prompt_gen", "agent_wiki", "index_rebuild", "quality_gate")
FINAL = ("completed", "partial", "failed")
STEPS = ("start", "succeed", "fail")


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def stages(log: DataFrame) -> DataFrame:
    """The last state of every stage that a job has touched: ``job, stage, status, started, finished, duration_ms, error``.

    A new start clears the error and keeps the last finish, as a retry does.
    """
    steps = log.filter(F.col("action").isin(*STEPS) & F.col("stage").isin(*STAGES))
    started = F.last(F.when(F.col("action") == "start", F.col("ts")), ignorenulls=True).over(_before(["job", "stage"]))
    steps = steps.withColumn("since", started)
    ended = F.col("action") != "start"
    finish = F.struct("ts", F.when(F.col("since").isNotNull(), F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", "since", "ts"))).alias("ms"))
    found = steps.groupBy("job", "stage").agg(
        F.max_by("action", "seq").alias("last"),
        F.max_by("ts", F.when(~ended, F.col("seq"))).alias("started"),
        F.max_by(finish, F.when(ended, F.col("seq"))).alias("finish"),
        F.max(F.when(F.col("action") == "fail", F.struct("seq", "detail"))).alias("failure"),
        F.max(F.when(F.col("action") == "start", F.col("seq"))).alias("restart"),
    )
    status = F.when(F.col("last") == "start", "running").when(F.col("last") == "fail", "failed").otherwise("succeeded")
    cleared = F.col("failure").isNull() | (F.coalesce("restart", F.lit(-1)) > F.col("failure.seq"))
    return found.select("job", "stage", status.alias("status"), "started", F.col("finish.ts").alias("finished"), F.col("finish.ms").alias("duration_ms"), F.when(~cleared, F.col("failure.detail")).alias("error"))


def _status() -> Column:
    at = F.col("action")
    return F.when(at == "start", "running").when(at == "fail", "failed").when(at == "await", "awaiting_agent").when(at == "complete", F.col("detail"))


def states(log: DataFrame) -> DataFrame:
    """One row per job: overall status (success of a stage alone changes none), message, stages by status, first and last event."""
    told = log.withColumn("status", _status()).groupBy("job").agg(
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("running")).alias("status"),
        F.max_by("detail", F.when(F.col("action").isin("fail", "complete"), F.col("seq"))).alias("message"),
        F.min("ts").alias("begun"),
        F.max("ts").alias("updated"),
    )
    counts = stages(log).groupBy("job").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("running", "succeeded", "failed")])
    zero = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(0)).alias(f"stages_{c}")
    met = told.alias("_t").join(counts.alias("_s"), F.col("_t.job") == F.col("_s.job"), "left")
    return met.select("_t.job", "_t.status", "message", "begun", "updated", zero("running"), zero("succeeded"), zero("failed"))


def illegal_steps(log: DataFrame) -> DataFrame:
    """Steps that no job may take: ``job, seq, action, stage, reason`` (the first that applies)."""
    same = F.last("action", ignorenulls=True).over(_before(["job", "stage"]))
    over = F.coalesce(F.max(((F.col("action") == "complete") & F.col("detail").isin(*FINAL)).cast("int")).over(_before(["job"])), F.lit(0)) == 1
    rows = log.withColumns({"before": same, "over": over})
    step, running = F.col("action").isin(*STEPS), F.coalesce(F.col("before") == "start", F.lit(False))
    reason = (
        F.when(F.col("over"), "the job has ended")
        .when(step & ~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "no such stage")
        .when((F.col("action") == "start") & running, "the stage is running")
        .when(F.col("action").isin("succeed", "fail") & ~running, "the stage was not started")
        .when((F.col("action") == "complete") & ~F.coalesce(F.col("detail").isin(*FINAL), F.lit(False)), "no such status")
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select("job", "seq", "action", "stage", "reason")
