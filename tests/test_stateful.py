"""Streams with state, fed file by file and restarted, against the batch and a plain simulation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import changes
from paperloom.streaming import stateful

ZERO = dt.datetime(2024, 1, 1)


def fed(spark, tmp_path, rows, schema, made, batches):
    """What a stream puts out when files come one by one and it is started anew for each."""
    for n in range(batches):
        part = rows[n * len(rows) // batches : (n + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        q = made(stream).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(f"file://{tmp_path}/out").collect()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_feed_adds_up_to_the_batch_whatever_the_order(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"j{rnd.randrange(4)}", i, ZERO + dt.timedelta(minutes=3 * i), rnd.choice(["run", "wait", "done"])) for i in range(120)]
    mixed = [r for at in range(0, 120, 10) for r in rnd.sample(rows[at : at + 10], 10)]  # out of order by half an hour at most
    end = [("end", 900 + i, ZERO + dt.timedelta(days=2, hours=i), "x") for i in range(2)]  # moves the watermark on
    schema = "job string, seq long, ts timestamp, status string"
    got = fed(spark, tmp_path, [*mixed, *end], schema, stateful.status_changes, 3)
    want = changes.status_changes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.job, r.seq, r.status) for r in got if r.job != "end") == sorted((r.job, r.seq, r.status) for r in want)


def test_locks_are_held_refused_renewed_and_run_out(spark, tmp_path):
    at = lambda s: ZERO + dt.timedelta(seconds=s)
    rows = [("p", "ann", at(0), 1, 300), ("q", "bob", at(10), 2, 60), ("p", "bob", at(100), 3, 300), ("p", "ann", at(200), 4, 300), ("p", "bob", at(600), 5, 300)]
    rows += [("end", "x", at(86_400 + i), 10 + i, 1) for i in range(2)]
    got = fed(spark, tmp_path, rows, "path string, holder string, taken timestamp, seq long, ttl long", stateful.locks, 2)
    assert sorted((r.path, r.at, r.holder, r.event) for r in got if r.path != "end") == [
        ("p", at(0), "ann", "taken"), ("p", at(100), "bob", "refused"), ("p", at(200), "ann", "renewed"), ("p", at(500), "ann", "expired"), ("p", at(600), "bob", "taken"),
        ("p", at(900), "bob", "expired"), ("q", at(10), "bob", "taken"), ("q", at(70), "bob", "expired"),
    ]
