"""Connected components of a link table, distributed.

Alternating large-star and small-star rounds: each points nodes at smaller
neighbours until every component is a star around its smallest node. A node's
smallest neighbour is a partial aggregate, and the joins on a hub are ordinary
shuffled joins whose skewed partitions can be split, so a star over a third of
all nodes is no single task. Each round is written to the shared folder; only
two numbers per round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import scratch

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.join(low, both["a"] == low["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = down.join(low, down["a"] == low["u"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; the component is its smallest node."""
    now = scratch.written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for at in range(MAX_ROUNDS):
        state = _state(now)
        if state == before or not state[0]:
            break
        before, old = state, now
        now = scratch.written(_small_star(_large_star(old)), f"stars-{at}")
        scratch.discard(old)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
