"""The graph as stored tables that follow changes of entries.

References are kept as written beside the edges they resolve to, so an entry
that comes later is found by those that named it before. A change retracts what
the changed entries added and adds what they now say; tag pairs are found by the
tag lists. Generations are published whole (``plans.generations``), and one that
cannot be read is built anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import wikilinks
from paperloom.operators import graph
from paperloom.plans import generations
from paperloom.plans.loops import settled


def references(entries: DataFrame) -> DataFrame:
    """References as written: ``src``, ``key`` (lower-cased path), ``kind``."""
    links = F.transform(wikilinks(F.col("body")), lambda x: F.regexp_replace(x, "^wiki/", ""))
    named = lambda refs, kind: F.transform(refs, lambda r: F.struct(F.lower(r).alias("key"), F.lit(kind).alias("kind")))
    each = [named(F.col("related"), "related"), named(F.col("contradictions"), "contradiction"), named(links, "wikilink")]
    return entries.select(F.col("path").alias("src"), F.inline(F.concat(*each))).filter("key is not null")


def _resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("path").alias("dst"), F.lower("path").alias("key"))
    return refs.join(known, "key").select("src", "dst", "kind")


@dataclass
class GraphStore:
    """Nodes, references as written, their edges, and pairs of similar tags."""

    nodes: DataFrame  # path, title, domain, tags, level
    refs: DataFrame  # src, key, kind
    references: DataFrame  # src, dst, kind
    pairs: DataFrame  # src, dst (both ways)

    @classmethod
    def of(cls, entries: DataFrame, tags: bool = True) -> GraphStore:
        """The graph of entries, whose texts are read once; without ``tags`` there are no pairs."""
        nodes, refs = graph.nodes(entries), settled(references(entries), "references")
        pairs = graph.tag_edges(entries).select("src", "dst") if tags else entries.sparkSession.createDataFrame([], "src string, dst string")
        return cls(nodes, refs, _resolved(refs, nodes), pairs)

    @classmethod
    def read(cls, spark: SparkSession, at: str) -> GraphStore:
        return cls(*(spark.read.parquet(f"{at}/{f.name}") for f in fields(cls)))

    def publish(self, root: str) -> GraphStore:
        """Write the tables, by the column they are looked up by, as the next generation."""
        spark = self.nodes.sparkSession
        at, keys = generations.begun(spark, root), {"nodes": "path", "refs": "key", "references": "src", "pairs": "src"}
        for name, key in keys.items():
            getattr(self, name).repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{at}/{name}")
        generations.published(spark, root, at)
        return GraphStore.read(spark, at)

    @classmethod
    def current(cls, spark: SparkSession, root: str, made: Callable[[], DataFrame], tags: bool = True) -> GraphStore:
        """The newest generation; built from the entries where there is none, or none that can be read."""
        at = generations.current(spark, root)
        if at:
            try:
                return cls.read(spark, at)
            except (PySparkException, Py4JJavaError):
                pass  # a damaged generation: the next one replaces it
        return cls.of(made(), tags).publish(root)

    @property
    def edges(self) -> DataFrame:
        """All edges ``(src, dst, kind)``; parallel edges stay."""
        return self.references.unionByName(self.pairs.withColumn("kind", F.lit("tag_cooccurrence")))

    def counted(self) -> DataFrame:
        """Edges with how many of each are parallel: ``src, dst, kind, n``; a pair of similar tags is there once."""
        refs = self.references.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
        return refs.unionByName(self.pairs.select("src", "dst", F.lit("tag_cooccurrence").alias("kind"), F.lit(1).cast("long").alias("n")))

    def upserted(self, changed: DataFrame, removed: DataFrame | None = None) -> GraphStore:
        """The graph after entries changed (or came) and those with a ``path`` in ``removed`` went."""
        gone = changed.select("path") if removed is None else changed.select("path").unionByName(removed.select("path"))
        gone = gone.distinct()
        without = lambda df, column: df.join(gone.withColumnRenamed("path", column), column, "left_anti")
        fresh, own = references(changed), graph.nodes(changed)
        nodes = without(self.nodes, "path").unionByName(own)
        kept_refs = without(self.refs, "src")
        kept = without(without(self.references, "src"), "dst").select("src", "dst", "kind")
        added = _resolved(fresh, nodes).unionByName(_resolved(kept_refs, own))
        pairs = without(without(self.pairs, "src"), "dst").select("src", "dst")
        return GraphStore(nodes, kept_refs.unionByName(fresh.select(*kept_refs.columns)), kept.unionByName(added), pairs.unionByName(_new_pairs(own, nodes)))


#: Entries of one tag set that are taken together; Spark holds all pairs of two such chunks at a time.
CHUNK = 200


def _chunks(entries: DataFrame, side: str) -> DataFrame:
    """Entries by equal tag sets, in arrays of about ``CHUNK`` paths: ``<side>_tags, <side>_at, <side>``."""
    sets = entries.select("path", F.array_sort(F.array_distinct("tags")).alias("tags")).filter(F.size("tags") > 0)
    sized = sets.groupBy("tags").agg(F.ceil(F.count("*") / CHUNK).alias("n"))
    dealt = sets.join(sized, "tags").withColumn("at", F.pmod(F.xxhash64("path"), F.col("n")))
    return dealt.groupBy(F.col("tags").alias(f"{side}_tags"), F.col("at").alias(f"{side}_at")).agg(F.collect_set("path").alias(side))


def _new_pairs(own: DataFrame, nodes: DataFrame, jaccard: float = graph.MIN_JACCARD) -> DataFrame:
    """Pairs of similar tag sets with a changed entry at one end, both ways.

    Distinct tag sets are compared; where two are similar, chunks of their entries
    meet. Pairs are made where they are used: each once, none is shuffled.
    """
    mine = own.select("path").distinct()
    a = _chunks(own, "src")
    b = _chunks(own, "dst").withColumn("changed", F.lit(True)).unionByName(_chunks(nodes.join(mine, "path", "left_anti"), "dst").withColumn("changed", F.lit(False)))
    sets = lambda df, c: df.select(f"{c}_tags").distinct().select(f"{c}_tags", F.size(f"{c}_tags").alias(f"{c}_n"), F.explode(f"{c}_tags").alias("tag"))
    same = sets(a, "src").join(sets(b, "dst"), "tag").groupBy("src_tags", "dst_tags", "src_n", "dst_n").agg(F.count("*").alias("same"))
    near = same.filter(F.col("same") / (F.col("src_n") + F.col("dst_n") - F.col("same")) >= jaccard).select("src_tags", "dst_tags")
    met = near.join(a, "src_tags").join(b, "dst_tags").select("src", "dst", "src_at", "dst_at", "changed", F.xxhash64("src_tags", "dst_tags").alias("_of"))
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: arrays are small for what they make
    dealt = met.repartition(tasks, "_of", "src_at", "dst_at", "changed")
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = dealt.select(F.inline(F.when(F.col("changed"), F.slice(turned, 1, 1)).otherwise(turned)))  # whole arrays are turned, not pairs
    return ways.withColumn("src", F.explode("src")).withColumn("dst", F.explode("dst")).filter("src <> dst")
