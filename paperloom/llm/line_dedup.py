"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

``LineRuns`` is a log-structured index of line keys. A run is a table of
``(h1, h2, n_docs)``, bucketed and sorted by the hash, so that merging runs and
anti-joining a batch against them are sort-merge joins without a shuffle of the
runs. Adding a batch:

1. count, per line key, the batch's documents that hold it (partial counts on
   the map side, so a line in a third of all rows moves one row per task);
2. merge-anti-join the keys that the runs already hold as settled, that is in
   at least ``min_docs`` documents: their fate no longer depends on counts;
3. write what is left as a new run of level 0, and whenever a level holds
   ``fanout`` runs, compact them into one run of the next level.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
A-Z lower-cased. Keys are compared by 128 hash bits.

Defined cases: null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; rows that repeat ``doc_id`` (null
included) are separate documents; columns besides ``doc_id`` and ``text`` pass
through ``drop_lines`` untouched, but those named as an added column
(``ADDED``, in any case of letters) are replaced by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import scratch

#: Fixed value: the characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: How often a line must occur, in documents, to be dropped.
MIN_DOCS = 10
MIN_CHARS = 1
#: Batches in which a whole table is fed to the index, and runs per level.
BATCHES = 3
FANOUT = 2
ADDED = ("n_lines", "n_dropped", "kept_text")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _hashed(line: Column) -> Column:
    """128 bits of the key of a line.

    ``lower`` on the bytes read as ISO-8859-1 folds A-Z, and otherwise only
    moves two-byte UTF-8 lead bytes to values that no lead byte before a single
    continuation byte has: equal results mean equal keys, without touching
    accented capitals as ``lower`` on the text would.
    """
    folded = F.lower(F.decode(F.encode(_stripped(line), "UTF-8"), "ISO-8859-1"))
    return F.struct(F.xxhash64(folded).alias("h1"), F.xxhash64(F.lit(1), folded).alias("h2"))


def _keys(docs: DataFrame, text: str, min_chars: int) -> Column:
    long_enough = F.filter(lines_of(F.col(text)), lambda x: F.char_length(_stripped(x)) >= F.lit(min_chars))
    return F.transform(long_enough, _hashed)


class LineRuns:
    """Levelled sorted runs of line keys with document counts."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame, label: str) -> str:
        name = f"paperloom_{label}_{uuid.uuid4().hex[:12]}"
        rows = counts.select("h1", "h2", "n_docs", (F.col("n_docs") >= self.min_docs).alias("settled"))
        writer = rows.write.format("parquet").option("path", scratch.new_path(self.spark, label))
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs merged by full outer merge joins: bucket meets bucket, nothing is shuffled."""
        rows = self.spark.table(runs[0]).select("h1", "h2", "n_docs")
        for run in runs[1:]:
            more = self.spark.table(run).select("h1", "h2", F.col("n_docs").alias("_more"))
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))
            rows = rows.join(more, ["h1", "h2"], "full").select("h1", "h2", total.alias("n_docs"))
        return rows

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Count a batch of documents and add it as a run."""
        each = docs.select(F.explode(F.array_distinct(_keys(docs, text, self.min_chars))).alias("k"))
        counts = each.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n_docs"))
        for run in self._runs():
            counts = counts.join(self.spark.table(run).filter("settled"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts, "lines"))
        self._compact()

    def _compact(self) -> None:
        for at, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(self._merged(level), "compacted"))
                for run in level:
                    self._drop(run)
                self.levels[at] = []

    def _drop(self, run: str) -> None:
        path = self.spark.sql(f"describe formatted {run}").filter("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"drop table {run}")
        scratch.remove(self.spark, path)

    def close(self) -> None:
        """Delete the runs."""
        for run in self._runs():
            self._drop(run)
        self.levels = [[]]

    def frequent(self) -> DataFrame:
        """The keys ``(h1, h2)`` held by at least ``min_docs`` documents."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(runs).filter(F.col("n_docs") >= self.min_docs).select("h1", "h2")


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Frequent keys meet the lines by hash; Spark broadcasts them only if their
    written size is below its own threshold, and else shuffles with skewed
    partitions split. What comes back to a document is the positions of its
    dropped lines, and the gaps between them are sliced out of its text.
    """
    hashed = F.transform(lines_of(F.col(text)), lambda x: F.when(F.char_length(_stripped(x)) >= F.lit(min_chars), _hashed(x)))
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    each = docs.select(F.col(doc_id).alias("_id"), body.alias("_body"), F.posexplode(hashed).alias("_pos", "_k")).filter("_k is not null")
    hits = (
        each.select("_id", "_body", "_pos", F.col("_k.h1").alias("h1"), F.col("_k.h2").alias("h2"))
        .join(frequent, ["h1", "h2"], "left_semi")
        .groupBy("_id", "_body")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
    )
    names = [c for c in docs.columns if c.lower() not in ADDED]
    whole = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), docs[doc_id].alias("_did"), body.alias("_dbody"))
    met = whole.join(hits, whole["_did"].eqNullSafe(hits["_id"]) & (whole["_dbody"] == hits["_body"]), "left")
    met = met.withColumn("_lines", lines_of(F.col("_row")[text])).withColumn("_n", F.size("_lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_at", lambda p: p + 1))
    ends = F.concat(F.col("_at"), F.array(F.col("_n")))
    gaps = F.zip_with(starts, ends, lambda s, e: F.slice(F.col("_lines"), s + 1, e - s))
    kept = F.when(F.col("_at").isNull(), F.col("_lines")).otherwise(F.flatten(gaps))
    # two steps: a column of ``docs`` may bear the name of a helper that the added columns read
    added = F.struct(
        F.col("_n").cast("long").alias("n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
    done = met.select("_row", added.alias("_added"))
    return done.select(*[done["_row"][c].alias(c) for c in names], *[done["_added"][c].alias(c) for c in ADDED])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """Drop, from every document, each line whose key at least ``min_docs`` documents hold."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    try:
        for b in range(batches):
            runs.add(docs.filter(part == b))
        frequent = scratch.written(runs.frequent(), "frequent-lines")
    finally:
        runs.close()
    return drop_lines(docs, frequent, min_chars)
