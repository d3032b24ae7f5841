"""Inputs that crashed an operator or led it to a wrong text."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import line_dedup, suffix_dedup

#: Helper and output names of the two operators.
NAMES = ("_lines", "_n", "_at", "_row", "_id", "_did", "_body", "_dbody", "_pos", "_k", "_added", "k", "h1", "h2", "n_lines", "n_dropped", "kept_text")
KINDS = {"array": "array('X')", "string": "'X'", "long": "5L", "struct": "named_struct('h1', 1)"}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_lines_beside_columns_with_the_names_of_helpers(spark, kind):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\nc"), (3, None)], "doc_id long, text string")
    for name in NAMES:
        docs = docs.withColumn(name, F.expr(KINDS[kind]))
    got = line_dedup.dedup_lines(docs, min_docs=2)
    assert got.columns == [c for c in docs.columns if c not in line_dedup.ADDED] + list(line_dedup.ADDED)
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [(r.kept_text, r.n_lines, r.n_dropped) for r in rows] == [("b", 2, 1), ("c", 2, 1), ("", 1, 0)]
    want = docs.select(F.expr(KINDS[kind])).first()[0]
    assert all(r[c] == want for r in rows for c in NAMES if c not in line_dedup.ADDED)


def test_runs_go_when_a_batch_fails(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("text", F.raise_error(F.lit("broken")).cast("string"))
    before = len(spark.catalog.listTables())
    with pytest.raises(Exception, match="broken"):
        line_dedup.dedup_lines(docs)
    assert len(spark.catalog.listTables()) == before


def kept(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("texts", [["short", "short", "é" * 49], [None], ["", None, "x" * 99], ["a"]])
def test_repeats_in_short_texts_only(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: (len((t or "").encode()), 0, 0, kept(t)) for i, t in enumerate(texts)}


def test_repeats_where_one_file_has_short_texts_only(spark, tmp_path):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(4))
    for name, rows in (("a", [(0, long), (1, long[:150] + "z")]), ("b", [(2, "short"), (3, None), (4, "x" * 99)])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    docs = spark.read.parquet(f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {0: (0, 0, kept(long)), 1: (150, 1, kept("z")), 2: (0, 0, kept("short")), 3: (0, 0, kept(None)), 4: (0, 0, kept("x" * 99))}


def test_small_batches_leave_the_owner_of_the_session_the_choice(spark):
    from paperloom.llm import arrow

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    arrow.small_batches(own)
    assert int(own.conf.get(name)) == arrow.BATCH_BYTES
    rows = own.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) as text")
    sizes = arrow.mapped(rows, "n long", lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)).collect()
    assert sum(r.n for r in sizes) >= 30_000_000 and max(r.n for r in sizes) <= arrow.BATCH_BYTES * 1.1
    chosen = spark.newSession()
    chosen.conf.set(name, 1 << 20)
    arrow.small_batches(chosen)
    assert int(chosen.conf.get(name)) == 1 << 20
