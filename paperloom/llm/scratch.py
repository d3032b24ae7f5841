"""Intermediate tables in the folder that all executors share.

Loops and reused results are cut by writing Parquet below
``spark.checkpoint.dir``: a lost executor then costs a re-read, not a
recomputation from the source. The folder is taken from the session; only
where it is unset and the master is local (tests, a laptop) a temporary one is
chosen, elsewhere that is an error. Tables that a
returned (lazy) result still reads stay in ``<folder>/paperloom`` until the
owner of the session removes that folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    own = _OWN.get(spark.sparkContext.applicationId)
    base = own or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="paperloom-")
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{folder(spark)}/paperloom/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written once and read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bytes_of(df: DataFrame) -> int:
    """Size on disk of a table of ``written``."""
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later result reads."""
    remove(df.sparkSession, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
