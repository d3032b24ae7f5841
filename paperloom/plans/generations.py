"""Tables that are written whole and replaced: numbered folders below a root.

A generation counts once its marker is there, so a writer that fails leaves the
one before in place; older ones go when a new one is out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Generations kept beside the present one, for readers that still hold it.
KEPT = 1
_READY = "_READY"


def file_system(spark: SparkSession, root: str):  # noqa: ANN201
    """The file system of a folder, and what makes its paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, root: str) -> list[tuple[int, str, bool]]:
    """Number, folder and whether it is finished, of every generation below ``root``."""
    fs, path = file_system(spark, root)
    out = []
    for f in fs.globStatus(path(f"{root}/gen-*")) or ():
        at = f.getPath().toString()
        out.append((int(at.rsplit("/gen-", 1)[1].split("-")[0]), at, fs.exists(path(f"{at}/{_READY}"))))
    return out


def begun(spark: SparkSession, root: str) -> str:
    """The folder of the next generation."""
    return f"{root}/gen-{1 + max((n for n, _, _ in listed(spark, root)), default=0):08d}-{uuid.uuid4().hex[:8]}"


def published(spark: SparkSession, root: str, at: str) -> None:
    """From now on ``at`` counts; all but the last ``KEPT`` before it go."""
    fs, path = file_system(spark, at)
    fs.create(path(f"{at}/{_READY}")).close()
    for _, old, _ in sorted(listed(spark, root), reverse=True)[1 + KEPT :]:
        fs.delete(path(old), True)


def current(spark: SparkSession, root: str) -> str | None:
    """The newest finished generation below ``root``."""
    done = [(n, at) for n, at, ready in listed(spark, root) if ready]
    return max(done)[1] if done else None
