"""Session builder and table access shared by the query modules."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a batch between Spark and Python where an index is built.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(app: str = "paperloom", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects.

    UTC, AQE with coalescing and skew handling, Arrow. On a cluster these are
    the only settings the engine relies on; sizes come from the deployment.
    """
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map={**base, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the input has fewer pieces than cores.

    A table of one file and one row group would else be worked on by one task;
    larger inputs have more pieces than cores and are left as they are, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the batches of what runs within by ``BATCH_BYTES``, unless the session's owner has chosen a bound.

    A task holds a batch outside the heap, again in Python, and there many times
    over in what is made of it; Spark's own bound is 10,000 rows or 64 MB.
    """
    own = spark.conf.get(_BATCH, None) is None
    if own:
        spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        if own:
            spark.conf.unset(_BATCH)


def default_cores() -> str:
    return os.environ.get("BENCH_CPUS", "8")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp()  # the driver serves the file from here
        atexit.register(shutil.rmtree, out, True)
        made = shutil.make_archive(f"{out}/paperloom", "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(made)
