"""Arrow plumbing of the Python operators.

Texts are handled as slices of a few MB of UTF-8 at a time, taken from the
Arrow buffers without a copy, so a worker's memory does not follow the number
of rows in a batch (only a single text longer than a slice enlarges it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paperloom.session import ship

SLICE_BYTES = 1 << 20
#: Most bytes of the batches between Spark and Python where texts go whole.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound batches of this session by ``BATCH_BYTES``, unless its owner has chosen a bound.

    Spark's own bound (10,000 rows or 64 MB) lets a task hold several batches of
    whole texts at once, in the executor's memory outside the heap and again in
    Python. A single longer text is a batch of its own.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def check_integer(df: DataFrame, column: str) -> None:
    """Raise where an id is not of an integer type (no cast would keep every value apart)."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must be of an integer type, not {kind.simpleString()}")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(first, after, bytes, offsets)`` of about ``most`` bytes."""
    raw, off = utf8(column)
    first, n = 0, len(off) - 1
    while first < n:
        after = int(np.searchsorted(off, off[first] + most, "right")) - 1
        after = min(n, max(after, first + 1))
        yield first, after, raw[off[first] : off[after]], off[first : after + 1] - off[first]
        first = after


def with_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list[pa.Array]], read_only: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed from Arrow batches; same-named columns are replaced.

    Columns of ``read_only`` are given to ``fn`` and not sent back, which spares
    the way of whole texts where the result does without them.
    """
    new = {f.name for f in fields} | set(read_only)
    kept = [f for f in df.schema.fields if f.name not in new]
    names, added = [f.name for f in kept], [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *fn(batch)], [*names, *added])

    ship(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*kept, *fields]))


def mapped(df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` mapped partition by partition."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
