"""Archives of a base as a Spark source and sink (Python Data Source API).

A written archive is a folder of zip parts, one per task, and a manifest that is
put there last: until then nothing counts, and a failed write leaves nothing
behind. Reading lists the members and deals them to partitions; each opens its
archive and reads its own members only. ``.tar.gz`` files, which have no index,
are read whole by one task each.

Paths are of file systems that driver and executors have mounted.
"""

from __future__ import annotations

import json
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from paperloom.session import ship

SCHEMA = "path string, content binary"
MANIFEST = "manifest.json"
FORMAT = "paperloom_archive"
#: Members of a partition.
MEMBERS = 500
BATCH_BYTES = 8 << 20


@dataclass
class _Members(InputPartition):
    archive: str
    first: int = 0
    after: int = -1  # all of an archive without an index


@dataclass
class _Written(WriterCommitMessage):
    part: str
    files: int
    size: int


def _parts(path: str) -> list[str]:
    """The archives that a path stands for: a written folder's parts, or the files themselves."""
    if os.path.isdir(path):
        with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
            return [os.path.join(path, p["part"]) for p in json.load(f)["parts"]]
    found = sorted(glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.members = options["path"], int(options.get("members", MEMBERS))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for part in _parts(self.path):
            if zipfile.is_zipfile(part):
                with zipfile.ZipFile(part) as z:
                    n = len(z.infolist())
                out += [_Members(part, at, min(n, at + self.members)) for at in range(0, n, self.members)]
            else:
                out.append(_Members(part))
        return out or [_Members("", 0, 0)]

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[1])
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"])

    @staticmethod
    def _rows(partition: _Members) -> Iterator[tuple[str, bytes]]:
        if not partition.archive:
            return
        if partition.after >= 0:
            with zipfile.ZipFile(partition.archive) as z:
                for info in z.infolist()[partition.first : partition.after]:
                    if not info.is_dir():
                        yield info.filename, z.read(info)
            return
        with tarfile.open(partition.archive, "r:gz") as t:
            for member in t:
                if member.isfile():
                    yield member.name.removeprefix("./"), t.extractfile(member).read()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        if os.path.exists(self.path) and not os.path.isdir(self.path):
            raise ValueError(f"{self.path} is no folder")
        if os.path.isdir(self.path) and os.listdir(self.path) and not overwrite:
            raise ValueError(f"{self.path} is not empty; write with mode overwrite to replace it")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name, files, size = f"part-{uuid.uuid4().hex}.zip", 0, 0
        with zipfile.ZipFile(os.path.join(self.path, name), "w", zipfile.ZIP_DEFLATED) as z:
            for batch in iterator:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                    files, size = files + 1, size + len(content or b"")
        return _Written(name, files, size)

    def commit(self, messages: list[_Written | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.part)
        os.makedirs(self.path, exist_ok=True)
        told = {"parts": [vars(m) for m in parts], "files": sum(m.files for m in parts), "bytes": sum(m.size for m in parts)}
        fresh = os.path.join(self.path, f".{uuid.uuid4().hex}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(told, f)
        os.replace(fresh, os.path.join(self.path, MANIFEST))
        self._drop(keep={MANIFEST, *(m.part for m in parts)})  # parts of failed attempts, and of the archive before

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(at := os.path.join(self.path, m.part)):
                os.remove(at)

    def _drop(self, keep: set[str]) -> None:
        for name in os.listdir(self.path):
            if name not in keep and name.startswith("part-"):
                os.remove(os.path.join(self.path, name))


class ArchiveSource(DataSource):
    """``path, content`` of the members of archives."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001, ARG002
        return _Writer(dict(self.options), overwrite)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)


def write_archive(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """``files(path, content)`` as an archive; a folder that is not empty is refused unless it may be replaced."""
    _registered(files.sparkSession)
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()


def read_archive(spark: SparkSession, path: str, members: int = MEMBERS) -> DataFrame:
    """``path, content`` of an archive's members; members that lead out of the archive are left out."""
    _registered(spark)
    rows = spark.read.format(FORMAT).option("path", path).option("members", members).load()
    return rows.filter(~F.rlike("path", F.lit(r"(^|/)\.\.(/|$)")) & ~F.rlike("path", F.lit(r"^(/|[A-Za-z]:)")))


def restored(spark: SparkSession, path: str, existing: DataFrame | None = None, merge: bool = False) -> DataFrame:
    """The files of a base after an archive is brought in: ``path, content``.

    A base that has files is refused, unless they are to be merged: members of
    the archive then replace files of the same path, the others stay.
    """
    coming = read_archive(spark, path)
    if existing is None:
        return coming
    if not merge:
        if not existing.isEmpty():
            raise ValueError("the base is not empty; merge to keep what it has")
        return coming
    kept = existing.select("path", F.col("content").cast("binary").alias("content"))
    return kept.join(coming.select("path"), "path", "left_anti").unionByName(coming)
