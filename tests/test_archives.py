"""Archives as a source and sink, and files read by a remote service."""

import base64
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import extraction
from paperloom.sources import archives


def files_of(df):
    return {r.path: bytes(r.content) for r in df.collect()}


@pytest.fixture
def files(spark):
    rows = [(f"wiki/a{i}.md", f"# {i} é\n".encode() * i) for i in range(25)] + [("raw/x.bin", bytes(range(256)))]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3)


@pytest.mark.parametrize("members", [1, 4, 500])
def test_a_base_comes_back_from_its_archive(spark, tmp_path, files, members):
    at = str(tmp_path / "kb")
    archives.write_archive(files, at)
    back = archives.read_archive(spark, at, members)
    assert files_of(back) == files_of(files)
    assert back.rdd.getNumPartitions() >= min(26, 26 // members)
    told = json.loads((tmp_path / "kb" / archives.MANIFEST).read_text())
    assert told["files"] == 26 and told["bytes"] == sum(map(len, files_of(files).values()))


def test_a_target_that_is_not_empty_is_refused_or_replaced(spark, tmp_path, files):
    at = str(tmp_path / "kb")
    archives.write_archive(files, at)
    with pytest.raises(Exception, match="not empty"):
        archives.write_archive(files, at)
    archives.write_archive(files.filter("path = 'raw/x.bin'"), at, overwrite=True)
    assert set(files_of(archives.read_archive(spark, at))) == {"raw/x.bin"}
    assert len(list((tmp_path / "kb").glob("part-*"))) == len(json.loads((tmp_path / "kb" / archives.MANIFEST).read_text())["parts"])


def test_a_failed_write_leaves_no_archive(spark, tmp_path, files):
    bad = files.withColumn("content", F.when(F.col("path") == "wiki/a9.md", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        archives.write_archive(bad, str(tmp_path / "kb"))
    assert not (tmp_path / "kb" / archives.MANIFEST).exists()


def test_a_base_is_merged_only_when_asked(spark, tmp_path, files):
    at = str(tmp_path / "kb")
    archives.write_archive(files.filter("path like 'wiki/a1%'"), at)
    own = spark.createDataFrame([("wiki/a1.md", b"old"), ("wiki/own.md", b"mine")], "path string, content binary")
    with pytest.raises(ValueError, match="not empty"):
        archives.restored(spark, at, own)
    got = files_of(archives.restored(spark, at, own, merge=True))
    assert got["wiki/own.md"] == b"mine" and got["wiki/a1.md"] == "# 1 é\n".encode() and len(got) == 12
    assert len(files_of(archives.restored(spark, at, own.limit(0)))) == 11


def test_tar_archives_and_paths_that_lead_out(spark, tmp_path):
    with tarfile.open(tmp_path / "kb.tar.gz", "w:gz") as t:
        for name, content in (("./wiki/a.md", b"a"), ("../evil.md", b"e"), ("/etc/x", b"x"), ("raw/b", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    assert files_of(archives.read_archive(spark, str(tmp_path / "*.tar.gz"))) == {"wiki/a.md": b"a", "raw/b": b""}
    with pytest.raises(Exception, match="none.zip"):
        archives.read_archive(spark, str(tmp_path / "none.zip")).count()


def test_an_empty_archive(spark, tmp_path, files):
    archives.write_archive(files.limit(0), str(tmp_path / "kb"))
    assert archives.read_archive(spark, str(tmp_path / "kb")).count() == 0


def test_files_read_by_a_remote_service(spark):
    def post(address, body, seconds):
        assert address == "https://reader.example/extract" and seconds == 5
        content = base64.b64decode(json.loads(body)["pdf_base64"])
        return (503, b"") if content == b"busy" else (200, json.dumps({"extracted_text": content.decode() + "\ftwo"}).encode())

    remote = extraction.Remote("far", "https://reader.example/extract", 5, post)
    table = spark.createDataFrame([("a", b"one"), ("b", b"busy")], "path string, content binary")
    got = {r.path: (r.backend, r.pages, r.error) for r in extraction.extract(table, [remote]).collect()}
    assert got == {"a": ("far", ["one", "two"], None), "b": (None, [], "far answered 503")}
    near = extraction.PlainText()
    assert [b.name for b in extraction.by_priority([(1, near), (9, remote)])] == ["far", "text"]
    with pytest.raises(ValueError, match="not an address"):
        extraction.Remote("x", "file:///etc/passwd")
