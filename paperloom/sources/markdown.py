"""Markdown knowledge bases on a file system that Spark reads, and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import rules


def markdown_files(spark: SparkSession, root: str, index_pages: bool = False, hidden: bool = False) -> DataFrame:
    """``path`` below ``root`` and ``content`` of every Markdown file.

    Index and log pages, and files in hidden folders, are left out unless asked
    for (Spark itself skips names that begin with ``.`` or ``_``).
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    short = F.regexp_replace(full, r"^.*?" + "".join("\\" + c if not c.isalnum() else c for c in root.split("://")[-1].rstrip("/")) + "/", "")
    rows = files.select(short.alias("path"), F.col("value").alias("content"))
    if not index_pages:
        rows = rows.filter(~F.element_at(F.split("path", "/"), -1).isin("index.md", "log.md"))
    return rows if hidden else rows.filter(~F.rlike("path", F.lit(r"(^|/)\.")))


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Sources of the raw folder by kind: ``path``, ``kind``, ``length``, ``content``."""
    files = spark.read.format("binaryFile").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", rules.source_kind(name).alias("kind"), "length", "content").filter(F.col("kind").isNotNull() & ~F.startswith(name, F.lit(".")))


def write_entries(markdown: DataFrame, root: str) -> None:
    """Markdown rows as a Parquet knowledge base, partitioned by first folder."""
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(F.lit(""))
    markdown.withColumn("folder", folder).write.mode("overwrite").partitionBy("folder").parquet(root)
