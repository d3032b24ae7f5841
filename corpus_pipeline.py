"""The training-data pipeline over ``documents``.

Each stage gets what its predecessor kept, written as Parquet and read again,
and returns the columns of ``documents``; the last returns packed token rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import arrow, decontamination, language_id, mixing, packing, scratch, simhash_checked

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language is less likely than this are rejected.
LEAST_SCORE = 0.5
#: Documents of which benchmark passages cover more than this part go.
MOST_HIT = 0.0

#: Language models and near-duplicate hashes are outside SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; ``und``, undecided ones and those that no language fits go."""
    told = language_id.identify(docs, language_id.train(docs))
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & F.col("fits")
    return told.filter(sure).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every near-duplicate group, the one with the smallest id.

    Groups join documents whose 5-word shingles have a Jaccard similarity of 0.8
    or more. Of rows without an id, or that share one, exactly one of a group is
    kept where no document of the group has a smaller id.
    """
    return simhash_checked.one_per_group(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a benchmark passage."""
    found = decontamination.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.coalesce(F.size("hit_words"), F.lit(0)) <= MOST_HIT * F.col("n_words")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that tokens follow the target shares."""
    return mixing.sample(docs).select(*COLUMNS)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows."""
    arrow.small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
