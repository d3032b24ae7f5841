"""The driver's tables as knowledge entries.

``entries`` has the engine's fixed row shape; one document (with its label, if
any) is one entry. Links are arithmetic in the id, so some dangle on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import spread, table

AS_OF = "2025-01-01 00:00:00"


def path_of(doc_id: Column) -> Column:
    number = doc_id.cast("string")
    return F.concat(F.lit("area"), (doc_id % 7).cast("string"), F.lit("/"), number, F.lit(".md"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entry: identity, tags, links, state, dates, body."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).join(labels, "doc_id", "left")
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    created = F.timestamp_add("DAY", (i % 400).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    updated = F.timestamp_add("DAY", (i % 30).cast("int"), created)
    target = path_of((i * 7 + 3) % 1009)
    alone = (i % 97 == 5) | ((i * 7 + 3) % 1009 % 97 == 5)  # neither refer nor are referred to
    link = F.when(i % 3 == 0, F.concat(F.lit("\n[["), target, F.lit("]] and [[ wiki/"), path_of(i + 1), F.lit(" ]]"))).otherwise("")
    summary = F.when(i % 6 == 1, F.concat(F.lit("> [!ABSTRACT]\n> about number "), i.cast("string"), F.lit("\n"))).otherwise("")
    fence = F.when(i % 4 == 0, F.lit("\n```\n# code [[not/a link.md]]\n```")).otherwise("")
    return docs.select(
        path_of(i).alias("path"),
        "doc_id",
        F.concat(F.lit("doc "), i.cast("string")).alias("title"),
        F.concat(F.lit("area"), (i % 7).cast("string")).alias("domain"),
        F.concat(F.lit("raw/"), "source", F.lit(".pdf")).alias("source"),
        F.concat(((i % 9) + 1).cast("string"), F.lit("-"), ((i % 9) + 3).cast("string"), F.lit(",20")).alias("page"),
        F.when(i % 19 == 0, none)
        .otherwise(
            F.array(
                "source",
                F.concat(F.lit("g"), F.floor(i / 5).cast("string")),
                F.concat(F.lit("h"), F.floor(i / 8).cast("string")),
            )
        )
        .alias("tags"),
        F.when(i % 20 == 0, "L2").when(i % 20 == 1, "L0").otherwise("L1").alias("level"),
        F.when(i % 3 == 0, "high").when(i % 3 == 1, "medium").otherwise("low").alias("confidence"),
        F.when(i % 50 == 0, F.array(path_of(i + 25))).otherwise(none).alias("contradictions"),
        F.when((i % 17 == 0) | alone, none).otherwise(F.array(target)).alias("related"),
        F.when(i % 20 == 0, F.array(path_of(i + 2), path_of(i + 3), path_of(i + 4))).otherwise(none).alias("aggregated_from"),
        F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.5).otherwise(0.0).cast("double").alias("quality_score"),
        F.when(i % 11 == 0, "needs_recompile").when(i % 13 == 0, "pending").otherwise("compiled").alias("status"),
        F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "published").otherwise("draft").alias("publish_status"),
        (i % 4).cast("int").alias("version"),
        created.alias("created"),
        updated.alias("updated"),
        F.when(i % 5 == 0, F.timestamp_add("DAY", F.lit(10), updated)).alias("last_validated"),
        F.concat(F.lit("# doc "), i.cast("string"), F.lit("\n"), summary, F.coalesce("text", F.lit("")), link, fence).alias("body"),
    )


#: The same rows for DuckDB; starts a list of common table expressions.
ENTRIES_SQL = r"""
with lab as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
base as (select d.doc_id as i, d.text, d.source, quality, toxic from documents d left join lab using (doc_id)),
entries as (
  select 'area' || (i % 7) || '/' || i || '.md' as path, i as doc_id, 'doc ' || i as title, 'area' || (i % 7) as domain,
    'raw/' || source || '.pdf' as source, (i % 9 + 1) || '-' || (i % 9 + 3) || ',20' as page,
    case when i % 19 = 0 then []::varchar[] else [source, 'g' || (i // 5), 'h' || (i // 8)] end as tags,
    case when i % 20 = 0 then 'L2' when i % 20 = 1 then 'L0' else 'L1' end as level,
    case when i % 3 = 0 then 'high' when i % 3 = 1 then 'medium' else 'low' end as confidence,
    case when i % 50 = 0 then ['area' || ((i + 25) % 7) || '/' || (i + 25) || '.md'] else []::varchar[] end as contradictions,
    case when i % 17 = 0 or i % 97 = 5 or (i * 7 + 3) % 1009 % 97 = 5 then []::varchar[] else ['area' || ((i * 7 + 3) % 1009 % 7) || '/' || ((i * 7 + 3) % 1009) || '.md'] end as related,
    case when i % 20 = 0 then ['area' || ((i + 2) % 7) || '/' || (i + 2) || '.md', 'area' || ((i + 3) % 7) || '/' || (i + 3) || '.md',
                               'area' || ((i + 4) % 7) || '/' || (i + 4) || '.md'] else []::varchar[] end as aggregated_from,
    cast(case when quality = 1 then 0.9 when quality = 0 then 0.5 else 0.0 end as double) as quality_score,
    case when i % 11 = 0 then 'needs_recompile' when i % 13 = 0 then 'pending' else 'compiled' end as status,
    case when toxic = 1 then 'blocked' when quality = 1 then 'published' else 'draft' end as publish_status,
    cast(i % 4 as int) as version,
    timestamp '2024-01-01' + to_days(cast(i % 400 as int)) as created,
    timestamp '2024-01-01' + to_days(cast(i % 400 + i % 30 as int)) as updated,
    case when i % 5 = 0 then timestamp '2024-01-01' + to_days(cast(i % 400 + i % 30 + 10 as int)) end as last_validated,
    '# doc ' || i || chr(10) || case when i % 6 = 1 then '> [!ABSTRACT]' || chr(10) || '> about number ' || i || chr(10) else '' end || coalesce(text, '') ||
      case when i % 3 = 0 then chr(10) || '[[' || 'area' || ((i * 7 + 3) % 1009 % 7) || '/' || ((i * 7 + 3) % 1009) || '.md]] and [[ wiki/area' || ((i + 1) % 7) || '/' || (i + 1) || '.md ]]' else '' end ||
      case when i % 4 = 0 then chr(10) || '```' || chr(10) || '# code [[not/a link.md]]' || chr(10) || '```' else '' end as body
  from base)
"""
