"""Markdown documents: front matter, light metadata, structure, pages, patches."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.session import ship

#: Fixed value: the row shape of an entry's front matter.
ENTRY = (
    "title string, domain string, category string, source string, page string, source_hash string, tags array<string>, level string, "
    "entry_type string, confidence string, contradictions array<string>, related array<string>, aggregated_from array<string>, "
    "quality_score double, status string, publish_status string, version int, created timestamp, updated timestamp, last_validated timestamp"
)
_FRONT = r"(?s)^\s*---(.*?)---\r?\n?(.*)$"
_LISTS = ("tags", "contradictions", "related", "aggregated_from")
_DEFAULTS = {"level": "L1", "quality_score": 0.0, "status": "pending", "publish_status": "draft", "version": 0}


def front_matter(content: Column) -> list[Column]:
    """YAML and body of a Markdown text; the first ``---`` after the opener closes."""
    has = F.rlike(content, F.lit(_FRONT))
    part = lambda i: F.when(has, F.regexp_extract(content, _FRONT, i))
    return [F.trim(part(1)).alias("yaml"), F.when(has, F.regexp_extract(content, _FRONT, 2)).otherwise(content).alias("body")]


def to_markdown(entries: DataFrame) -> DataFrame:
    """Entries as Markdown with front matter: ``path``, ``content``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("---"),
        F.concat(F.lit("title: "), quoted("title")),
        F.concat(F.lit("domain: "), quoted("domain")),
        F.concat(F.lit("source: "), quoted("source")),
        F.concat(F.lit("page: "), quoted("page")),
        *[F.concat(F.lit(f"{c}: "), listed(c)) for c in _LISTS],
        F.concat(F.lit("level: "), "level"),
        F.concat(F.lit("confidence: "), "confidence"),
        F.concat(F.lit("quality_score: "), F.col("quality_score").cast("string")),
        F.concat(F.lit("status: "), "status"),
        F.concat(F.lit("publish_status: "), "publish_status"),
        F.concat(F.lit("version: "), F.col("version").cast("string")),
        F.concat(F.lit("created: "), day("created")),
        F.concat(F.lit("updated: "), day("updated")),
        F.concat(F.lit("last_validated: "), day("last_validated")),
        F.lit("---"),
    ]
    return entries.select("path", F.concat(F.concat_ws("\n", *lines), F.lit("\n"), "body").alias("content"))


def _day(value: object) -> dt.datetime | None:
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        try:
            found = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            return None
        return _day(found)
    return None


def parse_front_matter(source: str | None) -> dict | None:
    """The entry of a YAML text; None unless title, domain and dates are there."""
    import yaml

    try:
        # the loader in C where that is there; it differs in that it takes tabs between a key and its value
        found = yaml.load(source or "", Loader=yaml.SafeLoader if "\t" in (source or "") else getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    if not isinstance(found, dict) or not all(isinstance(found.get(k), str) for k in ("title", "domain")):
        return None
    row: dict = {}
    for name in (p.strip().split(" ")[0] for p in ENTRY.split(",")):
        value = found.get(name, _DEFAULTS.get(name))
        if name in _LISTS:
            if value is not None and not isinstance(value, list):
                return None
            value = [str(x) for x in value or []]
        elif name in ("created", "updated", "last_validated"):
            value = _day(value)
            if value is None and name != "last_validated":
                return None
        elif name == "quality_score":
            value = float(value)
        elif name == "version":
            value = int(value)
        elif value is not None:
            value = str(value)
        row[name] = value
    row["level"] = row["level"].upper()
    return row


def parse_entries(files: DataFrame) -> DataFrame:
    """Markdown files as entries; files that do not parse are no rows."""
    ship(files.sparkSession)
    split = files.select("path", *front_matter(F.col("content"))).filter("yaml is not null")

    @F.pandas_udf(ENTRY)
    def parsed(source: pd.Series) -> pd.DataFrame:
        rows = [parse_front_matter(s) for s in source]
        names = [p.strip().split(" ")[0] for p in ENTRY.split(",")]
        frame = pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names)
        for c in ("created", "updated", "last_validated"):
            frame[c] = pd.to_datetime(frame[c])
        return frame

    return split.withColumn("e", parsed("yaml")).filter("e.title is not null").select("path", "e.*", "body")


def light_meta(content: DataFrame) -> DataFrame:
    """``key: value`` lines of the front matter as a map; rows without a title go."""
    split = content.select("path", *front_matter(F.col("content")))
    lines = F.filter(F.split("yaml", "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.btrim(F.substring(x, F.locate(":", x) + 1, F.length(x)), F.lit(' "')).alias("v"))
    entries = F.map_from_entries(F.transform(lines, pair))
    rows = split.filter("yaml is not null").select("path", entries.alias("meta"))
    return rows.select("path", F.try_element_at("meta", F.lit("title")).alias("title"), F.try_element_at("meta", F.lit("domain")).alias("domain"), F.try_element_at("meta", F.lit("level")).alias("level")).filter("title is not null")


def structure(entries: DataFrame) -> DataFrame:
    return entries.select("path", *text.structure(F.col("body")))


def page_numbers(spec: Column, most: int) -> Column:
    """Sorted distinct pages of ``"1,3,5-7"`` up to ``most``."""
    def pages(part: Column) -> Column:
        low = F.try_to_number(F.trim(F.split_part(part, F.lit("-"), F.lit(1))), F.lit("99999")).cast("int")
        high = F.when(F.contains(part, F.lit("-")), F.try_to_number(F.trim(F.split_part(part, F.lit("-"), F.lit(2))), F.lit("99999")).cast("int")).otherwise(low)
        return F.when(low <= F.least(high, F.lit(most)), F.sequence(low, F.least(high, F.lit(most)))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages))))


def safe(path: Column, extension: str = "md") -> Column:
    """Relative, without ``..``, with the extension."""
    return ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)")) & ~F.rlike(path, F.lit(r"^(/|[A-Za-z]:)")) & F.endswith(path, F.lit(f".{extension}"))


#: Fixed value: what a diff begins with.
DIFF_HEADER = "--- original\n+++ patched\n"


def line_diff(before: Column, after: Column) -> Column:
    """A header, then position-wise changed lines as ``-old`` and ``+new``; an empty side is not told."""
    lines = F.arrays_zip(F.split(before, "\n", -1).alias("a"), F.split(after, "\n", -1).alias("b"))
    changed = F.filter(lines, lambda x: ~x["a"].eqNullSafe(x["b"]))
    side = lambda sign, x: F.when(x != "", F.concat(F.lit(sign), x, F.lit("\n"))).otherwise("")
    told = F.transform(changed, lambda x: F.concat(side("-", x["a"]), side("+", x["b"])))
    return F.concat(F.lit(DIFF_HEADER), F.array_join(told, ""))


def patched(entries: DataFrame, find: str, put: str, every: bool = True) -> DataFrame:
    """Entries after a search-and-replace in bodies; changed ones get a new version."""
    plain = "".join("\\" + c if not c.isalnum() and c != " " else c for c in find)
    new = F.replace("body", F.lit(find), F.lit(put)) if every else F.regexp_replace("body", f"(?s)^(.*?){plain}", F.concat(F.lit("$1"), F.lit(put)))
    rows = entries.withColumn("_new", new).withColumn("version", F.col("version") + (F.col("_new") != F.col("body")).cast("int"))
    return rows.withColumn("body", F.col("_new")).drop("_new")


def abstract(body: Column) -> Column:
    """The trimmed line after the first one that holds an abstract mark, or nothing."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    at = F.array_min(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("[!ABSTRACT]")), i)))
    return F.coalesce(F.trim(F.get(lines, at + 1)), F.lit(""))


def index_line(path: Column, body: Column) -> Column:
    """An entry's line of the index page: its link and its abstract."""
    return F.concat(F.lit("| [["), path, F.lit("]] | "), abstract(body), F.lit(" |"))


def index_page(entries: DataFrame) -> DataFrame:
    """One Markdown line per entry and its place in its domain's part of the index page (by title, then path)."""
    order = Window.partitionBy("domain").orderBy("title", "path")
    line = index_line(F.col("path"), F.col("body"))
    return entries.select("domain", "title", "path", line.alias("line")).select("domain", F.row_number().over(order).alias("place"), "title", "line")


def tree(entries: DataFrame) -> DataFrame:
    """Folders and entries of the browser tree with entry counts."""
    folders = entries.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("name")).agg(F.count("*").alias("entries")).withColumn("is_entry", F.lit(False))
    leaves = entries.select(F.col("title").alias("name"), F.lit(1).cast("long").alias("entries"), F.lit(True).alias("is_entry"))
    return folders.select("name", "entries", "is_entry").unionByName(leaves)


# --- binary documents and markup ---------------------------------------------------


def valid_documents(files: DataFrame, max_bytes: int = 200 << 20) -> DataFrame:
    """Files of the ``binaryFile`` source with a PDF's first bytes and an allowed size."""
    return files.filter((F.col("length") > 0) & (F.col("length") <= max_bytes) & (F.substring("content", 1, 4) == F.lit(b"%PDF")))


def probe_quality(chars: Column, size: Column) -> Column:
    """How to extract, by characters per byte."""
    density = chars / F.greatest(size, F.lit(1))
    return F.when(density >= 0.3, "digital").when(density >= 0.05, "hybrid").otherwise("scanned")


def best_text(*candidates: Column) -> Column:
    """The first backend's text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def page_facts(pages: DataFrame) -> DataFrame:
    """Title, links and visible text length of web pages."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    seen = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    return pages.select(
        "page_id",
        F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"),
        F.length(seen).cast("long").alias("text_chars"),
    )


def with_sections(entries: DataFrame, heading: Column, content: str) -> DataFrame:
    """Entries whose section is replaced; changed ones get a new version."""
    new = text.with_section(F.col("body"), heading, content)
    rows = entries.withColumn("_new", new).withColumn("version", F.col("version") + (F.col("_new") != F.col("body")).cast("int"))
    return rows.withColumn("body", F.col("_new")).drop("_new")


def with_front_matter(entries: DataFrame, **values: Column) -> DataFrame:
    """Entries whose named fields are replaced; changed ones get a new version."""
    unknown = set(values) - set(entries.columns)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    changed = F.lit(False)
    for name, value in values.items():
        changed = changed | ~F.col(name).eqNullSafe(value)
    return entries.withColumns({**values, "version": F.col("version") + changed.cast("int")})


#: Fixed value: a region's corner coordinates as backends print them.
BOX = r"\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]"


def regions(said: DataFrame, around: int = 50) -> DataFrame:
    """Boxes found in a backend's answer, with the characters around each: ``id``, ``place``, ``box``, ``context``."""
    parts = F.split("answer", BOX, -1)
    boxes = F.regexp_extract_all("answer", F.lit(f"({BOX})"), F.lit(1))
    left = lambda i: F.right(F.get(parts, i), F.lit(around))
    each = F.transform(boxes, lambda b, i: F.struct((i + 1).alias("place"), F.transform(F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int")).alias("box"), F.concat(left(i), b, F.left(F.get(parts, i + 1), F.lit(around))).alias("context")))
    return said.select("id", F.inline(each))
