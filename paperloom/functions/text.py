"""Column expressions over text: tokens, links, structure, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an ASCII word, or any other non-blank character.
TOKEN = r"([a-zA-Z0-9]+|[^ \t\r\na-zA-Z0-9])"
#: Fixed value: a bracketed link on one line.
WIKILINK = r"\[\[([^\[\]\n]*)\]\]"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of the index: ASCII words and single other characters."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda x: F.lower(x))


def term_tokens(text: Column) -> Column:
    """Tokens of more than one byte, as the vector model takes them."""
    return F.filter(tokens(text), lambda x: F.octet_length(x) > 1)


def query_tokens(query: str) -> list[str]:
    """Search terms of a query string: its tokens of more than one character."""
    import re

    return sorted({t.lower() for t in re.findall(TOKEN, query) if len(t) > 1})


def wikilinks(text: Column) -> Column:
    """Trimmed, non-empty targets of ``[[...]]``."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: F.length(x) > 0)


def without_fences(text: Column) -> Column:
    """Lines outside fenced blocks; a line that begins with three backticks opens or closes one."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))
    is_fence = lambda x: F.startswith(F.ltrim(x), F.lit("```"))
    walked = F.aggregate(
        lines,
        start,
        lambda acc, x: F.struct(
            (acc["inside"] != is_fence(x)).alias("inside"),
            F.when(acc["inside"] | is_fence(x), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
        ),
    )
    return walked["kept"]


def structure(text: Column) -> list[Column]:
    """Counts of headings, links outside fences, and fenced blocks."""
    open_lines = without_fences(text)
    fences = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.startswith(F.ltrim(x), F.lit("```"))))
    return [
        F.size(F.filter(open_lines, lambda x: F.rlike(x, F.lit(r"^#+[ \t]")))).cast("long").alias("headings"),
        F.size(wikilinks(F.array_join(open_lines, "\n"))).cast("long").alias("links"),
        F.ceil(fences / 2).cast("long").alias("fenced_blocks"),
    ]


def snippet(text: Column, term: str, before: int = 100, after: int = 200) -> Column:
    """Text around the first case-insensitive occurrence, from the start where there is none."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, begin, at - begin + after)).otherwise(F.substring(text, 1, after))


def query_snippet(text: Column, query: str, before: int = 100, after: int = 200) -> Column:
    """Text around the first case-insensitive occurrence of a whole query, empty where there is none."""
    at = F.locate(query.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, begin, at - begin + len(query) + after)).otherwise(F.lit(""))


def escaped_html(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def highlighted(text: Column, term: str) -> Column:
    """Escaped text with occurrences of an alphanumeric term in ``<mark>``."""
    return F.regexp_replace(escaped_html(text), f"(?i)({term})", "<mark>$1</mark>")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def reflowed(text: Column, per_group: int = 5) -> Column:
    """Non-blank lines in groups of five, groups set apart by a blank line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(per_group))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda s: F.array_join(F.slice(lines, s, per_group), "\n")), "\n\n")


def normal_path(path: Column) -> Column:
    """Forward slashes, without leading ``wiki/`` and ``/``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(wiki/)+/*", "")


def domain_of_path(path: Column) -> Column:
    """First folder; else the ``[Domain]`` prefix of the name; else the value for none."""
    prefix = F.regexp_extract(path, r"^\[([^\]]+)\]", 1)
    return (
        F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1)))
        .when(F.length(prefix) > 0, prefix)
        .otherwise(F.lit("未分类"))
    )


def safe_path(domain: Column, title: Column) -> Column:
    """Canonical place of an entry."""
    name = F.regexp_replace(title, r'[/\\:*?"<>|]', "_")
    folder = F.replace(F.lower(domain), F.lit(" "), F.lit("_"))
    return F.concat(folder, F.lit("/["), domain, F.lit("] "), name, F.lit(".md"))


def title_of_path(path: Column) -> Column:
    """The file's stem without a ``[Domain]`` prefix."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    return F.regexp_replace(stem, r"^\[[^\]]*\] ", "")


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-cased tags of three bytes and more, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: F.octet_length(t) >= 3)))


def with_section(body: Column, heading: Column, content: str) -> Column:
    """The body with the text under the first such heading replaced, up to the next heading of its depth or less."""
    lines = F.split(body, "\n", -1)
    depth = lambda x: F.length(F.regexp_extract(x, r"^(#+)[ \t]", 1))
    named = F.transform(lines, lambda x, i: F.when((depth(x) > 0) & (F.trim(F.regexp_replace(x, r"^#+[ \t]+", "")) == F.trim(heading)), i))
    at = F.array_min(named)
    own = depth(F.get(lines, at))
    after = F.array_min(F.transform(lines, lambda x, i: F.when((i > at) & (depth(x) > 0) & (depth(x) <= own), i)))
    rest = F.when(after.isNotNull(), F.slice(lines, after + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.when(at.isNull(), body).otherwise(F.array_join(F.concat(F.slice(lines, 1, at + 1), F.array(F.lit(content)), rest), "\n"))
