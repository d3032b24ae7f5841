"""Small decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_on(kind: Column, value: Column, targets: Column, user: Column) -> Column:
    """A feature flag: ``boolean``, ``percentage`` of users, or ``targeted`` list; unknown is off."""
    share = F.pmod(F.xxhash64(user), F.lit(100))
    on = F.when(kind == "boolean", value > 0).when(kind == "percentage", share < value).when(kind == "targeted", F.array_contains(targets, user))
    return F.coalesce(on, F.lit(False))


def camel(name: Column) -> Column:
    """``snake_case`` as ``camelCase``."""
    words = F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000))), "")
    return F.concat(F.lower(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most)) * 1.1


def tier(tool: Column, core: list[str], code_only: list[str]) -> Column:
    return F.when(tool.isin(core), "core").when(tool.isin(code_only), "code_only").otherwise("deferred")


def escalation(chars: Column, layout_confidence: Column, least_chars: int = 50) -> Column:
    """Whether a page goes to OCR (too little text), to a vision model (unsure layout), or stays."""
    return F.when(chars <= least_chars, "ocr").when(layout_confidence < 0.3, "vlm").otherwise("none")


def preview(result: Column, most: int) -> Column:
    """A result, or a truncation notice with its first characters and full length."""
    cut = F.struct(F.lit(True).alias("truncated"), F.length(result).alias("chars"), F.substring(result, 1, most).alias("preview"))
    return F.when(F.length(result) > most, F.to_json(cut)).otherwise(result)


def source_kind(name: Column) -> Column:
    """Kind of a raw file by its name; null for files that are no sources."""
    return (
        F.when(F.rlike(name, F.lit(r"(?i)\.pdf$")), "pdf")
        .when(F.endswith(name, F.lit(".compile_prompt.md")), None)
        .when(F.rlike(name, F.lit(r"(?i)\.md$")), "markdown")
        .when(F.rlike(name, F.lit(r"(?i)\.(png|jpe?g|webp|gif)$")), "image")
    )
