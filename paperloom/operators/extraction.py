"""Binary documents to rows of page texts, by pluggable backends.

A backend turns the bytes of one file into page texts; backends are tried in
order until one gives text. A file that no backend can read is a row with an
error, not a failed job.
"""

from __future__ import annotations

import base64
import json
import re
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import ship

SCHEMA = "path string, backend string, pages array<string>, n_pages int, quality double, error string"


class Backend(Protocol):
    """What reads the bytes of a file."""

    name: str

    def pages(self, content: bytes) -> list[str]:
        """The texts of the file's pages."""


class PlainText:
    """UTF-8 text, pages set apart by form feeds."""

    name = "text"

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class RoughPdf:
    """Strings shown by a PDF's content streams; no fonts, no layout."""

    name = "rough-pdf"

    def pages(self, content: bytes) -> list[str]:
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        out = []
        for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
            data = m[1]
            try:
                data = zlib.decompress(data)
            except zlib.error:
                pass
            shown = [re.sub(rb"\\([()\\])", rb"\1", x) for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')", data)]
            if shown:
                out.append(b" ".join(shown).decode("latin-1"))
        return out


def n_pages(content: Column) -> Column:
    """Pages of a PDF by its page objects."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]")).cast("int")


def extract(files: DataFrame, backends: list[Backend] | None = None) -> DataFrame:
    """``files(path, content)`` as page texts of the first backend that finds any."""
    ship(files.sparkSession)
    chosen = backends or [RoughPdf(), PlainText()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = (path, None, [], 0, 0.0, "no text")
                for b in chosen:
                    try:
                        pages = [p.strip() for p in b.pages(bytes(content))]
                    except Exception as e:  # a broken file must not end the job
                        row = (*row[:5], str(e)[:200])
                        continue
                    if any(pages):
                        row = (path, b.name, pages, len(pages), min(1.0, sum(map(len, pages)) / max(1, len(content))), None)
                        break
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "backend", "pages", "n_pages", "quality", "error"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def full_text(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.trim(F.array_join("pages", "\n")).alias("text"))


def selected_pages(extracted: DataFrame, spec: str) -> DataFrame:
    """The pages that a range like ``1,3-5`` names, one row each."""
    from paperloom.operators.documents import page_numbers

    each = extracted.select("path", F.posexplode("pages").alias("at", "text"), F.size("pages").alias("n"))
    return each.filter(F.array_contains(page_numbers(F.lit(spec), 99_999), F.col("at") + 1)).select("path", (F.col("at") + 1).alias("page"), "text")


def mixed_pages(own: Column, other: Column, least: int = 100) -> Column:
    """Pages of the first extraction, short ones replaced by the other's."""
    return F.transform(F.arrays_zip(own.alias("a"), other.alias("b")), lambda x: F.when(F.length(F.coalesce(x["a"], F.lit(""))) < least, F.coalesce(x["b"], x["a"])).otherwise(x["a"]))


class Remote:
    """A service that reads files: ``POST endpoint`` with the file in base 64, text in the JSON answer.

    ``post`` sends one request (address, body, seconds) and gives status and body;
    it may be replaced, and runs in the tasks.
    """

    def __init__(self, name: str, endpoint: str, seconds: float = 60.0, post: Callable[[str, bytes, float], tuple[int, bytes]] | None = None):
        if not endpoint.startswith(("https://", "http://")):
            raise ValueError(f"not an address: {endpoint}")
        self.name, self.endpoint, self.seconds, self.post = name, endpoint, seconds, post or _post

    def pages(self, content: bytes) -> list[str]:
        body = json.dumps({"pdf_base64": base64.b64encode(content).decode(), "mode": "text"}).encode()
        status, answer = self.post(self.endpoint, body, self.seconds)
        if not 200 <= status < 300:
            raise ValueError(f"{self.name} answered {status}")
        return str(json.loads(answer)["extracted_text"]).split("\f")


def _post(address: str, body: bytes, seconds: float) -> tuple[int, bytes]:
    request = urllib.request.Request(address, body, {"Content-Type": "application/json"})  # noqa: S310  checked by Remote
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


def by_priority(backends: list[tuple[int, Backend]]) -> list[Backend]:
    """Backends in the order in which they are tried: highest priority first, as given where equal."""
    return [b for _, b in sorted(backends, key=lambda x: -x[0])]
