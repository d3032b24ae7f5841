"""Column expressions that score: hashing buckets, TF-IDF, BM25, decay, cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vector width of the hashing model; a power of two up to 256.
DIM = 256
K1, B = 1.2, 0.75
RRF_K = 60
HALF_LIFE_DAYS = 180
#: Low byte of the 64-bit FNV-1a offset basis and prime.
FNV_BASIS, FNV_PRIME = 0x25, 0xB3


def fnv_bucket(term: Column, dim: int = DIM) -> Column:
    """FNV-1a of the term's bytes and 0xFF, modulo ``dim``.

    ``dim`` divides 256, and the low byte of the hash depends on low bytes only,
    so the arithmetic stays within an int.
    """
    raw = F.encode(term, "UTF-8")
    places = F.when(F.octet_length(term) > 0, F.sequence(F.lit(1), F.octet_length(term))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))
    step = lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(255))
    return F.aggregate(octets, F.lit(FNV_BASIS), step, lambda h: step(h, F.lit(255))).bitwiseAND(F.lit(dim - 1))


def fnv_bucket_of(term: str, dim: int = DIM) -> int:
    """``fnv_bucket`` of one term, for the few terms of a query."""
    h = FNV_BASIS
    for b in (*term.encode(), 255):
        h = ((h ^ b) * FNV_PRIME) & 255
    return h & (dim - 1)


def fnv_buckets(terms: pa.Array, dim: int = DIM) -> np.ndarray:
    """``fnv_bucket`` of many terms, a byte of all of them at a time."""
    size = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    octets = np.frombuffer(b"".join(terms.cast(pa.binary()).to_pylist()), np.uint8)
    begin = np.cumsum(size) - size
    h, left, at = np.full(len(terms), FNV_BASIS, np.uint8), np.flatnonzero(size > 0), 0
    while len(left):
        h[left] = (h[left] ^ octets[begin[left] + at]) * np.uint8(FNV_PRIME)
        at += 1
        left = left[size[left] > at]
    return (((h ^ np.uint8(255)) * np.uint8(FNV_PRIME)) & np.uint8(dim - 1)).astype(np.int64)


def smoothed_idf(total: Column, df: Column) -> Column:
    return F.ln((total + 1) / (df + 1)) + 1


def bm25_part(tf: Column, size: Column, mean_size: Column) -> Column:
    """A term's score but for its weight; grows with ``tf``, falls with ``size``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_size))


def bm25(tf: Column, df: Column, total: Column, size: Column, mean_size: Column) -> Column:
    return F.ln(1 + (total - df + 0.5) / (df + 0.5)) * bm25_part(tf, size, mean_size)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def time_decay(days: Column) -> Column:
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), days / HALF_LIFE_DAYS))


def decay_score(quality: Column, days: Column) -> Column:
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return clamp(clamp(quality) * time_decay(days))


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 2).when(confidence == "low", 0).otherwise(1)


def confidence_name(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 0, "low").otherwise("medium")


def protection(in_degree: Column, least: int) -> Column:
    return F.when(in_degree >= 3 * least, "critical").when(in_degree >= 2 * least, "protected").otherwise("normal")
