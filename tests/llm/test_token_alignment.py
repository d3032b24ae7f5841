"""Token alignment against whole texts encoded at once and cut at common byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import token_alignment as ta


@pytest.fixture(scope="module")
def tokenizers():
    return ta.Tokenizers(ta.Vocabularies.load())


def groups_brute(t, text):
    """Cut where both end; no words, no graph."""
    if not text:
        return []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    x, y = [t.a_bytes[i] for i in a], [t.b_bytes[i] for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return []
    at = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    both = sorted(set(at(x)) & set(at(y)))
    pick = lambda ids, ends, lo, hi: [i for i, e in zip(ids, ends) if lo < e <= hi]
    return [(pick(a, at(x), lo, hi), pick(b, at(y), lo, hi)) for lo, hi in zip([0, *both], both)]


def brute(t, rows):
    found = [(i, groups_brute(t, text)) for i, text in rows]
    linked = [Counter((a, b) for x, y in g for a in x for b in y) for _, g in found]
    held = Counter(p for c in linked for p in c)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, g), c in zip(found, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()),
            sum(k for (a, b), k in c.items() if held[a, b] == best[a]), sum(k * held[p] for p, k in c.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return Counter(out)


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "one two  three \n four\n\nfive\tsix", "\n", "▁", "x ▁ y", "<|endoftext|> <s>x</s> <unk>",
    "naïve Übergröße 日本語のテキスト 😀😀 ́e é ﬁ", "it's they've  I'LL", "don't", "\x1c x\x85y\xa0z  q", "\x00 \x7f", "x" * 3000, "ab " * 2000,
    "word " + "​".join("abc") + " ﻿word", "1234567 12.5e-3 $%& ((()))", "a b c a b c", "a b c a b c", "İstanbul ǅ ß", "\r\n \r\n", "<0x41> <0x0A>",
]


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_documents_of_all_sorts(spark, tokenizers, monkeypatch, chunk):
    monkeypatch.setattr(ta, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ta, "PART_BYTES", 400)
    rows = [*enumerate(TEXTS), (3, "a b c"), (3, "the one"), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("chunk", "pair", "a", "b", "n", "part", "top", "groups"):
        docs = docs.withColumn(name, F.array(F.lit(name)))
    got = ta.alignments(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute(tokenizers, rows)


def test_groups_of_texts(spark, tokenizers):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in ta.groups(docs).collect():
        want = groups_brute(tokenizers, r.text)
        assert [(g.a, g.b) for g in r.groups] == want
        if want:
            assert sum(g.n_bytes for g in r.groups) == len((" " + r.text).encode())


def test_counts_of_pairs(spark, tokenizers):
    rows = [*enumerate(TEXTS), (90, "a b c"), (91, "the one")]
    got = {(r.a, r.b): (r.n, r.top) for r in ta.pair_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = Counter(p for _, t in rows for p in {(a, b) for x, y in groups_brute(tokenizers, t) for a in x for b in y})
    assert got == {(a, b): (n, n == max(k for (c, _), k in held.items() if c == a)) for (a, b), n in held.items()}


def test_words_in_blocks_are_words_alone(tokenizers, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK", 3)
    words = ta.Words(tokenizers)
    text = "the quick brown 日本 f▁x jumps"
    words.add(text.split(" "))
    assert [words.number[w] for w in text.split(" ")].count(0) == 1  # the one that B does not spell
    for w in text.split(" "):
        want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups_brute(tokenizers, w))
        assert words.text[words.number[w]].decode() == want


def test_components_of_any_cuts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < p) + 1, n) for p in rng.random(2))
        x, y = ta.components(a, b)
        common = np.intersect1d(a, b)
        assert x.tolist() == np.searchsorted(common, a).tolist() and y.tolist() == np.searchsorted(common, b).tolist()
        i, j = ta.links(x, y)
        assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(len(a)) for q in range(len(b)) if x[p] == y[q]}


def test_alignment_of_nothing(spark):
    assert ta.alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(TypeError):
        ta.alignments(spark.createDataFrame([], "doc_id string, text string"))
