"""Toxicity: automata against edit distance, lexicon and context on planted documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import toxicity as tx

BAD = ["grumblast", "snorvik", "fleebozon", "quxwort"]
WORDS = "the river ran over old stones and many birds came back to sing near our small green house while it rained".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_automata_find_what_edit_distance_finds(k):
    rnd = random.Random(k)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9)))
    terms = sorted({word() for _ in range(60)} - {""})
    trie, automata = tx.Trie(terms), tx.Automata(k)
    for _ in range(300):
        w = word()
        got = dict(trie.near(w, automata))
        assert got == {n: distance(w, t) for n, t in enumerate(terms) if distance(w, t) <= k}, w


def test_pieces_let_every_near_word_through():
    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randrange(5, 12))) for _ in range(40)})
    pieces = tx._Pieces(terms)
    for t in terms:
        for _ in range(40):
            w = list(t)
            for _ in range(tx.errors_allowed(len(t))):
                at, kind = rnd.randrange(len(w)), rnd.randrange(3)
                w[at : at + (kind > 0)] = [] if kind == 2 else [rnd.choice("abcdez")]
            assert pieces.may("".join(w)), (t, w)


def lexicon():
    return tx.Lexicon([*(tx.Term(b, False, 6.0) for b in BAD), tx.Term("vlarg", True, 5.0)])


@pytest.mark.parametrize(
    ("word", "hidden"), [("snorvik", False), ("sn0rv1k", True), ("snorvvvvik", True), ("snorvk", True), ("grumblsat", True), ("snorvik!!", False), ("vlargung", False)]
)
def test_words_are_found_however_written(word, hidden):
    assert lexicon().look([word])[word][1] is hidden


@pytest.mark.parametrize("word", ["vlarg", "snor", "river", "snobbish", "2024", "qux"])
def test_other_words_are_not(word):
    assert lexicon().look([word])[word] is None


def test_terms_are_chosen_by_documents():
    counts = [("snorvik", 30, 0), ("snor*", 30, 0), ("vlarg*", 20, 1), ("vlargo", 3, 0), ("the", 40, 900), ("rare", 2, 0)]
    assert {(t.text, t.stem) for t in tx.chosen(counts, 40, 1000)} == {("snorvik", False), ("vlarg", True), ("vlargo", False)}
    assert tx.chosen([], 0, 0) == []


def test_quotation_counts_less_than_abuse():
    words = lexicon()
    abuse, quoted, told = (tx.features(words, t) for t in ("you are a snorvik now", 'the label "a snorvik" on the box', "he said the word snorvik means little"))
    assert abuse[1] > 2 * quoted[1] and abuse[1] > 2 * told[1] and quoted[2] > abuse[2]


def made(n=400, seed=4):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        text = [rnd.choice(WORDS) for _ in range(rnd.randrange(20, 60))]
        toxic = int(i % 8 == 0)
        for _ in range(2 * toxic):
            text.insert(rnd.randrange(len(text)), rnd.choice(BAD))
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(made(), "doc_id long, text string, toxic int")
    return tx.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))


def test_unseen_documents(spark, model):
    assert {t.text for t in model.terms} >= set(BAD)
    rows = made(200, 9)
    cases = [
        (1000, "the river ran over a sn0rvik and a fleebozan near our house", 1), (1001, "our old house near the river", 0),
        (1002, None, 0), (1003, "", 0), (1004, "   \n", 0), (1005, 'the word "snorvik" was quoted: he said "snorvik" and many birds came ' + "back to sing " * 9, 0),
    ]
    docs = spark.createDataFrame(rows + cases, "doc_id long, text string, toxic int").withColumn("raw", F.array(F.lit(1))).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in tx.score(docs, model).collect()}
    assert set(got[0].asDict()) == {"doc_id", "toxic", "raw", "score"} and len(got) == len(rows) + len(cases)
    assert all(0 <= r.score <= 1 and r.raw == [1] for r in got.values())
    assert [i for i, r in got.items() if (r.score >= tx.THRESHOLD) != bool(r.toxic)] == []


def test_long_texts_are_read_in_stretches(monkeypatch, model):
    text = " ".join(t for _, t, _ in made(60))
    whole = tx.features(tx.Lexicon(model.terms), text)
    monkeypatch.setattr(tx, "STRETCH", 300)
    parts = tx.features(tx.Lexicon(model.terms), text)
    assert parts[8] == whole[8] and np.allclose(parts, whole, atol=0.2)


def test_learning_from_little(spark):
    docs = spark.createDataFrame([(1, "snorvik"), (1, "birds"), (2, None), (None, "x")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (2, None)], [(None, 1), (2, 0)], [(7, 1), (8, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert [r.score for r in tx.toxicity(docs, labels).collect()] == [0.0] * 4
    both = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in tx.toxicity(docs, both).collect())
    assert tx.toxicity(docs.limit(0), both).count() == 0


def test_the_sample_is_bounded(spark):
    rows = spark.createDataFrame(made(), "doc_id long, text string, toxic int")
    sample, total = tx._sample(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), None, 30)
    assert total == {0: 350, 1: 50}
    assert {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()} == {0: 30, 1: 30}
