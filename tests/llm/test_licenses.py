"""License scans against every block and every place, with and without filters, and on odd rows."""

import random
from collections import Counter

import pytest

from ohmline.llm import licenses

DOCS = "doc_id long, text string, n_words string, Blocks string"


def brute(text, templates, phrases, threshold=licenses.THRESHOLD):
    """Number of words, places of the phrases, and all (template, first word) whose block holds enough of the template."""
    words = licenses.words_of(text or "")
    places = sorted((i, label) for label, p in phrases for q in [licenses.words_of(p)] if q for i in range(len(words) - len(q) + 1) if words[i : i + len(q)] == q)
    blocks = {}
    for t in licenses.prepared(templates, [], threshold):
        for start in range(0, len(words), t.half):
            held = len(set(t.words) & set(words[start : start + 2 * t.half])) / len(set(t.words))
            if held * threshold[1] >= threshold[0]:
                blocks[t.number, start] = held
    return len(words), places, blocks


def same(row, templates, phrases):
    n, places, blocks = brute(row["text"], templates, phrases)
    assert row["n_words"] == n
    assert [(p["first"], p["label"]) for p in row["places"]] == places
    assert {(b["template"], b["first"]): b["containment"] for b in row["blocks"]} == pytest.approx(blocks)
    assert len(row["blocks"]) == len(blocks)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in (*licenses.TEMPLATES, *licenses.PHRASES) for w in t.split()}) + ["ä", "x1", "of", "the", "the"]
    mixed = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 40, 300)))) for _ in range(60)]
    edited = []
    for _, text in licenses.TEMPLATES * 4:
        words = text.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(("zz", "the"))
        edited.append(" ".join(["pad"] * rng.randrange(40)) + " " + "\n".join(words).upper() + ". End")
    odd = [None, "", " .,;\n", "All Rights\nReserved all rights reserved, reserved", "CC-BY cc by CC BY", "ccby cc  bye", "naïve CC\tBY ñ", "cc by " * 3000]
    long = ("word " * 20_000) + "general public license " + ("license " * 20_000)
    return [(i, t, "mine", "mine") for i, t in enumerate([*odd, *odd[3:5], *mixed, *edited, long])]


def test_against_every_block(spark, rows):
    found = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"doc_id", "text", "n_words", "places", "blocks"}
    for r in found:
        same(r, licenses.TEMPLATES, licenses.PHRASES)
    assert sum(len(r["blocks"]) for r in found) > 40


def test_several_indexes_and_other_templates(spark, rows):
    templates, phrases = (("a", "the of the the"), ("b", ""), ("c", "of"), ("c", "of")), (("p", "of"), ("q", "..."), ("p", "the the"))
    df = spark.createDataFrame(rows, DOCS)
    one = licenses.scan(df, templates=templates, phrases=phrases)
    many = licenses.scan(df, templates=templates, phrases=phrases, max_words=2)
    for r in one.collect():
        same(r, templates, phrases)
    key = lambda d: sorted((r["doc_id"], r["n_words"], r["places"], sorted(r["blocks"])) for r in d.collect())
    assert key(one) == key(many)


def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    assert licenses.scan(df.limit(0)).count() == 0
    none = licenses.scan(df, templates=(), phrases=()).collect()
    assert all(not r["places"] and not r["blocks"] for r in none) and max(r["n_words"] for r in none) > 40_000


def test_order_is_by_frequency(spark):
    df = spark.createDataFrame([(1, "license license mit"), (2, "license"), (3, "the license")], "doc_id long, text string")
    counts = licenses.document_counts(df, "text", {b"mit", b"license", b"bsd"})
    assert counts == {b"license": 3, b"mit": 1}
    index = licenses.index_of(licenses.prepared((("mit", "mit license"),), (), (1, 1)), counts)
    assert list(index.heads) == [b"mit"] and index.ranks == {b"mit": 0, b"license": 1}


def test_digest(spark):
    texts = ["all rights reserved. cc by", "mit license", "nothing", None]
    found = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    columns = ("n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [tuple(r[c] for c in columns) for r in found] == [
        (2, 0, 3, "cc-by,reserved", "cc-by,reserved", 1.0), (0, None, None, "", "mit", 1.0), (0, None, None, "", "", 0.0), (0, None, None, "", "", 0.0)
    ]
    assert Counter(r["n_words"] for r in found) == {5: 1, 2: 1, 1: 1, 0: 1}
