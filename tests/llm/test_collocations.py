"""Collocations against plain counting, for any size of shards and ranges, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ohmline.llm import collocations

DOCS = "doc_id long, text string, lang string, score string"


def brute(rows, least=10, top=2000):
    counts, sizes = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "of", "New", "york", "CITY", "a\x01b", "a", "ça", "日本", "\x85x", "'"] + [f"w{i}" for i in range(30)]
    weights = [30, 20, 8, 8, 8, 4, 4, 4, 4, 4, 4] + [1] * 30

    def text(n):
        out = []
        for w in rng.choices(words, weights, k=n):
            out += ["new", "york", "city"] if w == "york" and rng.random() < 0.7 else [w]
            out.append(rng.choice((" ",) * 8 + ("\t", "  ", ". ", ",", "\n", "\r\n", "?!")))
        return "".join(out)

    made = [(i, text(rng.choice((5, 60, 400))), rng.choice(("en", "en", "en", None, "und", "", "fr")), "mine") for i in range(120)]
    hot = [(1000 + i, "same line here again. same line here again", "de", "mine") for i in range(100)]
    odd = [(None, None, "en", None), (2001, "", "en", "x"), (2002, " ,.\n", None, "x"), (2003, "x " * 9, "es", "x"), (2004, "y y y y y y y y y y y", "es", "x"), (2005, "z", "only", "x")]
    return made + hot + odd


def collected(df):
    out = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(set(out)) == len(out)
    return set(out)


def test_against_plain_counting(spark, rows):
    assert collected(collocations.mine(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_shards_ranges_and_borders_change_nothing(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    assert collected(collocations.mine(df, flush=500, range_bytes=2000, sample=5000)) == brute(rows)
    assert collected(collocations.mine(df, least=3, top=7, flush=90, range_bytes=9000)) == brute(rows, 3, 7)


def test_wide_vocabularies(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "NARROW", 4)
    monkeypatch.setattr(collocations, "GATHER", 100)
    assert collected(collocations.mine(spark.createDataFrame(rows, DOCS), flush=2000, range_bytes=9000)) == brute(rows)


def test_nothing_to_mine(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for some in (df.limit(0), df.where("doc_id > 2000"), df.where("text is null")):
        found = collocations.mine(some)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert collected(found) == brute([tuple(r) for r in some.collect()])


def test_long_text(spark):
    rows = [(1, " ".join(f"v{i % 701} q" for i in range(200_000)), "en", "x")]
    assert collected(collocations.mine(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_automata_are_what_was_packed():
    shard = collocations.Shard()
    shard.add("b a b a b. c a b a".encode() + b" z" * 600)
    a = shard.automaton()
    for start, end in ((0, None), (3, 9), (2, 3), (0, 0)):
        x = collocations.unpacked(collocations.packed(a, start, end))
        paths = [tuple(x.words[i - 1] for i in p if i) for p in x.paths.T.tolist()]
        own = [tuple(a.words[i - 1] for i in p if i) for p in a.paths[:, start:end].T.tolist()]
        assert paths == sorted(paths) and [p for p, w in zip(paths, x.weights) if w] == own
        assert [w for w in x.weights if w] == a.weights[start:end].tolist()
        assert all(p[:-1] in paths for p in paths if len(p) > 1)
    both = collocations.union([a, a], np.add)
    assert (both.paths == a.paths).all() and (both.weights == 2 * a.weights).all()
