"""Operators at, below and above their bounds, on hot groups, and their inner steps against brute force."""

import itertools
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ohmline.llm import ann, components, decontamination, language_id, line_dedup, simhash, toxicity


def least_of(pairs, values):
    """Least value reachable from each value."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in values}


# SimHash


@pytest.mark.parametrize("crowd", [3, 1_000])
def test_crowds_are_tied_like_pairs(spark, crowd):
    rng = np.random.default_rng(crowd)
    values = set()
    for centre in rng.integers(0, 1 << 63, 12):
        v = int(centre)
        for _ in range(12):
            values.add(simhash.signed(v))
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), crowd)
    pairs = [(r["high"], r["low"]) for r in found.collect()]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(apart(a, b) <= 3 and a > b for a, b in pairs)
    close = [(a, b) for a, b in itertools.combinations(sorted(values), 2) if apart(a, b) <= 3]
    assert least_of(pairs, values) == least_of(close, values)


def test_a_crowd_of_thousands_makes_no_pairs(spark):
    centre = 0x0123456789ABCDEF
    flips = [sum(1 << b for b in bits) for n in (0, 1, 2, 3) for bits in itertools.combinations(range(33), n)][:5_000]
    df = spark.createDataFrame([(simhash.signed(centre ^ f),) for f in flips], "fp long").distinct()
    links = simhash.links(df, crowd=1_000)
    assert links.count() < 5_000 * 529  # each key sends a fingerprint to so many values at most
    stars = components.roots(links)
    assert stars.select("low").distinct().count() == 1 and stars.count() == len(flips) - 1


# line dedup


def test_lines_around_the_least_words(spark):
    texts = ["a b c d", "a b c x", "a b c d e", "a b c d x", "a b c d e f", "q a b c", "a b c"]
    rows = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    kept = lambda **o: {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(rows, **o).collect()}
    assert [kept()[f"id{i}"] for i in range(7)] == [1, 1, 1, 0, 0, 1, 1]
    assert [kept(least_words=3)[f"id{i}"] for i in range(7)] == [1, 0, 0, 0, 0, 1, 0]
    assert [kept(least_words=7)[f"id{i}"] for i in range(7)] == [1, 1, 1, 1, 1, 1, 1]


def test_very_long_lines(spark):
    words = [f"w{i * i % 7919}" for i in range(200_000)]
    near = [*words[:150_000], "changed", *words[150_001:]]
    far = [*near[:10], "also", *near[11:]]
    rows = spark.createDataFrame(list(enumerate(" ".join(x) for x in (words, near, far, words[1:]))), "doc_id long, text string")
    assert {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(rows).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    rows = spark.createDataFrame(list(enumerate(" ".join(x) for x in (words, far))), "doc_id long, text string")
    assert {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(rows).collect()} == {0: 1, 1: 1}


def test_null_ids_of_any_type_come_last(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), ("x", "a b c d e g"), ("w", "a b c d e h")], "doc_id string, text string")
    assert {r["doc_id"]: r["n_kept"] for r in line_dedup.deduplicate_lines(rows).collect()} == {None: 0, "x": 0, "w": 1}


def test_one_edit_is_verified():
    import pyarrow as pa

    pairs = [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True), ("a c", "a b c", True), ("a b c", "x y c", False), ("a b c", "b a c", False), ("a", "a b c", False), ("a b", "b a c", False)]
    a, b, want = zip(*pairs)
    assert line_dedup.one_edit(pa.array([x.encode() for x in a]), pa.array([x.encode() for x in b])).to_pylist() == list(want)


# decontamination


@pytest.mark.parametrize("width", [1, 2, 3, 7, 10])
def test_windows_by_stretches_are_those_by_brute_force(width):
    rng = np.random.default_rng(width)
    for _ in range(60):
        item = [b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 30))]
        others = [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 12))]
        items = [(item, ["1"]), (others, ["2", "3"])]
        words = [b"%d" % x for x in rng.integers(0, 3, 60)]
        if len(item) > 5:
            words[20 : 20 + len(item)] = item
        hit, ids = np.zeros(len(words), bool), set()
        for own, names in items:
            n = min(width, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[i : i + n]:
                        hit[at : at + n] = True
                        ids.update(names)
        automaton = decontamination.patterns_of(items, width)
        found, names = decontamination.hits(words, automaton, width)
        assert found.tolist() == hit.tolist() and names == ids


def test_items_over_one_automaton_and_under(spark):
    items = [(i, " ".join(f"t{(i * 31 + j * 7) % 400}" for j in range(15 + i % 9))) for i in range(40)]
    docs = [(i, " ".join([*(["x"] * i), items[i][1], "y", items[(i + 1) % 40][1], items[(i + 2) % 40][1]])) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sum(len(t) + 8 for _, t in items)
    results = [sorted((r["doc_id"], r["n_hit"], tuple(r["items"]), tuple(map(tuple, r["spans"]))) for r in decontamination.scan(d, b, max_bytes=n).collect()) for n in (whole, whole - 1, whole // 3)]
    assert results[0] == results[1] == results[2] and all(r[1] >= 40 for r in results[0])


# language ID


def test_predictions_by_hand_for_every_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    learned = language_id.learn(docs.where(language_id.crc_remainder("doc_id", 4) != 2))
    texts = [r["text"] for r in docs.collect()] + ["re", "x", "der die das", "a" * 401, "a" * 399, "ll" * 9_000]

    def size(plain, content, level):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        frame = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False)
        n = -(-len(plain) // language_id.BLOCK_BYTES)
        step = -(-len(plain) // n)
        return sum(len(frame.compress(plain[i : i + step])) for i in range(0, len(plain), step))

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.identify(rows, learned).collect():
        plain = language_id.normalise(r["text"]).encode() if r["text"] else b""
        if not any(map(str.isalpha, r["text"] or "")):
            assert r["lang_pred"] == "und"
            continue
        for level in (language_id.LEVEL, language_id.CLOSER_LEVEL):
            sizes = [(size(plain, content, level), lang) for lang, content in learned.items()]
            (one, lang), (two, _) = sorted(sizes)[:2]
            narrow = two - one < 0.01 * one
            if not narrow:
                break
        assert (r["lang_pred"], r["rejected"]) == (lang, narrow)


def test_more_languages_than_two_hundred(spark):
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(230):
        words = ["".join(letters[i] for i in rng.integers(0, 26, 5)) for _ in range(12)]
        rows += [(k * 10 + i, " ".join(words[j] for j in rng.integers(0, 12, 30)), f"lang{k:03d}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn(docs.where("doc_id % 10 < 5"))
    assert len(learned) == 230
    found = language_id.identify(docs.where("doc_id % 10 = 5"), learned).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)


# toxicity


def test_viterbi_takes_the_best_of_all_paths():
    model = toxicity.log_model(["idiot"] * 30 + ["moron"] * 30 + ["lot", "dot", "too", "it", "tool"] * 10)
    floor = model[""]

    def paths(token):
        last = ""
        options = []
        for c in token:
            letters = toxicity.LEET.get(c, "")
            here = [(x, toxicity.LEET_COST) for x in letters]
            here.append((c, 0.0) if c.isalpha() else ("", toxicity.LEET_SKIP_COST if letters else toxicity.SKIP_COST))
            if c == last and c.isalpha():
                here.append(("", toxicity.REPEAT_COST))
            last = c
            options.append(here)
        for path in itertools.product(*options):
            word = "".join(x for x, _ in path)
            line = f"{toxicity.MARK * 2}{word}{toxicity.MARK}"
            yield sum(cost for _, cost in path) + sum(model.get(line[i : i + 3], floor) for i in range(len(line) - 2)), word

    for token in ("1d10t", "m0r0n", "l00t", "t00l", "i.d.1.o.t", "dd00t", "|d|ot", "1t", "m.0.r.0.n", "!t", "7oo1"):
        assert toxicity.restore(token, model) == max(paths(token))[1], token


@pytest.mark.parametrize("n", [2, 7, 8, 9, 10, 11, 40, 400, 20_000])
def test_disguised_tokens_of_any_length_are_read(n):
    model = toxicity.log_model([*["idiot"] * 50, *["moron"] * 50, *["the"] * 50, *["and"] * 20])
    token = "the." * n + "1d10t"
    assert "idiot" in toxicity.readings(token, model)
    assert "=idiot" in toxicity.Reader(model).features(f"a {'th3-' * n}1d10t b")


def test_all_labelled_documents_are_learned_from(spark):
    """Trigrams that only one document has are those of the model, though there are more documents than a sample had."""
    rng = np.random.default_rng(5)
    filler = lambda: " ".join("".join(rng.choice(list("bdfgklmnprst"), 4)) for _ in range(8))
    rows = [(i, f"{filler()} {'vermin' if i % 10 == 0 else f'clean{i % 7}'} {filler()}", int(i % 10 == 0)) for i in range(3_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    n = toxicity.labelled(docs, docs, "doc_id", "text", "toxic").groupBy("label").count()
    assert {r["label"]: r["count"] for r in n.collect()} == {0: 2_970, 1: 330}
    fitted = toxicity.learn(docs, docs)
    words = {w[:3] for _, text, _ in rows for w in text.split()}
    assert "=vermin" in fitted["weights"] and {t for t in fitted["model"] if t and toxicity.MARK not in t} >= {w for w in words if w.isalpha()}


# nearest neighbours


def test_recall_on_vectors_of_mixed_lengths(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4_000, 24)) * rng.uniform(0.2, 4, size=(4_000, 1))
    v[100:1400] = v[100]  # and one vector holds a third of the rows
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    df = df.union(df.where("vec_id < 700"))
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 4_000, 20):
        exact = v @ v[q]
        exact[q] = -np.inf
        best = np.lexsort((np.arange(4_000), -np.round(exact, 9)))[:20]
        assert len(found[q]) == len(set(found[q])) == 20
        hits += len(set(best.tolist()) & set(found[q]))
    assert hits / (200 * 20) >= 0.9


@pytest.mark.parametrize("kind", ["crowds", "heavy tails", "few giants", "other queries"])
def test_recall_on_crowded_and_uneven_vectors(spark, kind):
    """Codes tell rows of a crowd hardly apart, and a giant lies far off its cell; whatever the queries, recall holds."""
    rng = np.random.default_rng(2)
    n, d = 6_000, 24
    v = rng.normal(size=(n, d))
    if kind in ("crowds", "other queries"):
        v = (v[: n // 500].repeat(500, axis=0) + 0.05 * v)[rng.permutation(n)]
    if kind == "heavy tails":
        v *= np.exp(2 * rng.normal(size=(n, 1)))
    if kind == "few giants":
        v[rng.permutation(n)[:60]] *= 1_000
    if kind == "other queries":
        v[::20] = rng.normal(size=(n // 20, d))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, n, 20):
        exact = v @ v[q]
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20].tolist()) & found[q])
    assert hits / n >= 0.9  # of 20 for each twentieth row


def test_crc_is_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(1,), (-20,), (None,)], "doc_id long").select("doc_id", language_id.crc_remainder("doc_id", 5).alias("r")).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(str(x).encode() if x is not None else b"") % 5 for x in (1, -20, None)]


def test_a_stretch_that_all_items_share_is_scanned_in_linear_time():
    import random
    import time

    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(3000)]
    opening = b"which of the following is".split()
    items = [(opening + rng.choices(words, k=25), [str(i)]) for i in range(20_000)]
    patterns = decontamination.patterns_of(items, 10)
    text = []
    while len(text) < 20_000:
        text += rng.choices(words, k=5) + opening
    text[50:62] = items[7][0][2:14]
    began = time.time()
    hit, ids = decontamination.hits(text, patterns, 10)
    assert time.time() - began < 2 and ids == {"7"} and hit.nonzero()[0].tolist() == list(range(50, 62))
    shared = [(opening * 2 + [w], [str(i)]) for i, w in enumerate(words)]
    hit, ids = decontamination.hits(opening * 500, decontamination.patterns_of(shared, 10), 10)
    assert len(ids) == 3000 and hit.all()


def test_doubled_letters_are_read_as_learned_words():
    model = toxicity.log_model([*["idiot"] * 50, *["moron"] * 50, *["the"] * 50, *["letter"] * 50, *["book"] * 50])
    known = toxicity.Learned(["idiot", "moron", "letter", "book"])
    for token in ("idioot", "iidiot", "mooron", "moronn", "(iddiot)"):
        assert {"idiot", "moron"} & set(toxicity.readings(token, model, known)), token
        assert not {"idiot", "moron"} & set(toxicity.readings(token, model, toxicity.Learned(["book"]))), token
    for token in ("letter", "book", "bookk", "tall"):
        assert not {"idiot", "moron"} & set(toxicity.readings(token, model, known))
        assert token in toxicity.readings(token, model, known)


def test_a_plain_score_is_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    words = toxicity.Learned(f[1:] for f in fitted["weights"] if f.startswith("="))

    def plain(text):
        """Every token read anew, every feature looked up by itself."""
        tokens, found = (text or "").lower().split(), set()
        for t in [*tokens, *toxicity.spaced(tokens, fitted["model"])]:
            for w in toxicity.readings(t, fitted["model"], words):
                found |= {f"={w}"} | {w[:n] for n in toxicity.PREFIXES if len(w) > n}
        total = fitted["bias"] + sum(fitted["weights"].get(f, 0.0) for f in found)
        return 1 / (1 + np.exp(-total))

    assert fitted["weights"]
    for r in toxicity.score(docs, fitted).collect():
        assert r["score"] == pytest.approx(plain(r["text"]), abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)


def test_caches_are_bounded_in_bytes():
    reader = toxicity.Reader(toxicity.log_model(["idiot"]))
    reader.features("x" * 5000 + " short")
    assert set(reader.known) == {"short"}
    hashes = line_dedup.Hashes()
    assert hashes[b"y" * 5000] == hashes[b"y" * 5000] and hashes[b"y"] and len(hashes) == 1


def test_nearest_cells_are_those_of_a_full_sort():
    rng = np.random.default_rng(0)
    for n in (1, 5, 100, 5000, 20_000):
        for _ in range(20):
            scores, held, least = rng.integers(0, rng.choice([1, 3, 50, 10**6]), n).astype(float), rng.integers(0, 5, n), rng.integers(0, 3 * n + 2)
            order = np.argsort(-scores, kind="stable")
            want = order[: int(np.searchsorted(np.cumsum(held[order]), least)) + 1]
            assert sorted(ann.nearest_cells(scores, held, least)) == sorted(want)
