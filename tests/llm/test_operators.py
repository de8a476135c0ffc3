"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ohmline.llm import (
    ann,
    components,
    decontamination,
    language_id,
    line_dedup,
    lm_scoring,
    mixing,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97} {'x' * (i % 13)}" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, 0), (4, "one two", "de", None, 7), (5, "one two", "de", "b", 7),
    (5, "one two", "de", "b", 7), (6, LONG, "en", "b", len(LONG)), (None, "Élan vital ÄÖ <|endoftext|> ñ", "fr", "", 9), (None, None, None, None, None), (7, "a\n\nb b b b b b\nb b b b b c\n", "en", "a", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns named like those that operators add."""
    clash = ("size", "target", "Taken", "shard", "slot", "score", "items", "spans", "n_tokens", "kept_text", "lang_pred", "predicted")
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("mine") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# mixing


def test_mix_on_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["copies"] <= 2 for r in rows) and all(r["taken"] == r["copies"] * r["size"] for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    kept = mixing.mixed_rows(odd)
    assert kept.columns == odd.columns and all(r["size"] == "mine" for r in kept.collect())


def test_mix_targets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 40)), s) for i, s in enumerate("aaaaabbbbbbbbbbbbbbbcccccccc" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(tuple, mixing.mix(x).select("doc_id", "size", "source", "source_size", "target", "taken").collect())) for x in (df, df.repartition(7)))
    assert once == again
    total = sum(r[1] for r in once)
    caps, sizes = {}, {}
    for r in once:
        sizes[r[2]] = r[3]
        caps[r[2]] = caps.get(r[2], 0) + r[5]
    level, want, rest, left = 0, {}, 1.5 * total, dict(zip("abc", (5, 2, 1)))
    while left:
        level = rest / sum(left.values())
        full = [s for s in left if left[s] * level > 2 * sizes[s]]
        if not full:
            want |= {s: w * level for s, w in left.items()}
            break
        for s in full:
            want[s] = 2 * sizes[s]
            rest -= want[s]
            del left[s]
    for s in "abc":
        assert next(r[4] for r in once if r[2] == s) == pytest.approx(want[s])
        assert abs(caps[s] - want[s]) < 0.02 * want[s] + 40


# sharding


def test_shard_is_rendezvous(spark, docs):
    rows = sharding.shard(docs).collect()

    def best(key, n):
        h = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(n)]
        return max(range(n), key=lambda i: -1 / math.log(h[i]))

    for r in rows:
        assert r["shard"] == best(r["doc_id"], 16) and r["grown_shard"] == best(r["doc_id"], 17)
        assert r["size"] == len(r["text"].encode()) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shard_weights_and_odd_rows(spark, odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ODD)
    assert next(r for r in rows if r["doc_id"] == 1)["text_crc32"] is None
    assert sharding.shard(odd.limit(0)).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = {r["shard"]: r["count"] for r in sharding.shard(many, weights=(1.0, 3.0, 0.0)).groupBy("shard").count().collect()}
    assert set(share) == {0, 1} and share[1] / 4000 == pytest.approx(0.75, abs=0.03)


# language ID


def test_language_id(spark, docs, odd):
    learned = language_id.learn(docs.where(language_id.crc_remainder("doc_id", 4) != 2))
    found = language_id.identify(docs.withColumn("held", language_id.crc_remainder("doc_id", 4) == 2), learned).where("held").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.9
    rows = language_id.identify(odd, learned).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        silent = not any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == silent and (not silent or r["rejected"]) and 0 <= r["score"] <= 1
    nothing = language_id.learn(odd.limit(0))
    assert nothing == {} and {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_language_margin_does_not_shrink_with_length(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang").where("text is not null")
    held = language_id.crc_remainder("doc_id", 4) == 2
    learned = language_id.learn(rows.where(~held))
    texts = {}
    for r in rows.where(held).orderBy("doc_id").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    joined = {lang: " ".join(parts) for lang, parts in texts.items()}
    long = [(lang, (joined[lang] * (1 + n // len(joined[lang])))[:n]) for lang in learned for n in (20_000, 300_000, 1_000_000, 3_000_000)]
    found = language_id.identify(spark.createDataFrame(long, "lang string, text string"), learned).collect()
    assert len(found) == len(long) and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in found)


def test_every_byte_is_in_one_block():
    data = bytes(range(256)) * 300
    for n in (0, 1, language_id.BLOCK_BYTES, language_id.BLOCK_BYTES + 1, len(data)):
        seen = []
        assert language_id.blockwise(lambda x: seen.append(x) or len(x))(data[:n]) == n
        assert b"".join(seen) == data[:n] and max(map(len, seen)) <= language_id.BLOCK_BYTES


# decontamination


def brute_hits(text, items, width=10):
    lower = lambda s: decontamination.words_of(s or "")
    words, hit, found = lower(text), set(), set()
    for name, item in items:
        w = lower(item)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            part = w[i : i + width]
            for at in range(len(words) - len(part) + 1):
                if words[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "One, two!"), (3, None), (4, "..."), (None, "x"), (1, "zz yy"), (5, "B c d e f g h i j k")]
TEXTS = ["A b-c d e f g h i j k", "one two one TWO", "x zz  yy zz yy", None, "", "a b c d e f g h i", "q a b c d e f g h i j k l m one two", "b" * 50_000]


@pytest.mark.parametrize("max_bytes", [8_000_000, 12])
def test_decontamination(spark, max_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = [(i, t) for i, t in ITEMS if i is not None and t is not None]
    for r in decontamination.scan(docs, items, max_bytes=max_bytes).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(r["text"], known)
        for s in r["spans"]:
            part = r["text"].encode()[s["start"] : s["end"]]
            assert len(decontamination.words_of(part.decode())) == s["last"] - s["first"] + 1


def test_decontamination_on_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontamination.clean(odd, items)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 6, 7, None}
    assert decontamination.scan(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.scan(odd.limit(0), items).count() == 0


# SimHash


def plain_print(text, width=3):
    words = (text or "").encode().translate(simhash.TO_LOWER).split()
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 500, 300)]
        for _ in range(4):
            texts.append(" ".join(words))
            words[int(rng.integers(300))] = "changed"
    texts += [None, "", "one", "one two", "ONE two", "one two three four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(rows).collect()}
    prints = [plain_print(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    for i, p in enumerate(prints):
        assert found[i]["fingerprint"] == f"{p:016x}" and found[i]["component_id"] == find(i)
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(rows).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_pigeonring_finds_every_close_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300)
    rows = [int(b) for b in base]
    for b in base:
        flips = rng.choice(64, rng.integers(1, 6), replace=False)
        v = int(b)
        for f in flips:
            v ^= 1 << int(f)
        rows.append(simhash.signed(v))
    df = spark.createDataFrame([(v,) for v in rows], "fp long").distinct()
    found = {(r["high"], r["low"]) for r in simhash.links(df).collect()}
    values = sorted(set(rows))
    want = {(max(a, b), min(a, b)) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == want


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i + 1, i) for i in range(70)] + [(101, 100)], "high long, low long")
    found = dict(map(tuple, components.roots(path).select("high", "low").collect()))
    assert found == {**{i: 0 for i in range(1, 71)}, 101: 100}


def test_simhash_on_odd_rows(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {1}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.deduplicate(odd.limit(0)).count() == 0


# line dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_dedup(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(4):
            words = [f"w{x}" for x in rng.integers(0, 3, rng.integers(3, 8))]
            lines.append(" ".join(words))
        texts.append("\n".join(lines + [""]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    earlier, want = [], []
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            words = line.split()
            if not words:
                kept.append(line)
                continue
            near = any(w == words or (min(len(w), len(words)) >= 5 and distance(w, words) <= 1) for w in earlier)
            if not near:
                kept.append(line)
            earlier.append(words)
        want.append("\n".join(kept))
    found = {r["doc_id"]: r["kept_text"] for r in line_dedup.deduplicate_lines(rows).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_line_dedup_on_odd_rows(odd):
    rows = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(odd).collect()}
    assert rows[1]["n_lines"] == 0 and rows[1]["kept_text"] is None
    assert rows[7]["kept_text"] == "a\n\nb b b b b b\n" and rows[5]["kept_text"] == "" and rows[4]["kept_text"] == "one two"
    assert line_dedup.deduplicate_lines(odd).count() == len(ODD) and line_dedup.deduplicate_lines(odd.limit(0)).count() == 0


# tokens


def test_token_counts(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    strange = spark.createDataFrame([(i, s) for i, s in enumerate(["\x1c\x1d x y  z", "日本語 テキスト", "👍🏽 ok", "a\r\n\r\n  b", "it's we'LL", "٣٤ ½ ²", "é", "x" * 5000, "<|endoftext|><|endoftext|>"])], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), strange):
        for r in token_counts.count_tokens(table, path).collect():
            n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)
    assert token_counts.count_tokens(odd.limit(0), path).count() == 0


def test_odd_characters_are_found():
    import random

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, odd = Tokenizer.from_file(path), token_counts.odd_finder(token_counts.odd_characters(token_counts.file_text(path)))
    split = regex.compile(token_counts.PATTERN).findall
    assert odd("\u0378") and odd("a \U0001fffe") and not odd("Ordinary, ÄÖ, Кириллица, Ελληνικά, 日本語, 한국어, العربية, हिन्दी, 👍🏽 ½ ٣")
    plain = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if not odd(c)]
    assert len(plain) > 50_000
    rng = random.Random(4)
    for _ in range(3_000):
        text = "".join(rng.choice(("a", "1", " ", "!", "'s", "\n", *rng.choices(plain, k=4))) for _ in range(24))
        assert [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == split(text), repr(text)


def test_token_lookup_serves_all_scripts():
    import public_tokenizers

    text = token_counts.file_text(public_tokenizers.path("byte_bpe_50k.json"))
    lengths, tokenizer, special, odd = token_counts.prepared({"json": text, "lengths": {}, "odd": token_counts.odd_characters(text)})
    for x in ("Кириллица и Ελληνικά", "日本語 テキスト", "👍🏽 ok", "العربية ١٢٣", "हिन्दी"):
        assert not odd(x)
        import regex

        assert sum(map(lengths.__getitem__, regex.findall(token_counts.PATTERN, x))) == len(tokenizer.encode(x).ids)
    assert token_counts.is_byte_level(text) and not token_counts.is_byte_level(text.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


# language-model scores


def plain_scores(texts, order, least=2, backoff=0.4):
    docs = [(t or "").encode().translate(lm_scoring.TO_LOWER).split() for t in texts]
    counts, total, out = Counter(), sum(map(len, docs)), []
    for d in docs:
        counts.update(tuple(d[i : i + k]) for k in range(1, order + 1) for i in range(len(d) - k + 1))
    for d in docs:
        score = 0.0
        for i, w in enumerate(d):
            context = tuple(d[max(0, i - order + 1) : i])
            while context and counts[(*context, w)] < least:
                context, score = context[1:], score + math.log(backoff)
            score += math.log(counts[(*context, w)] / (counts[context] if context else total))
        out.append(score / len(d) if d else None)
    return out


SMALL = {"HOT": 5, "GROUP_ENTRIES": 50, "KNOWN_WORDS": 10, "BUCKET_ENTRIES": 100, "PIECE": 300}


@pytest.mark.parametrize(("order", "bounds"), [(1, SMALL), (2, {}), (2, SMALL), (3, SMALL), (4, SMALL)])
def test_lm_scores(spark, monkeypatch, order, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lm_scoring, name, value)
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 31)
    texts = [" ".join(f"w{x}" for x in rng.choice(30, rng.integers(0, 40), p=share / share.sum())) for _ in range(150)]
    texts += [None, "", "A b", "a B", texts[3], "ß " * 3, "w0 w0 " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for least in (1, 2) if not bounds else (2,):
        want = plain_scores(texts, order, least)
        for r in lm_scoring.score(rows, order=order, least_count=least).collect():
            w = want[r["doc_id"]]
            assert r["n_words"] == len((r["text"] or "").split()) and r["lm_score"] == (None if w is None else pytest.approx(w))


def test_lm_scores_on_odd_rows(spark, odd):
    rows = lm_scoring.score(odd).collect()
    assert len(rows) == len(ODD) and {r["lm_score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {None}
    assert lm_scoring.score(odd.limit(0)).count() == 0


# toxicity


def test_toxicity(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = language_id.crc_remainder("doc_id", 5) == 0
    fitted = toxicity.learn(docs.where(~held), labels.where(~held))
    found = toxicity.score(docs.where(held), fitted).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) / len(found) > 0.97
    clean = "the and of in to is that it was for on are as with his they at be this"
    rude = [(0, clean)] + [(i + 1, f"{clean} {w} {clean}") for i, w in enumerate(("idiot", "1d10t", "m0r0n", "m o r o n", "stuuupid", "l0ser", "w.o.r.t.h.l.e.s.s", "p@thetic", "$cum"))]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rude, "doc_id long, text string"), fitted).collect()}
    assert scores[0] < 0.5 and sum(scores[i] >= 0.5 for i in range(1, len(rude))) >= 8
    rows = toxicity.score(odd, fitted).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    nothing = toxicity.learn(docs.limit(0), labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, nothing).collect()} == {0}


def test_restoring_takes_the_likeliest_word():
    model = toxicity.log_model(["idiot"] * 50 + ["moron"] * 50 + ["the", "and", "lot", "dot"] * 20)
    assert toxicity.restore("1d10t", model) == "idiot" and toxicity.restore("mmmorooon", model) == "moron" and toxicity.restore("m.o.r.o.n", model) == "moron"


def test_spelt_out_words_are_parted_and_not_cut():
    model = toxicity.log_model([*["idiot"] * 50, *["moron"] * 50, *["you"] * 50, *["such"] * 20, *["the", "and", "lot", "dot"] * 20, *["a"] * 40])
    found = lambda text: toxicity.Reader(model).features(text)
    assert "=idiot" in found("y o u i d i o t") and "=idiot" in found("such a i d i o t") and "=idiot" in found("i d i o t!")
    assert "=moron" in found(" ".join("you" * 20 + "moron")) and "=dot" in found("d o t!")
    assert "=idiot" in found("the." * 12 + "1d10t") and "=lot" in found("107")


# nearest neighbours


def test_ann_recall_and_order(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 10)).astype(np.float32)
    v[1000:2000] = v[1000]  # one vector holds a third of the rows
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    rows = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    d = v.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        exact = np.zeros(3000)
        for j in range(10):
            exact += d[q, j] * d[:, j]
        assert [r["score"] for r in mine] == [exact[r["vec_id"]] for r in mine] and q not in [r["vec_id"] for r in mine]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        exact[q] = -np.inf
        hits += len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(3000), -exact))[:20].tolist()))
    assert hits / (150 * 20) >= 0.9


def test_ann_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 20, 0.5), (0, 2, 7, 0.0), (20, 1, 0, 0.5), (20, 2, 7, 0.5)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        if name != "mixing":
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            assert out.count() > 0.75 * docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for table in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, str(tmp_path)).collect()
    corpus_pipeline.run(spark, str(tmp_path)).collect()
