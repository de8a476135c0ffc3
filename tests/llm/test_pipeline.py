"""The stages one after the other against a plain chain, and the registered queries against their contracts."""

import hashlib
import itertools
import math
import zlib

import duckdb
import public_tokenizers
import pytest
import tokenizers
import xxhash
import zstandard

import corpus_pipeline
from ohmline.llm import decontamination, language_id, queries, simhash
from ohmline.shared import cut

SF = "/root/testdata/sf0.001"


def languages(rows):
    """Rows whose language is clear, with dictionaries made as the stage makes them."""
    known = language_id.learn(rows)
    frames = {}
    for level in (language_id.LEVEL, language_id.CLOSER_LEVEL):
        for lang, content in known.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            frames[level, lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)

    def clear(text):
        if text is None or not any(map(str.isalpha, text)):
            return False
        plain = language_id.normalise(text).encode()
        n = -(-len(plain) // language_id.BLOCK_BYTES)
        step = -(-len(plain) // n)
        for level in (language_id.LEVEL, language_id.CLOSER_LEVEL):
            sizes = sorted(sum(len(frames[level, lang].compress(plain[i : i + step])) for i in range(0, len(plain), step)) for lang in known)
            if sizes[1] - sizes[0] >= language_id.MARGIN * sizes[0]:
                return True
        return False

    return clear


def fingerprint(text):
    words = (text or "").encode().translate(simhash.TO_LOWER).split()
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def firsts(rows):
    """The least id of each group of linked fingerprints."""
    prints, root = {}, {}
    for doc_id, text in rows:
        prints.setdefault(fingerprint(text), []).append(doc_id)
    values = list(prints)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), []).extend(prints[v])
    return {min(ids) for ids in groups.values()}


def test_chain_against_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()["text"]
    more = [(1001, None, "en", "web", 0), (1002, "12 ... 34", None, None, 9), (1003, "qq", "en", "web", 2), (1004, first, "de", "web", 0), (1005, first + " zz", "de", None, 0)]
    docs = cut(docs.unionByName(spark.createDataFrame(more, docs.schema)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(max(1, len(w) - 9)) if w}

    def dirty(text):
        words = decontamination.words_of(text)
        return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))

    clear = languages(docs)
    want = [d for d, t in texts.items() if clear(t)]
    chain = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        chain.append(docs)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    of = lambda k: sorted(r["doc_id"] for r in chain[k].select("doc_id").collect())
    assert of(0) == sorted(want) and 0.9 * len(texts) < len(want) < len(texts)
    want = sorted(firsts([(d, texts[d]) for d in want]))
    assert of(1) == want
    want = [d for d in want if not dirty(texts[d])]
    assert of(2) == want
    con = duckdb.connect()
    documents = chain[2].toArrow()  # noqa: F841
    con.register("documents", documents)
    want = sorted(d for d, n in con.execute(f"SELECT doc_id, copies FROM ({queries.OP1_SQL})").fetchall() for _ in range(n))
    assert of(3) == want
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == want

    def best(key, n):
        units = [(int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(n)]
        return max(range(n), key=lambda i: -1 / math.log(units[i]))

    assert all(r["shard"] == best(r["doc_id"], 16) and r["grown_shard"] == best(r["doc_id"], 17) for r in rows)
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


CONTRACT = {
    "op1_mixing": "doc_id long, size long, source_size long, target double, taken long",
    "op2_nearest": "query_id long, rank int, vec_id long, score double",
    "op3_sharding": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op4_language_id": "doc_id long, held_out boolean, lang_pred string, score double",
    "op5_decontamination": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op6_simhash": "doc_id long, fingerprint string, component_id long",
    "op7_line_dedup": "doc_id long, n_lines long, n_kept long, kept_sha256 string",
    "op8_token_counts": "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    "op9_lm_scoring": "doc_id long, n_words long, lm_score double",
    "op10_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op11_licenses": "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    "op12_whitening": "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    "op13_collocations": "lang string, rank long, phrase string, a long, l long, r long, n long, score long",
}
#: Modulus and remainder of the held-out ids.
HELD_OUT = {"op4_language_id": (4, 2), "op10_toxicity": (5, 0)}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_keep_their_contracts(spark, name):
    df = queries.QUERIES[name](spark, SF)
    kinds = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in df.schema.fields}
    assert {c.split(" ")[0]: kinds.get(c.split(" ")[0]) for c in CONTRACT[name].split(", ")} == dict(c.split(" ") for c in CONTRACT[name].split(", "))
    rows = df.collect()
    ids = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    if "doc_id" in kinds:
        assert sorted(r["doc_id"] for r in rows) == ids
    if name in HELD_OUT:
        modulus, rest = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op10_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    if name == "op4_language_id":
        assert {r["lang_pred"] for r in rows} <= {"de", "en", "es", "fr", "und"}
    if name == "op8_token_counts":
        texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        for r in rows:
            n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)
    if name == "op6_simhash":
        texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
        assert {r["component_id"] for r in rows} == firsts(texts)
        prints = {d: f"{fingerprint(t):016x}" for d, t in texts}
        assert all(r["fingerprint"] == prints[r["doc_id"]] for r in rows)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
        found = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        plain = lambda r: tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r)
        assert sorted(plain(tuple(r[c] for c in columns)) for r in rows) == sorted(map(plain, found.fetchall()))
