"""The registered queries of the pipeline operators, and the SQL that gives the same rows where SQL can.

Each query reads whole tables and derives the columns of its digest from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmline.llm import ann, collocations, decontamination, language_id, licenses, line_dedup, lm_scoring, mixing, sharding, simhash, token_counts, toxicity, whitening
from ohmline.shared import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mixture takes of it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'n') AS sk,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 2))::INT AS salt
  FROM documents
), placed AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS band FROM words
), sources AS (
  SELECT sk, any_value(source) AS source, sum(size)::DOUBLE AS source_size FROM placed GROUP BY sk
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM sources
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT sk, source_size::BIGINT AS source_size, least(cap, w * max(level) OVER ()) AS target,
         ('0x' || substr(md5('mix-1:' || sk), 1, 6))::BIGINT AS u
  FROM levels
), ranked AS (
  SELECT doc_id, size, source_size, target, u,
         CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216.0)::BIGINT ELSE 0 END AS e,
         row_number() OVER (PARTITION BY sk ORDER BY band, salt, size, doc_id NULLS FIRST) AS k
  FROM placed JOIN targets USING (sk)
)
SELECT doc_id, size, source_size, target,
       (((e * k + u) >> 24) - ((e * (k - 1) + u) >> 24)) * size AS taken,
       (((e * k + u) >> 24) - ((e * (k - 1) + u) >> 24))::INT AS copies
FROM ranked
"""


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all others."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 16, its slot, and its shard of 17."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP3_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS step
), docs AS (
  SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS key, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 3) AS bucket, row_number() OVER () AS r,
         CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
              lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) END AS text_crc32
  FROM documents, steps
), scores AS (
  SELECT r, i, 1 / -ln((('0x' || substr(md5(key || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496) AS score FROM docs, range(17) t(i)
), best AS (SELECT r, arg_max(i, score) FILTER (i < 16)::INT AS shard, arg_max(i, score)::INT AS grown_shard FROM scores GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot, grown_shard
FROM docs JOIN best USING (r)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id's crc32 leaves no 2 modulo 4."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.crc_remainder("doc_id", 4) == 2
    dictionaries = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), dictionaries)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that lie in windows of the benchmark."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, p)),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the least id of its near-duplicates."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines, those that stay, and the digest of the text that they make."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicate_lines(docs).select("doc_id", "n_lines", "n_kept", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
), named AS (SELECT *, array_to_string(w, ' ') AS name, len(w) AS n, doc_id * 1000000 + i AS place FROM lines),
firsts AS (SELECT name, any_value(w) AS w, any_value(n) AS n, min(place) AS place FROM named WHERE n > 0 GROUP BY name),
dropped AS (
  SELECT name, place, k, array_to_string(w[1 : k - 1] || w[k + 1 : n], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM firsts WHERE n >= 5)
), replaced AS (SELECT rest, k, min(place) AS place FROM dropped GROUP BY rest, k),
shortened AS (SELECT rest, min(place) AS place FROM dropped GROUP BY rest),
late AS (
  SELECT d.name FROM dropped d JOIN replaced r ON d.rest = r.rest AND d.k = r.k AND r.place < d.place
  UNION SELECT d.name FROM dropped d JOIN firsts f ON d.rest = f.name AND f.n >= 5 AND f.place < d.place
  UNION SELECT f.name FROM firsts f JOIN shortened s ON s.rest = f.name AND f.n >= 5 AND s.place < f.place
), stay AS (SELECT place FROM firsts WHERE name NOT IN (SELECT name FROM late)),
kept AS (SELECT doc_id, i, l FROM named WHERE n = 0 OR place IN (SELECT place FROM stay))
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(k.n_kept, 0)::BIGINT AS n_kept,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(k.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_kept, string_agg(l, chr(10) ORDER BY i) AS t FROM kept GROUP BY doc_id) k ON d.doc_id = k.doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the mean score of its words under the pair counts of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs).select("doc_id", "n_words", F.round("lm_score", 6).alias("lm_score"))


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), tokens AS (
  SELECT r, k, w[k] AS b, CASE WHEN k > 1 THEN w[k - 1] END AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM docs)
), words AS (SELECT b AS word, count(*) AS c FROM tokens GROUP BY b),
total AS (SELECT count(*)::DOUBLE AS t FROM tokens),
pairs AS (SELECT r, a, b, count(*) AS n FROM tokens WHERE a IS NOT NULL GROUP BY r, a, b),
counts AS (SELECT a, b, sum(n) AS c FROM pairs GROUP BY a, b),
parts AS (
  SELECT p.r, p.n, p.n * CASE WHEN c.c >= 2 THEN ln(c.c::DOUBLE) - ln(x.c::DOUBLE) ELSE ln(0.4::DOUBLE / t) + ln(y.c::DOUBLE) END AS part
  FROM pairs p JOIN counts c USING (a, b) JOIN words x ON x.word = p.a JOIN words y ON y.word = p.b, total
  UNION ALL
  SELECT r, 1, ln(c::DOUBLE) - ln(t) FROM tokens JOIN words ON word = b, total WHERE a IS NULL
), sums AS (SELECT r, sum(part) / sum(n) AS s FROM parts GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(s, 6) AS lm_score FROM docs LEFT JOIN sums USING (r)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from those whose id's crc32 is no multiple of 5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.crc_remainder("doc_id", 5) == 0
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    fitted = toxicity.learn(docs.where(~held_out), labels)
    scored = toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), fitted)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the places of the license phrases in it, and the labels of all templates that its blocks hold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.digest(licenses.scan(docs))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 leading components of all distinct vectors, whitened."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.mine(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 4) t(k) WHERE len(w) >= k)
), counts AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[1 : c], ' ') AS lp, array_to_string(w[c + 1 : k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scores AS (
  SELECT x.lang, x.k, x.p, x.a, l.f AS l, r.f AS r, (1000000 * x.a * x.a) // (l.f * r.f) AS score,
         row_number() OVER (PARTITION BY x.lang, x.p ORDER BY (1000000 * x.a * x.a) // (l.f * r.f), c) AS turn
  FROM cuts x JOIN counts l ON l.lang = x.lang AND l.p = x.lp AND l.k = x.c JOIN counts r ON r.lang = x.lang AND r.p = x.rp AND r.k = x.k - x.c
), covers AS (
  SELECT lang, p, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS p, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE k = 3
  ) GROUP BY lang, p
), stay AS (
  SELECT s.* FROM scores s LEFT JOIN covers c ON s.k = 2 AND c.lang = s.lang AND c.p = s.p WHERE turn = 1 AND NOT coalesce(100 * c.longer >= 50 * s.a, false)
)
SELECT lang, rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM stay) JOIN sizes USING (lang)
WHERE rank <= 2000
"""


def listed(words: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


KNOWN = licenses.prepared(licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD)
OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), templates(label, t, need, h) AS (VALUES %s),
phrases(label, p, n) AS (VALUES %s),
widths AS (SELECT DISTINCT h FROM templates),
blocks AS (
  SELECT r, h, list_distinct(w[b * h + 1 : b * h + 2 * h]) AS s
  FROM (SELECT r, w, h, unnest(range(0, (len(w) + h - 1) // h)) AS b FROM docs, widths)
), meet AS (
  SELECT r, label, len(list_intersect(s, t))::DOUBLE / len(t) AS c FROM blocks JOIN templates USING (h) WHERE len(list_intersect(s, t)) >= need
), places AS (
  SELECT r, label, i - 1 AS i FROM (SELECT r, w, label, p, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, phrases) WHERE w[i : i + n - 1] = p
), based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
both_of AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT r, label, c FROM meet UNION ALL SELECT r, label, 1.0::DOUBLE FROM places) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(c, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN based USING (r) LEFT JOIN both_of USING (r)
""" % (
    ", ".join(f"('{t.label}', {listed(sorted(set(t.words)))}, {t.need}, {t.half})" for t in KNOWN if not t.exact),
    ", ".join(f"('{t.label}', {listed(t.words)}, {len(t.words)})" for t in KNOWN if t.exact),
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_nearest": op2_nearest,
    "op3_sharding": op3_sharding,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_licenses": op11_licenses,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": OP1_SQL,
    "op3_sharding": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op9_lm_scoring": OP9_SQL,
    "op11_licenses": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
