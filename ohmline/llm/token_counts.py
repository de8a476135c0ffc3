"""Token counts by a two-tier lookup of pre-tokens, without a shuffle of pre-tokens.

A byte-level BPE tokenizer splits a text into pre-tokens and encodes each by itself, so the count of a text is
the sum over its pre-tokens. The lengths of the most frequent pre-tokens (of a bounded sample; the choice
changes the speed only) are broadcast as one compact table. A miss is encoded by the tokenizer library and kept
in the worker's cache. This serves texts of all scripts. Which characters the pattern's library and the tokenizer's class
differently (some new or rare ones) is found by splitting all of them with both; texts that hold one are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ohmline.llm.workers import once, share
from ohmline.shared import ship, without

ship(__name__)

LIMIT = 1024
#: Bounds: entries of the broadcast table, documents and characters of the sample it is chosen from, cached misses of a worker.
TABLE_SIZE = 65_536
SAMPLE_DOCS = 4_000
SAMPLE_CHARS = 20_000
SAMPLE_TASKS = 8
CACHE_SIZE = 400_000
#: Characters of a pre-token that is kept, so that the cache is bounded in bytes too.
LONGEST = 200
#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are split by both libraries at a time, to find those that they class differently.
PROBED = 512


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def is_byte_level(tokenizer_json: str) -> bool:
    """Whether the file splits text by the pattern alone, so that its counts are sums over pre-tokens."""
    file = json.loads(tokenizer_json)
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None
        and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
    )


def plain_tokenizer(tokenizer_json: str) -> Tokenizer:
    """The file's tokenizer without truncation and padding."""
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def odd_characters(tokenizer_json: str) -> tuple[str, str]:
    """Patterns of the characters, of the basic plane and of the others, that the libraries split differently or that are not assigned."""
    pre, split = Tokenizer.from_str(tokenizer_json).pre_tokenizer, regex.compile(PATTERN).findall

    def agree(head: str, chars: str) -> bool:
        """Whether all are of the kind of ``head``, and so one piece with it; white space is split both ways instead."""
        text = head + chars if head else "".join(f"a{c}1{c}!{c} {c}\na" for c in chars)
        pieces = [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        return pieces == ([text] if head else split(text))

    def differing(head: str, chars: str) -> list[str]:
        if not chars or agree(head, chars):
            return []
        if len(chars) == 1:
            return [chars]
        half = len(chars) // 2
        return differing(head, chars[:half]) + differing(head, chars[half:])

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    assigned, odd = regex.sub(r"[\p{Cn}\p{Co}]+", "", every), set()
    for head, kind in (("a", r"\p{L}"), ("1", r"\p{N}"), ("!", r"[^\s\p{L}\p{N}]"), ("", r"[\s--[\p{L}\p{N}]]")):
        chars = "".join(regex.findall(kind, assigned, flags=regex.V1))
        odd.update(ord(c) for at in range(0, len(chars), PROBED) for c in differing(head, chars[at : at + PROBED]))
    known = set(map(ord, assigned)) - odd
    return tuple(f"[{''.join(ranges(known, *span))}]" for span in ((0, 0x10000), (0x10000, 0x110000)))


def ranges(known: set[int], first: int, end: int) -> Iterator[str]:
    """What is missing in ``known`` from ``first`` to before ``end``, as parts of a pattern's character class."""
    start = None
    for c in range(first, end + 1):
        if c in known or c == end:
            if start is not None:
                yield f"\\U{start:08x}-\\U{c - 1:08x}"
            start = None
        elif start is None:
            start = c


def odd_finder(patterns: tuple[str, str]):
    """A function from a text to whether it holds an odd character.

    Those of the basic plane are one bit table to the pattern library. The others are a long list of ranges, which is
    only asked about the few characters beyond that plane.
    """
    basic, beyond, others = re.compile(patterns[0]).search, re.compile("[\U00010000-\U0010ffff]").findall, re.compile(patterns[1]).search
    return lambda text: basic(text) is not None or others("".join(set(beyond(text)))) is not None


class Lengths(dict):
    """Pre-token -> number of tokens; a miss is encoded and kept, and the kept misses are dropped when too many."""

    def __init__(self, known: dict[str, int], tokenizer: Tokenizer, room: int):
        super().__init__(known)
        self.known, self.tokenizer, self.most = known, tokenizer, len(known) + room

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.known)
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = n
        return n


def frequent(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """The ``size`` most frequent pre-tokens of a sample of about ``SAMPLE_DOCS`` documents, picked by hash."""
    total = docs.count()
    if not total or not size:
        return []
    part = min(1 << 40, (SAMPLE_DOCS << 40) // total)
    sample = (
        docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 40)) < part)
        .select(F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
        .limit(4 * SAMPLE_DOCS)
        .repartition(SAMPLE_TASKS)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = regex.compile(PATTERN).findall, Counter()
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    n.update(split(text.as_py()))
        top = n.most_common(size)
        yield pa.record_batch([pa.array([p for p, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], ["piece", "n"])

    seen: Counter = Counter()
    for row in sample.mapInArrow(count, "piece string, n long").toLocalIterator():
        seen[row["piece"]] += row["n"]
    return [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:size]]


def prepared(model: dict) -> tuple:
    """What a worker counts with: lengths of pre-tokens, the tokenizer, its special strings, and the odd characters."""
    tokenizer = plain_tokenizer(model["json"])
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return Lengths(model["lengths"], tokenizer, CACHE_SIZE), tokenizer, special, model["odd"] and odd_finder(model["odd"])


def counter(shared):
    """An Arrow UDF from text to its number of tokens."""

    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lengths, tokenizer, special, odd = once(shared, prepared)
        split, length = regex.compile(PATTERN).findall, lengths.__getitem__
        for texts in batches:
            out = []
            for text in texts:
                x = text.as_py() or ""
                if odd and not odd(x) and not any(s in x for s in special):
                    out.append(sum(map(length, split(x))))
                else:
                    out.append(len(tokenizer.encode(x, add_special_tokens=False).ids))
            yield pa.array(out, pa.int64())

    return F.arrow_udf(tokens, "long")


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", limit: int = LIMIT, table_size: int = TABLE_SIZE) -> DataFrame:
    """All rows of ``docs`` with ``n_bytes, n_tokens, over_limit``.

    Counts are those of the tokenizer file's own library for the whole text, without tokens added at the ends;
    strings of special tokens inside a text count as the library's default takes them. Texts go whole to the library if
    the file is no byte-level BPE of the usual pattern, as pre-tokens could not be counted by themselves then.

    * Null and empty texts: 0 bytes, 0 tokens. Long texts are counted whole; equal texts get equal counts.
    * An empty table gives an empty result; input columns named like an output column are replaced.
    """
    rows = without(docs, "n_bytes", "n_tokens", "over_limit")
    text = file_text(tokenizer_path)
    model = {"json": text, "lengths": {}, "odd": None}
    if is_byte_level(text):
        pieces = frequent(rows, text_col, table_size)
        model["lengths"] = {p: len(e.ids) for p, e in zip(pieces, plain_tokenizer(text).encode_batch(pieces, add_special_tokens=False))}
        model["odd"] = odd_characters(text)
    count = counter(share(docs.sparkSession.sparkContext, model))
    counted = rows.withColumn("__tokens", count(F.col(text_col)))
    return counted.select(
        *rows.columns,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col("__tokens").alias("n_tokens"),
        (F.col("__tokens") > limit).alias("over_limit"),
    )
