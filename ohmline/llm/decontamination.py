"""Benchmark decontamination with one Aho-Corasick automaton over the normalised words of the test items.

Text is normalised byte by byte (A-Z to a-z, every other ASCII byte that is no letter or digit to a space), so
offsets of words carry over to the original. The words, joined by single spaces, are scanned once. An item is cut into
stretches of half a window; every window of its words holds a whole stretch, so these are the patterns, between spaces.
Around a stretch that is found, the windows of the text that hold it are looked up among those of the items. So the automaton
grows with the words of the items, not with those of all windows, and a stretch that many items share costs no more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import cut, ship, without

ship(__name__)

WINDOW = 10
#: Bytes of item text that one automaton takes, which needs some 100 bytes of memory for each, the table of windows
#: included; more items are dealt over several automata, used one after another.
MAX_BYTES = 4_000_000
#: Lower case for A-Z; a space for the ASCII bytes that are neither letters nor digits.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS_SQL = "array<struct<first:int,last:int,start:int,end:int>>"
FOUND_SQL = f"struct<n_words:long,spans:{SPANS_SQL},items:array<string>>"
SPANS = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
FOUND = pa.struct([("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


class Patterns(NamedTuple):
    """Automaton of the items' stretches, whose hits give bytes and words, and the items (as numbers) of every window."""

    automaton: ahocorasick.Automaton
    windows: dict[bytes, list[int]]
    names: list[list[str]]


def patterns_of(items: list[tuple[list[bytes], list[str]]], width: int) -> Patterns:
    half, stretches, windows = (width + 1) // 2, {}, {}
    for k, (words, _) in enumerate(items):
        whole = min(width, len(words))
        n = half if len(words) >= width else len(words)
        for at in range(0, len(words) - n + 1, n) if n else ():
            stretches[" " + b" ".join(words[at : at + n]).decode("latin-1") + " "] = n
        for at in range(len(words) - whole + 1) if n else ():
            held = windows.setdefault(b" ".join(words[at : at + whole]), [])
            if not held or held[-1] != k:
                held.append(k)
    automaton = ahocorasick.Automaton()
    for pattern, n in stretches.items():
        automaton.add_word(pattern, (len(pattern), n))
    if stretches:
        automaton.make_automaton()
    return Patterns(automaton, windows, [ids for _, ids in items])


def hits(words: list[bytes], patterns: Patterns, width: int) -> tuple[np.ndarray, set[str]]:
    """Which of ``words`` lie in windows of the items, and the ids of these items.

    Around a stretch, the windows of the text that hold it are looked up, each once however many stretches and items
    name it, so a text takes time linear in its words.
    """
    line = b" " + b" ".join(words) + b" "
    spaces, change, found, seen = None, np.zeros(len(words) + 1, np.int64), set(), set()
    for end, (length, n) in patterns.automaton.iter(line.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
        first = bisect_left(spaces, end - length + 1)
        starts = [(s, width) for s in range(max(0, first + n - width), min(first, len(words) - width) + 1)]
        for start, size in [(first, n), *starts] if n < width else starts:  # an item of fewer words is a stretch by itself
            if (start, size) in seen:
                continue
            seen.add((start, size))
            items = patterns.windows.get(line[spaces[start] + 1 : spaces[start + size]])
            if items:
                change[start] += 1
                change[start + size] -= 1
                found.update(items)
    return np.cumsum(change)[:-1] > 0, {name for k in found for name in patterns.names[k]}


def blocks(items: DataFrame, id_col: str, text_col: str, max_bytes: int) -> Iterator[list[tuple[list[bytes], list[str]]]]:
    """The words and ids of the items, in blocks of about ``max_bytes`` at most, equal texts together with all their ids."""
    texts = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(text_col).alias("t")).agg(
        F.collect_set(F.col(id_col).cast("string")).alias("ids")
    )
    total = texts.agg(F.sum(F.octet_length("t") + F.size("ids") * 8)).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    for k in range(n):
        part = texts if n == 1 else texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        yield [(words_of(r["t"]), list(r["ids"])) for r in part.toLocalIterator()]


def scanner(items, width: int):
    """An Arrow UDF from text to what of the broadcast items is in it."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns = once(items, lambda x: patterns_of(x, width))
        for texts in batches:
            out = []
            for text in texts:
                plain = b"" if not text.is_valid else text.as_buffer().to_pybytes().translate(TO_WORDS)
                words = plain.split()
                spans, ids = [], set()
                if words and len(patterns.automaton):
                    hit, ids = hits(words, patterns, width)
                    if ids:
                        spans = runs(hit, plain)
                out.append({"n_words": len(words), "spans": spans, "items": sorted(ids)})
            yield pa.array(out, FOUND)

    return F.arrow_udf(scan, FOUND_SQL)


def runs(hit: np.ndarray, plain: bytes) -> list[dict]:
    """Maximal runs of hit words: first and last word, and where they lie in the original's bytes (end excluded)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    letters = np.frombuffer(plain, np.uint8) != 32
    change = np.diff(np.concatenate(([0], letters.view(np.int8), [0])))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return [
        {"first": int(a), "last": int(b) - 1, "start": int(starts[a]), "end": int(ends[b - 1])}
        for a, b in zip(edges[::2], edges[1::2])
    ]


def merged(spans: pa.Array) -> pa.Array:
    """Spans of each row, where those that meet or overlap are one."""
    out = []
    for row in spans.to_pylist():
        done: list[dict] = []
        for x in sorted(row, key=lambda x: x["first"]):
            if done and done[-1]["last"] + 1 >= x["first"]:
                if x["last"] > done[-1]["last"]:
                    done[-1] |= {"last": x["last"], "end": x["end"]}
            else:
                done.append(x)
        out.append(done)
    return pa.array(out, SPANS)


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words, n_hit, n_items, spans, items``.

    ``items`` are the ids (as strings, sorted) whose windows occur; ``spans`` are the runs of hit words with
    their byte offsets in the original text.

    * Null and empty texts have no words and no hits; items whose id or text is null take no part.
    * An item of fewer words than the window is one window; an item without words has none.
    * Repeated items and documents count each for itself; an empty table on either side gives no hits.
    * Items of more than ``max_bytes`` are scanned block by block, with a written table between two blocks.
    * Input columns named like an output column are replaced.
    """
    spark = docs.sparkSession
    rows = without(docs, "n_words", "n_hit", "n_items", "spans", "items")
    own, done = rows.columns, 0
    for block in blocks(items, item_id_col, item_text_col, max_bytes):
        if done:
            rows = cut(rows)
        rows = rows.withColumn("__found", scanner(share(spark.sparkContext, block), window)(F.col(text_col)))
        spans, found = F.col("__found.spans"), F.col("__found.items")
        if done:
            spans, found = F.concat("spans", spans), F.array_sort(F.array_union("items", found))
        rows = rows.select(*own, F.col("__found.n_words").alias("n_words"), spans.alias("spans"), found.alias("items"))
        done += 1
    if done > 1:
        rows = rows.withColumn("spans", F.arrow_udf(merged, SPANS_SQL)(F.col("spans")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return rows.select(*own, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "spans", "items")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with the columns of ``docs``."""
    own = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    text = own[options.pop("text_col", "text")]
    kept = scan(docs.withColumnsRenamed(own), items, text_col=text, **options).where("n_hit = 0")
    return kept.select(*[F.col(new).alias(old) for old, new in own.items()])
