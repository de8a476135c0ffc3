"""Phrase collocations by weighted acyclic automata over words, one for each shard and range of prefixes.

A phrase of one to three words is a path, and its weight is what the state at its end holds: its count. States share
their prefixes and lie in the sorted order of the phrases, so an automaton is three rows of arrays (depth, last word,
weight) and a list of its words, and may be cut at any phrase if the states above the cut go along with weight zero.

* Shards: a task counts the phrases of its texts and builds an automaton from them in sorted order whenever enough
  words have come together. It is cut at the borders of the prefix ranges, which are the same for all shards.
* Union: a range's automata are merged and their weights summed; phrases below the least count go. A part of a phrase is at
  least as frequent as the phrase, so what stays is whole: all parts of all candidates are in some range.
* Composition: a range asks for the parts of its candidates, as an automaton with the phrases' counts as weights, cut by
  the ranges that have them. There it is composed with the range's own automaton, which gives the parts' counts and goes
  back; the largest weight asked with is the count of the most frequent longer candidate.

Range borders come from a bounded sample and decide who works on what, never a count. A frequent word or pair spreads over as
many ranges as it needs, and a phrase comes once from a shard, however frequent it is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import cut, ship, without

ship(__name__)

LEAST, TOP = 10, 2000
#: A longer candidate of at least so many hundredths of a phrase's count drops the phrase.
COVERS = 50
#: Words after which a shard builds its automata; bytes of text for one range; characters sampled for the borders; states
#: that a union gathers before it merges; groups in which the best are found before all are ranked.
FLUSH, RANGE_BYTES, SAMPLE, GATHER, GROUPS = 1_500_000, 8_000_000, 4_000_000, 3_000_000, 64
#: Words of an automaton up to which a path is one number of three times 21 bits.
NARROW = (1 << 21) - 2
#: Lower case for A-Z, a space for a tab, and a byte that no text holds for what ends a piece.
STOP = b"\xff"
TO_PIECES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))

COUNTED, ASKED, LONGER = 0, 1, 2
ROWS = "range int, source int, kind int, lang string, n long, body binary"
FOUND = "lang string, part int, phrase string, a long, l long, r long, score long"


class Automaton(NamedTuple):
    """Sorted words; for each state, in sorted order, its path as numbers of words from 1 (then zeros), and its weight."""

    words: list[bytes]
    paths: np.ndarray
    weights: np.ndarray


def keys_of(paths: np.ndarray, words: int) -> np.ndarray:
    """One value for each path, in the order of the paths."""
    if words <= NARROW:
        a, b, c = paths.astype(np.int64)
        return a << 42 | b << 21 | c
    return np.ascontiguousarray(paths.T.astype(">u4")).view("S12").ravel()


def paths_of(keys: np.ndarray) -> np.ndarray:
    return np.stack((keys >> 42, keys >> 21 & (1 << 21) - 1, keys & (1 << 21) - 1)).astype(np.int32)


def merged(paths: np.ndarray, weights: np.ndarray, words: list[bytes], fold: np.ufunc) -> Automaton:
    """Paths in order, each once, with the folded weights."""
    if not paths.shape[1]:
        return Automaton(words, paths, weights)
    keys = keys_of(paths, len(words))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return Automaton(words, paths[:, order[starts]], fold.reduceat(weights[order], starts))


def union(automata: list[Automaton], fold: np.ufunc) -> Automaton:
    """All paths of some automata, with their weights folded."""
    words = sorted(set().union(*[a.words for a in automata]))
    number = {w: i for i, w in enumerate(words, 1)}
    named = [np.array([0, *map(number.__getitem__, a.words)], np.int32) for a in automata]
    return merged(
        np.concatenate([names[a.paths] for names, a in zip(named, automata)], axis=1) if automata else np.zeros((3, 0), np.int32),
        np.concatenate([a.weights for a in automata]) if automata else np.zeros(0, np.int64), words, fold,
    )


def above(paths: np.ndarray) -> np.ndarray:
    """The paths one word shorter, of those of two words or more."""
    out = paths[:, paths[1] > 0].copy()
    deep = out[2] > 0
    out[2] = 0
    out[1, ~deep] = 0
    return out


def whole(a: Automaton) -> Automaton:
    """``a`` with the states above its states, which get the weight zero where they were not there."""
    first = above(a.paths)
    more = np.concatenate((first, above(first)), axis=1)
    return merged(np.concatenate((a.paths, more), axis=1), np.concatenate((a.weights, np.zeros(more.shape[1], np.int64))), a.words, np.maximum)


def packed(a: Automaton, start: int = 0, end: int | None = None) -> bytes:
    """The states from ``start`` to ``end`` as bytes, with those above the first of them."""
    paths, weights = a.paths[:, start:end], a.weights[start:end]
    if paths.shape[1]:
        first = above(paths[:, :1])
        head = np.concatenate((above(first), first), axis=1)
        paths, weights = np.concatenate((head, paths), axis=1), np.concatenate((np.zeros(head.shape[1], np.int64), weights))
    depth = (paths > 0).sum(axis=0)
    last = paths[depth - 1, np.arange(len(depth))]
    used, last = np.unique(last, return_inverse=True)
    size = np.min_scalar_type(len(used)).itemsize
    big = weights >= 255
    parts = (
        np.array([len(depth), size, int(big.sum())], np.int64), depth.astype(np.uint8), last.astype(f"<u{size}"),
        np.minimum(weights, 255).astype(np.uint8), weights[big].astype(np.int64),
    )
    return zstandard.compress(b"".join(p.tobytes() for p in parts) + b" ".join([a.words[i - 1] for i in used.tolist()]), 1)


def unpacked(body: bytes) -> Automaton:
    body = zstandard.decompress(body)
    n, size, big = np.frombuffer(body, np.int64, 3).tolist()
    at = 24
    depth = np.frombuffer(body, np.uint8, n, at)
    last = np.frombuffer(body, f"<u{size}", n, at + n).astype(np.int32) + 1
    weights = np.frombuffer(body, np.uint8, n, at + n * (1 + size)).astype(np.int64)
    at += n * (2 + size)
    weights[weights == 255] = np.frombuffer(body[at : at + 8 * big], np.int64)
    places = np.arange(n)
    above_at = lambda d: last[np.maximum.accumulate(np.where(depth == d, places, 0))] if n else last
    paths = np.stack((above_at(1), np.where(depth >= 2, above_at(2), 0), np.where(depth == 3, last, 0))).astype(np.int32)
    return Automaton(body[at + 8 * big :].split(b" ") if n else [], paths, weights)


def weights_in(a: Automaton, asked: Automaton) -> np.ndarray:
    """The composition of ``asked`` with ``a``: where each path of ``asked`` ends in ``a``, or -1."""
    number = {w: i for i, w in enumerate(a.words, 1)}
    names = np.array([0, *[number.get(w, -1) for w in asked.words]], np.int64)
    paths = names[asked.paths]
    known = (paths >= 0).all(axis=0)
    keys, wanted = keys_of(a.paths, len(a.words)), keys_of(np.maximum(paths, 0), len(a.words))
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return np.where(known & (keys[at] == wanted), at, -1) if len(keys) else np.full(len(wanted), -1)


class Shard:
    """The words of one language's texts as numbers, with 0 where a piece ends."""

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            value = self[word] = len(self)
            return value

    def __init__(self):
        self.numbers, self.parts = self.Numbers({STOP: 0}), []

    def add(self, text: bytes) -> int:
        words = text.translate(TO_PIECES).replace(STOP, b" \xff ").split()
        words.append(STOP)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        return len(words)

    def automaton(self) -> Automaton:
        """The counts of all phrases of one to three words."""
        own = list(self.numbers)[1:]
        order = sorted(range(len(own)), key=own.__getitem__)
        rank = np.zeros(len(own) + 1, np.int64)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(own) + 1)
        ids = np.concatenate((*[rank[p] for p in self.parts], np.zeros(2, np.int64)))
        words = [own[i] for i in order]
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        b = np.where(a > 0, b, 0)
        c = np.where(b > 0, c, 0)
        if len(words) <= NARROW:
            one, two = a << 42, a << 42 | b << 21
            keys, counts = np.unique(np.concatenate((one[a > 0], two[b > 0], (two | c)[c > 0])), return_counts=True)
            return Automaton(words, paths_of(keys), counts)
        none = np.zeros_like(a)
        paths = np.concatenate([np.stack(p)[:, k] for p, k in (((a, none, none), a > 0), ((a, b, none), b > 0), ((a, b, c), c > 0))], axis=1)
        return merged(paths.astype(np.int32), np.ones(paths.shape[1], np.int64), words, np.add)


def shards(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[str, Automaton]]:
    """(lang, automaton) of all texts, whenever ``flush`` words have come together and at the end."""
    held: dict[str, Shard] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            size += held.setdefault(lang, Shard()).add(text.as_buffer().to_pybytes())
            if size >= flush:
                yield from ((k, s.automaton()) for k, s in held.items())
                held, size = {}, 0
    yield from ((k, s.automaton()) for k, s in held.items())


def slices(lang: str, a: Automaton, borders: list[tuple[str, tuple[bytes, ...]]]) -> Iterator[tuple[int, bytes]]:
    """(range, packed states) of an automaton; a range ends before the next border."""
    first, end = bisect_left(borders, (lang, ())), bisect_left(borders, (lang + "\0", ()))
    limits = np.zeros((3, end - first), np.int64)
    for k, (_, words) in enumerate(borders[first:end]):
        for depth, word in enumerate(words):
            at = bisect_left(a.words, word)
            limits[depth, k] = at + 1
            if at == len(a.words) or a.words[at] != word:
                break
    edges = [0, *np.searchsorted(keys_of(a.paths, len(a.words)), keys_of(limits, len(a.words))).tolist(), a.paths.shape[1]]
    for k, (start, stop) in enumerate(zip(edges, edges[1:])):
        if start < stop:
            yield first + k, packed(a, start, stop)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of each range, in the order in which they come; of all bodies only one batch is held."""
    rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("range", "kind", "source", "lang", "body")]))
    for key, own in groupby(rows, lambda r: r[0]):
        yield key, ((kind, source, lang, body) for _, kind, source, lang, body in own)


def counter(shared: Broadcast, flush: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = once(shared, lambda x: x)
        for lang, a in shards(batches, flush):
            for k, body in slices(lang, a, borders):
                yield batch_of([(k, -1, COUNTED, lang, 0, body)])

    return count


def adder(least: int):
    """Sums the automata of each range and keeps what reaches ``least``; ``n`` counts the words that were summed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_ranges(batches):
            held: dict[str, list[Automaton]] = {}
            for _, _, lang, body in rows:
                own = held.setdefault(lang, [])
                own.append(unpacked(body))
                if sum(a.paths.shape[1] for a in own[1:]) >= max(GATHER, own[0].paths.shape[1]):
                    held[lang] = [union(own, np.add)]
            for lang, own in held.items():
                a = union(own, np.add)
                n, often = int(a.weights[a.paths[1] == 0].sum()), a.weights >= least
                yield batch_of([(key, key, COUNTED, lang, n, packed(Automaton(a.words, a.paths[:, often], a.weights[often])))])

    return add


def asker(shared: Broadcast):
    """The parts of each range's candidates, with the largest count of a candidate of three words that a pair is part of."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = once(shared, lambda x: x)
        for key, rows in in_ranges(batches):
            for _, _, lang, body in rows:
                x = unpacked(body)
                a, b, c = x.paths
                two, three = x.paths[:, (b > 0) & (c == 0)], x.paths[:, c > 0]
                if not two.shape[1] + three.shape[1]:
                    continue
                ends = np.concatenate((two[0], two[1], three[0], three[2]))
                single = np.stack((ends, np.zeros_like(ends), np.zeros_like(ends)))
                count, none = x.weights[c > 0], np.zeros_like(three[0])
                pairs = np.concatenate((np.stack((three[0], three[1], none)), np.stack((three[1], three[2], none))), axis=1)
                asked = whole(merged(np.concatenate((single, pairs), axis=1), np.concatenate((np.zeros(len(ends), np.int64), count, count)), x.words, np.maximum))
                for k, part in slices(lang, asked, borders):
                    yield batch_of([(k, key, ASKED, lang, 0, part)])

    return ask


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range holds of the parts that it is asked for, and the largest weights that its pairs are asked with."""
    for key, rows in in_ranges(batches):
        held: dict[str, Automaton] = {}
        longer: dict[str, np.ndarray] = {}
        for kind, source, lang, body in rows:
            x = unpacked(body)
            if kind == COUNTED:
                held[lang], longer[lang] = x, np.zeros(x.paths.shape[1], np.int64)
            elif lang in held:
                at = weights_in(held[lang], x)
                there = at >= 0
                np.maximum.at(longer[lang], at[there], x.weights[there])
                yield batch_of([(source, key, ASKED, lang, 0, packed(Automaton(x.words, x.paths, np.where(there, held[lang].weights[at], 0))))])
        for lang, a in held.items():
            yield batch_of([(key, key, LONGER, lang, 0, packed(Automaton(a.words, a.paths, longer[lang])))])


def scored(a: Automaton, parts: Automaton, longer: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(state, l, r, score) of the candidates of ``a`` that no longer one drops, in exact whole numbers."""
    covered = np.zeros(a.paths.shape[1], np.int64)
    at = weights_in(longer, a)
    covered[at >= 0] = longer.weights[at[at >= 0]]
    states = np.flatnonzero((a.paths[1] > 0) & (a.weights > 0) & ((a.paths[2] > 0) | (100 * covered < COVERS * a.weights) | (covered == 0)))
    x, y, z = a.paths[:, states]
    none, deep = np.zeros_like(x), z > 0

    def count(*path: np.ndarray) -> np.ndarray:
        at = weights_in(parts, Automaton(a.words, np.stack(path), none))
        return np.where(at >= 0, parts.weights[at], 0).astype(object)

    own = a.weights[states].astype(object)
    score_of = lambda l, r: 1_000_000 * own * own // np.where(l * r > 0, l * r, 1)
    left, right = count(x, none, none), np.where(deep, count(y, z, none), count(y, none, none))
    left_2, right_2 = count(x, y, none), count(z, none, none)
    score, score_2 = score_of(left, right), score_of(left_2, right_2)
    second = deep & (score_2 < score)
    pick = lambda p, q: np.where(second, q, p).astype(np.int64)
    return states, pick(left, left_2), pick(right, right_2), pick(score, score_2)


def judge(top: int):
    """The best candidates of each range and language."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in in_ranges(batches):
            held: dict[str, dict[int, list[Automaton]]] = {}
            for kind, _, lang, body in rows:
                own = held.setdefault(lang, {}).setdefault(kind, [])
                own.append(unpacked(body))
                if kind == ASKED and sum(a.paths.shape[1] for a in own[1:]) >= max(GATHER, own[0].paths.shape[1]):
                    own[:] = [union(own, np.maximum)]
            for lang, x in held.items():
                if COUNTED not in x or ASKED not in x:
                    continue  # without candidates nothing was asked
                a = x[COUNTED][0]
                states, l, r, points = scored(a, union(x[ASKED], np.maximum), x[LONGER][0])
                names = [b" ".join([a.words[i - 1] for i in p if i]).decode() for p in a.paths[:, states].T.tolist()]
                best = sorted(range(len(states)), key=lambda i: (-points[i], -a.weights[states[i]], names[i].encode()))[:top]
                pick = lambda v: pa.array(np.asarray(v)[best].astype(np.int64), pa.int64())
                yield pa.record_batch(
                    [pa.array([lang] * len(best), pa.string()), pa.array([key % GROUPS] * len(best), pa.int32()), pa.array([names[i] for i in best], pa.string()),
                     pick(a.weights[states]), pick(l), pick(r), pick(points)],
                    [c.split()[0] for c in FOUND.split(", ")],
                )

    return score


def borders_of(rows: DataFrame, ranges: int, chars: int, sample: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """``ranges - 1`` phrases, in order, that cut the phrases of a sample of about ``sample`` characters into equal parts."""
    if ranges < 2:
        return []
    some = rows if chars <= sample else rows.sample(sample / chars, seed=1)

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[Automaton]] = {}
        for lang, a in shards(batches, FLUSH):
            found.setdefault(lang, []).append(a)
        automata = [(lang, union(found[lang], np.add)) for lang in sorted(found)]
        ends, out = np.cumsum([a.paths.shape[1] for _, a in automata]), []
        for k in range(1, ranges) if len(ends) else ():
            at = int(ends[-1]) * k // ranges
            which = int(np.searchsorted(ends, at, "right"))
            lang, a = automata[which]
            path = a.paths[:, at - (int(ends[which - 1]) if which else 0)]
            out.append({"lang": lang, "words": [a.words[i - 1] for i in path.tolist() if i]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("words", pa.list_(pa.binary()))]))

    cuts = some.coalesce(1).mapInArrow(quantiles, "lang string, words array<binary>").collect()
    return sorted({(r["lang"], tuple(map(bytes, r["words"]))) for r in cuts})


def mine(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
    flush: int = FLUSH, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases of two or three words.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and the pieces into words at spaces
    and tabs. ``a`` is the phrase's count, ``n`` that of all words of the language, ``l`` and ``r`` those of the two parts of
    the phrase's lowest-scoring cut, and ``score`` is the floor of 1000000 a a / (l r). Phrases of fewer than ``least``
    occurrences, and pairs in a longer phrase that has at least half as many, are no results.

    * Null and empty texts have no words; a null language is ``und``, together with texts that name it so.
    * Ties of score go to the larger count, then to the phrase in byte order. Repeated rows count each for itself.
    * Texts are read whole, of any length; an empty table gives an empty result; other columns take no part.
    * ``flush`` and ``range_bytes`` bound a task's memory: some 200 bytes a word of the one, 30 a byte of the other.
    """
    spark = docs.sparkSession
    rows = docs.where(F.length(text_col) > 0).select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size, chars = rows.agg(F.sum(F.octet_length("text")), F.sum(F.length("text"))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // range_bytes))
    shared = share(spark.sparkContext, borders_of(rows, ranges, chars or 0, sample))
    dealt = lambda df: df.repartitionById(ranges, "range").sortWithinPartitions("range", "kind")
    counts = cut(dealt(rows.mapInArrow(counter(shared, flush), ROWS)).mapInArrow(adder(least), ROWS))
    asked = counts.mapInArrow(asker(shared), ROWS)
    answers = dealt(counts.unionByName(asked)).mapInArrow(answer, ROWS)
    found = dealt(counts.unionByName(answers)).mapInArrow(judge(top), FOUND)
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    for group in (("lang", "part"), ("lang",)):  # the best of each group of ranges first
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
    words = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
