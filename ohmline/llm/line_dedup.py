"""Line dedup: a line goes if an equal line, or one within an edit of one word, stands earlier in the corpus.

Deletion neighbourhood: two lines differ by one word replaced at place i exactly if dropping word i makes them
equal, and by one word added at place i exactly if dropping it from the longer gives the shorter. Each line emits
the hashed key of itself and of its variants with one word dropped, with and without the place; equal keys are joined.
Of every key only the earliest line counts, so groups are folded by a minimum and no pairs are formed. What is found is
verified on the words of both lines.

Keys are 128 bits of polynomial sums over the words' hashes, so all variants of a line are made in time linear in its
words, many lines at a time. Variants are emitted only for lines that share half of their words with another line. That
loses nothing: one edit leaves the first half or the second half as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmline.shared import cut, drop_table, ship, without

ship(__name__)

#: An edit of one word is within a similarity of 0.8 from so many words on.
LEAST_WORDS = 5
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WHITE = " \t\n\x0b\x0c\r"
SUBSTITUTION, WHOLE, SHORTENED = 0, 1, 2
#: Words that a task works on at a time; words whose hashes a worker keeps, and their bytes at most.
PIECE, KNOWN, LONGEST = 200_000, 1_000_000, 200
#: Odd multipliers of the two sums.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Hashes(dict):
    """Word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value


def mixed(x: np.ndarray, tag: int | np.ndarray) -> np.ndarray:
    """Well-mixed numbers from numbers and a tag."""
    x = x + np.asarray(tag, np.uint64) * np.uint64(0xA0761D6478BD642F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


class Sums:
    """Polynomial sums over the words of some lines: of what stands before a place, and of what stands from a place on."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, which: int):
        self.starts = np.cumsum(counts) - counts
        self.counts, most, base = counts, int(counts.max(initial=0)), BASES[which]
        self.up, self.down = powers(base, most), powers(pow(base, -1, 1 << 64), most)
        place = np.arange(len(hashes)) - np.repeat(self.starts, counts)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes, which + 1) * self.up[place])))

    def before(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.sums[self.starts[line] + place] - self.sums[self.starts[line]]

    def onward(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (self.sums[self.starts[line] + self.counts[line]] - self.sums[self.starts[line] + place]) * self.down[place]

    def without(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The sum of the whole line as if the word at ``place`` were not there."""
        return self.before(line, place) + self.onward(line, place + 1) * self.up[place]


def half_keys(sums: Sums, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the halves that a line shares with any line one edit away, as the shorter or as the longer of both."""
    n = sums.counts
    line = np.flatnonzero(n >= least)
    half, even = n[line] // 2, n[line] % 2 == 0
    # of an even number of words also the first half less a word, of an odd one also the second half less a word
    third = np.where(even, mixed(sums.before(line, half - 1), 1), mixed(sums.onward(line, np.minimum(half + 1, n[line])), 2))
    keys = np.stack((mixed(sums.before(line, half), 1), mixed(sums.onward(line, half), 2), third), axis=1)
    return line, keys.view(np.int64)


def pieces(texts: pa.Array, wanted: list[list[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(row, line, number of words, words) of some lines with words at a time, of all or of the ``wanted`` lines of each row."""
    row, number, counts, words = [], [], [], []
    for r, text in enumerate(texts):
        if not text.is_valid:
            continue
        lines = text.as_buffer().to_pybytes().translate(TO_LOWER).split(b"\n")
        for i in range(len(lines)) if wanted is None else wanted[r]:
            found = lines[i].split()
            if found:
                row.append(r)
                number.append(i)
                counts.append(len(found))
                words += found
                if len(words) >= PIECE:
                    yield np.array(row), np.array(number), np.array(counts), words
                    row, number, counts, words = [], [], [], []
    if row:
        yield np.array(row), np.array(number), np.array(counts), words


def hashed(known: Hashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def keyed(values: np.ndarray, tag: int | np.ndarray) -> pa.Array:
    return pa.array(mixed(values, tag).view(np.int64))


def lines_of(least: int):
    """A function from texts to (row, line, k1, k2, halves) of each line with words."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for row, number, counts, words in pieces(batch.column("text")):
                hashes, every = hashed(known, words), np.arange(len(counts))
                sums = [Sums(hashes, counts, k) for k in (0, 1)]
                line, halves = half_keys(sums[0], least)
                offsets = np.zeros(len(counts) + 1, np.int32)
                offsets[line + 1] = 3
                yield pa.record_batch(
                    [batch.column("row").take(pa.array(row)), pa.array(number, pa.int32()), *(keyed(s.onward(every, every * 0), 0) for s in sums),
                     pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), pa.array(halves.ravel()))],
                    ["row", "line", "k1", "k2", "halves"],
                )

    return lines


def variants_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, kind, row, line, words) of the lines whose numbers come with their text; ``words`` for the lines themselves."""
    known = Hashes()
    for batch in batches:
        for row, number, counts, words in pieces(batch.column("text"), batch.column("numbers").to_pylist()):
            hashes, every = hashed(known, words), np.arange(len(counts))
            sums = [Sums(hashes, counts, k) for k in (0, 1)]
            line = np.repeat(every, counts)
            place = np.arange(len(words)) - np.repeat(sums[0].starts, counts)
            shortened = [s.without(line, place) for s in sums]
            ends = np.cumsum(counts)
            texts = pa.array([b" ".join(words[a:b]) for a, b in zip(ends - counts, ends)], pa.binary())
            for kind, at, keys, text in (
                (WHOLE, every, [keyed(s.onward(every, every * 0), 0) for s in sums], texts),
                (SHORTENED, line, [keyed(s, 0) for s in shortened], pa.nulls(len(line), pa.binary())),
                (SUBSTITUTION, line, [keyed(s, place + 1) for s in shortened], pa.nulls(len(line), pa.binary())),
            ):
                yield pa.record_batch(
                    [*keys, pa.array(np.full(len(at), kind), pa.int32()), batch.column("row").take(pa.array(row[at])), pa.array(number[at], pa.int32()), text],
                    ["k1", "k2", "kind", "row", "line", "words"],
                )


def one_edit(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two lines differ by one word that is replaced, added or dropped, or not at all."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        x, y = sorted((x.split(b" "), y.split(b" ")), key=len)
        first = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
        out.append(len(y) - len(x) <= 1 and x[first + (len(x) == len(y)) :] == y[first + 1 :])
    return pa.array(out)


def row_key(id_col: str, text_col: str) -> Column:
    """What orders and names a row: its id (null last), then the hash of its text."""
    return F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.xxhash64(text_col, F.length(text_col)).alias("text"))


def kept_lines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(row, lines): numbers of the lines with words that stay, for the rows that keep any."""
    rows = docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    row_sql = rows.schema["row"].dataType.simpleString()
    lines = rows.mapInArrow(lines_of(least_words), f"row {row_sql}, line int, k1 long, k2 long, halves array<bigint>")
    place = F.struct("row", "line").alias("place")
    distinct = cut(lines.groupBy("k1", "k2").agg(F.min(place).alias("place"), F.first("halves").alias("halves")))
    halves = distinct.select("k1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    names = halves.join(shared, "half", "left_semi").select("k1").distinct()
    near = distinct.select("k1", "place").join(names, "k1", "left_semi")
    asked = near.groupBy(F.col("place.row").alias("row")).agg(F.sort_array(F.collect_list("place.line")).alias("numbers"))
    texts = rows.join(asked, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("numbers").alias("numbers"))
    variants = cut(texts.mapInArrow(variants_of, f"k1 long, k2 long, kind int, row {row_sql}, line int, words binary"))
    keys = variants.select("k1", "k2", "kind", place)
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place")))
    earliest = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), of(SUBSTITUTION).alias("replaced"), of(WHOLE).alias("whole"), of(SHORTENED).alias("shortened")).where("n > 1")
    other = F.when(F.col("kind") == SUBSTITUTION, F.col("replaced")).when(F.col("kind") == WHOLE, F.col("shortened")).otherwise(F.col("whole"))
    found = keys.join(earliest, ["k1", "k2"]).withColumn("other", other).where("other < place").groupBy("place").agg(F.min("other").alias("other"))
    own = variants.where(F.col("kind") == WHOLE).select(place, "words")
    both = found.join(own, "place").join(own.select(F.col("place").alias("other"), F.col("words").alias("others")), "other")
    later = both.where(F.arrow_udf(one_edit, "boolean")("words", "others")).select("place")
    stay = distinct.select("place").join(later, "place", "left_anti")
    kept = cut(stay.groupBy(F.col("place.row").alias("row")).agg(F.sort_array(F.collect_list("place.line")).alias("lines")))
    for done in (variants, distinct):
        drop_table(done)
    return kept


def deduplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows of ``docs`` with ``n_lines, n_kept, kept_text``; earlier means a smaller id, then line number.

    Lines are compared by their words, with A-Z as a-z. A line goes if an earlier line is equal or, from
    ``least_words`` words on (both lines), is one word edit away, whether or not that line stays itself.

    * Null text: no lines, null kept text. Lines without words always stay and are never copies.
    * Ids may be of any type that has an order; null ids come last. Rows that repeat both id and text are one document,
      and all of them get its result; of rows with one id but other texts, the order is that of the texts' hashes.
    * Long lines and texts are read whole; an empty table gives an empty result.
    * Input columns named like an output column are replaced.
    """
    rows = without(docs, "n_lines", "n_kept", "kept_text")
    kept = kept_lines(docs, id_col, text_col, least_words)
    lines = F.split(F.col(text_col), "\n", -1)
    same = (F.col("d.row.late") == F.col("k.row.late")) & F.col("d.row.id").eqNullSafe(F.col("k.row.id")) & (F.col("d.row.text") == F.col("k.row.text"))
    joined = rows.withColumn("row", row_key(id_col, text_col)).alias("d").join(kept.alias("k"), same, "left")
    stays = lambda line, i: F.array_contains(F.coalesce("k.lines", F.array().cast("array<int>")), i) | (F.trim(line, F.lit(WHITE)) == "")
    staying = F.filter(lines, stays)
    return joined.select(
        *[F.col(f"d.{c}") for c in rows.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(staying)).cast("long").alias("n_kept"),
        F.array_join(staying, "\n").alias("kept_text"),
    )
