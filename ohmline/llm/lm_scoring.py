"""Language-model scores by stupid backoff, computed relationally from n-gram count tables.

The score of a word after its context is the count of both over the count of the context, if both occur often enough
together to be kept in the count table; else it is the score after the context less its first word, discounted. Without
a context it is the word's share of all words.

For every order the n-grams of a document are folded where they are read, and travel once: they are partitioned by the
hash of their context, many to a row as parallel arrays, and exploded there. The count tables of n-grams and contexts are
made in the same partitions, bucket by bucket, and joined to the n-grams that lie there. What is not kept goes on to the
partition of the next shorter context; a broadcast list of frequent words ends most of that, and the rest is joined to the
table of word counts. The parts of a document are summed at the end.

Words are told apart by 64 bits, an n-gram by 64 bits of its context and 64 of its last word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.shared import cut, drop_table, ship, without

ship(__name__)

ORDER, BACKOFF, LEAST_COUNT = 2, 0.4, 2
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words that a task folds at a time; bits of a document's number among them.
PIECE, DOC_BITS = 300_000, 15
#: N-grams that a bucket is meant to hold, buckets for each partition (so that partitions are even), and partitions at most.
BUCKET_ENTRIES, BUCKETS_A_PARTITION, MOST_PARTITIONS = 120_000, 6, 50_000
#: N-grams of one word as context that may meet in a task; those of a more frequent word are dealt by what follows it.
GROUP_ENTRIES = 1_500_000
#: Bound of the broadcast list of frequent words.
KNOWN_WORDS = 1 << 18
#: Bounds of the sample that frequent n-grams are picked from, and of their list: any other has a share of about one in so many.
SAMPLE_DOCS, SAMPLE_TASKS, HOT = 3_000, 8, 500
#: What a row holds: n-grams, the keys of documents, words without a context.
GRAMS, NAMES, ALONE = range(3)
#: Counts that a row gives for all its n-grams (null: to be summed), and for each its context, how often the context
#: occurs (once for all its n-grams), its last word, document, occurrences, those asked for (null: all), shorter contexts.
NESTED = (
    "bucket int, kind int, batch long, context_count long, gram_count long, gs array<bigint>, totals array<int>, "
    "seconds array<bigint>, docs array<smallint>, ns array<int>, askeds array<int>, shorters array<array<bigint>>"
)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words, docs): keys of some documents, hashes of all their words, and whose word each is."""
    digest, known = xxhash.xxh64_intdigest, {}
    rows, words, lengths, held = [], [], [], 0
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            found = text.as_buffer().to_pybytes().translate(TO_LOWER).split() if text.is_valid else []
            if not found:
                continue
            for w in found:
                if w not in known:
                    known[w] = digest(w) - (1 << 63)
            rows.append(row)
            words.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            lengths.append(len(found))
            held += len(found)
            if len(rows) == (1 << DOC_BITS) - 1 or held >= PIECE:
                yield np.array(rows), np.concatenate(words), np.repeat(np.arange(len(rows)), lengths)
                rows, words, lengths, held, known = [], [], [], 0, {}
    if rows:
        yield np.array(rows), np.concatenate(words), np.repeat(np.arange(len(rows)), lengths)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well-mixed number for two."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def joined(words: np.ndarray, length: int) -> np.ndarray:
    """One number for every ``length`` consecutive words, that of the words from each place on."""
    last = len(words) - length + 1
    found = words[: max(0, last)]
    for i in range(1, length):
        found = mixed(found, words[i : i + last])
    return found


def grams(words: np.ndarray, docs: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """(place, context, shorter contexts) of each n-gram that lies in one document; ``place`` is that of its last word."""
    place = np.arange(order - 1, len(words))
    place = place[docs[place] == docs[place - order + 1]] if len(place) else place
    shorter = [joined(words, k)[place - k] for k in range(order - 2, 0, -1)]
    return place, joined(words, order - 1)[place - order + 1], np.array(shorter, np.int64).reshape(-1, len(place)).T


def frequent_of(order: int):
    """A function from documents to (k, g, word, n): the most frequent n-grams of each order, by their documents."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, words, docs in pieces(batches):
            for k in range(2, order + 1):
                place, context, _ = grams(words, docs, k)
                here = Counter((g, w) for g, w, _ in set(zip(context.tolist(), words[place].tolist(), docs[place].tolist())))
                for (g, w), n in here.most_common(4 * HOT):
                    seen[k, g, w] += n
        top = [(*key, n) for k in range(2, order + 1) for key, n in Counter({x: n for x, n in seen.items() if x[0] == k}).most_common(HOT)]
        yield pa.record_batch([pa.array([t[i] for t in top], pa.int64()) for i in range(4)], ["k", "g", "word", "n"])

    return frequent


def hot_grams(texts: DataFrame, order: int) -> dict[int, np.ndarray]:
    """For each order, the (context, word) that are frequent in a sample of the documents, picked by hash."""
    total = texts.count()
    part = min(1 << 40, (SAMPLE_DOCS << 40) // max(1, total))
    sample = texts.where(F.pmod(F.xxhash64("row", F.lit("lm")), F.lit(1 << 40)) < part).limit(4 * SAMPLE_DOCS).repartition(SAMPLE_TASKS)
    seen: Counter = Counter()
    for r in sample.mapInArrow(frequent_of(order), "k long, g long, word long, n long").collect():
        seen[r["k"], r["g"], r["word"]] += r["n"]
    hot = {}
    for k in range(2, order + 1):
        top = [(g, w) for (o, g, w), _ in sorted((x for x in seen.items() if x[0][0] == k), key=lambda x: (-x[1], x[0]))[:HOT]]
        found = np.array(top, np.int64).reshape(-1, 2)
        hot[k] = found[np.argsort(mixed(found[:, 0].copy(), found[:, 1].copy()), kind="stable")]
    return hot


def frequent_words(words: DataFrame, most: int = KNOWN_WORDS) -> DataFrame:
    """The words (word, count) whose count is at least some number, chosen so that there are ``most`` of them or fewer.

    The number comes from a histogram of the counts with sixteen steps to a doubling, so nothing is sorted.
    """
    step = F.floor(F.log2("count") * 16).cast("int")
    held, least = 0, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            least = r["step"] + 1
            break
    return words.where(step >= least)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return at, keys[at] == wanted


def among(hot: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams in the list of frequent ones, and which of them are there."""
    at, found = lookup(mixed(hot[:, 0].copy(), hot[:, 1].copy()), mixed(context, word))
    if len(hot):
        found &= (hot[at, 0] == context) & (hot[at, 1] == word)
    return at, found


def counter_of(hot, order: int):
    """A function from documents to (k, g, word, n): counts of words (k = 1), of the frequent n-grams, and of their contexts (-k)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, docs in pieces(batches):
            known, n = np.unique(words, return_counts=True)
            out = [(np.full(len(known), 1), np.zeros(len(known), np.int64), known, n)]
            for k in range(2, order + 1):
                chosen = hot.value[k]
                place, context, _ = grams(words, docs, k)
                at, found = among(chosen, context, words[place])
                every = grams(words, docs, k - 1)  # contexts count wherever they stand, also at the end of a document
                ends = words[every[0]] if k == 2 else mixed(every[1], words[every[0]])
                contexts = np.unique(chosen[:, 0])
                where, held = lookup(contexts, ends)
                out.append((np.full(len(chosen), k), chosen[:, 0], chosen[:, 1], np.bincount(at[found], minlength=len(chosen))))
                out.append((np.full(len(contexts), -k), contexts, np.zeros(len(contexts), np.int64), np.bincount(where[held], minlength=len(contexts))))
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["k", "g", "word", "n"])

    return count


def nested(kind: int, batch: int, bucket, context_count, gram_count, lengths, gs, totals, seconds, docs, ns, askeds=None, shorters=None) -> Iterator[pa.RecordBatch]:
    """Arrow rows of nested n-grams; ``lengths`` says how many each row has, counts below 0 are null."""
    names = [x.split()[0] for x in NESTED.split(", ")]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    listed = lambda x, t: pa.nulls(len(lengths), pa.list_(t)) if x is None else pa.ListArray.from_arrays(offsets, pa.array(np.asarray(x)).cast(t) if not isinstance(x, pa.Array) else x)
    null = lambda x: pa.array(np.asarray(x, np.int64), mask=np.asarray(x) < 0)
    if shorters is not None:
        width = shorters.shape[1]
        shorters = pa.ListArray.from_arrays(np.arange(len(shorters) + 1, dtype=np.int32) * width, pa.array(shorters.ravel()))
    columns = [
        pa.array(np.asarray(bucket), pa.int32()), pa.array(np.full(len(lengths), kind), pa.int32()), pa.array(np.full(len(lengths), batch), pa.int64()), null(context_count), null(gram_count),
        listed(gs, pa.int64()), listed(totals, pa.int32()), listed(seconds, pa.int64()), listed(docs, pa.int16()), listed(ns, pa.int32()), listed(askeds, pa.int32()), listed(shorters, pa.list_(pa.int64())),
    ]
    whole = pa.record_batch(columns, names)
    for at in range(0, len(lengths), 256):
        yield whole.slice(at, 256)


def stretches(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many there are."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.ones(n, bool)
    turn[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(turn)
    return at, np.diff(np.append(at, n))


def entries_of(model, k: int, order: int, buckets: int):
    """A function from documents to nested rows of their n-grams of order ``k``; at the last level, also of names and words alone.

    Documents must come sorted by their key: then a task that is run again numbers them alike.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, word_counts, hot, hot_counts, context_counts = model.value
        for turn, (rows, words, docs) in enumerate(pieces(batches)):
            batch = (TaskContext.get().partitionId() << 24) | turn
            first = np.flatnonzero(np.diff(docs, prepend=-1))
            none = np.zeros(max(len(rows), len(words)), np.int64)
            if k <= 2:
                alone = first if order > 1 else np.arange(len(words))
                length = np.bincount(docs, minlength=len(rows))  # the words of each document, where others have what is asked for
                yield from nested(NAMES, batch, [batch % buckets], [-1], [-1], [len(rows)], rows, None, rows, np.arange(len(rows)), none[: len(rows)], length)
                yield from nested(ALONE, batch, [batch % buckets], [-1], [-1], [len(alone)], words[alone], None, words[alone], docs[alone], none[: len(alone)], none[: len(alone)] + 1)
            if k < 2:
                continue
            known, number = np.unique(words, return_inverse=True)
            place, context, shorter = grams(words, docs, k)
            contexts, number_of = (known, number[place - 1]) if k == 2 else np.unique(context, return_inverse=True)
            word_bits, doc_bits = len(known).bit_length(), len(rows).bit_length()
            key = (number_of << (word_bits + doc_bits)) | (number[place] << doc_bits) | docs[place]
            by_key = np.argsort(key, kind="stable")
            at, n = stretches(key[by_key])
            source = by_key[at]
            c, second, d = number_of[source], words[place[source]], docs[place[source]]
            g, asked = contexts[c], None
            less = shorter[source] if k > 2 else None
            if k < order and len(at):
                begins = place[by_key] - (k - 1) == first[docs[place[by_key]]]  # no longer context stands before it
                asked = np.add.reduceat(begins.astype(np.int64), at)
            where, is_hot = among(hot[k], g, second)
            pick = lambda some, x: None if x is None else x[some]
            some = np.flatnonzero(is_hot)
            begin, lengths = stretches(where[some])
            if len(begin):
                head = where[some[begin]]
                yield from nested(
                    GRAMS, batch, (head + batch) % buckets, context_counts[k][head], hot_counts[k][head], lengths, g[some], None, second[some], d[some], n[some], pick(some, asked), pick(some, less)
                )
            if k == 2:
                at_word, frequent = lookup(hot_words, contexts)
                counted = np.where(frequent, word_counts[at_word] if len(word_counts) else 0, 0)
                total = np.bincount(number, minlength=len(known))
            else:
                frequent, every = np.zeros(len(contexts), bool), grams(words, docs, k - 1)
                ends, total = np.unique(mixed(every[1], words[every[0]]), return_counts=True)
            large = np.flatnonzero(~is_hot & frequent[c])
            if len(large):
                salt = second[large] % -(-counted[c[large]] // GROUP_ENTRIES)
                bucket = (g[large] % buckets + salt) % buckets
                large, bucket, cl = (x[np.lexsort((bucket, c[large]))] for x in (large, bucket, c[large]))
                begin, lengths = stretches(cl, bucket)
                yield from nested(GRAMS, batch, bucket[begin], counted[cl[begin]], np.full(len(begin), -1), lengths, g[large], None, second[large], d[large], n[large], pick(large, asked), pick(large, less))
            cold = np.flatnonzero(~is_hot & ~frequent[c])
            begin, _ = stretches(c[cold])
            totals = np.zeros(len(cold), np.int64)
            if k == 2:
                totals[begin] = total[c[cold[begin]]]
                lone_at = np.setdiff1d(np.flatnonzero(~frequent), c[cold[begin]])
                lone, lone_total = contexts[lone_at], total[lone_at]
            else:
                totals[begin] = total[np.searchsorted(ends, g[cold[begin]])]
                lone_at = np.flatnonzero(~np.isin(ends, g[cold[begin]]))
                lone, lone_total = ends[lone_at], total[lone_at]
            zeros = np.zeros(len(lone), np.int64)  # contexts without an n-gram of their own here are counted all the same
            with_lone = lambda x, y: np.concatenate((x[cold], y))
            gs, seconds, ds, ns = with_lone(g, lone), with_lone(second, zeros), with_lone(d, zeros), with_lone(n, zeros)
            totals = np.concatenate((totals, lone_total))
            asked = None if asked is None else with_lone(asked, zeros)
            less = None if less is None else np.concatenate((less[cold], np.zeros((len(lone), k - 2), np.int64)))
            by_bucket = np.argsort((gs % buckets).astype(np.int32), kind="stable")
            bucket = gs[by_bucket] % buckets
            begin, lengths = stretches(bucket)
            yield from nested(
                GRAMS, batch, bucket[begin], np.full(len(begin), -1), np.full(len(begin), -1), lengths,
                *(pick(by_bucket, x) for x in (gs, totals, seconds, ds, ns, asked, less)),
            )

    return entries


PARTS = "batch long, doc int, log double, word long, asked int, named boolean, shorter array<bigint>"
PARTS_TYPES = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
#: Sums that a task holds before it folds them by document.
SUMS = 1_000_000


class Entries:
    """The n-grams of some nested rows, one beside the other."""

    def __init__(self, table: pa.Table):
        lengths = pc.list_value_length(table.column("seconds").combine_chunks()).to_numpy()
        self.row = np.repeat(np.arange(table.num_rows), lengths)
        self.table = table
        self.second, self.g = self.listed("seconds"), self.listed("gs")
        self.doc, self.n = self.listed("docs").astype(np.int64), self.listed("ns").astype(np.int64)
        self.kind, self.bucket, self.batch = (self.repeated(c) for c in ("kind", "bucket", "batch"))
        self.asked, self.total = self.listed("askeds", self.n).astype(np.int64), self.listed("totals", np.zeros_like(self.n)).astype(np.int64)

    def repeated(self, name: str) -> np.ndarray:
        """A value of the rows for each of their n-grams; null is -1."""
        return self.table.column(name).fill_null(-1).to_numpy()[self.row]

    def listed(self, name: str, default: np.ndarray | None = None) -> np.ndarray:
        column = self.table.column(name).combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if default is None or not column.null_count:
            return flat
        out = default.copy()
        out[column.is_valid().to_numpy(zero_copy_only=False)[self.row]] = flat
        return out

    def shorter(self, some: np.ndarray) -> pa.Array:
        """The shorter contexts of some n-grams."""
        return self.table.column("shorters").combine_chunks().flatten().take(pa.array(some))


def counted(x: Entries) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram its count and that of its context: the count tables of these buckets, joined to the n-grams in them."""
    times, after = np.zeros(len(x.g), np.int64), np.zeros(len(x.g), np.int64)
    some = np.flatnonzero(x.kind == GRAMS)
    some = some[np.lexsort((x.second[some], x.g[some], x.bucket[some]))]
    for out, values, keys in ((times, x.n, (x.bucket, x.g, x.second)), (after, x.total, (x.bucket, x.g))):
        at, size = stretches(*[k[some] for k in keys])
        if len(at):
            out[some] = np.repeat(np.add.reduceat(values[some], at), size)
    for out, name in ((times, "gram_count"), (after, "context_count")):  # those that were counted beforehand
        known = x.repeated(name)
        out[known >= 0] = known[known >= 0]
    return times, after


def resolver(model, k: int, least_count: int, backoff: float, total: int):
    """A function from nested rows, sorted by bucket, to :data:`PARTS`.

    Rows without a word or shorter contexts are sums of a document; those with a word wait for the word's count, or give the
    document's key; those with shorter contexts go on to the next level.
    """
    names = [c.split()[0] for c in PARTS.split(", ")]

    def rows(batch, doc, log, word=None, asked=None, named=None, shorter=None) -> pa.RecordBatch:
        columns = [batch, doc, log, word, asked, named, shorter]
        return pa.record_batch([pa.nulls(len(batch), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, PARTS_TYPES)], names)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_count = model.value
        keys, logs, size = [], [], 0

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal size
            x = Entries(table)
            times, after = counted(x)
            plain = x.kind == GRAMS
            hit = plain & (times >= least_count)
            log = np.where(plain & ~hit, x.asked * np.log(backoff), 0.0)
            log[hit] = x.asked[hit] * (np.log(times[hit]) - np.log(after[hit]))
            done = hit & (x.asked > 0)
            wait = ~hit & (x.asked > 0) & (x.kind != NAMES)
            if k > 2:
                some = np.flatnonzero(wait)
                if len(some):
                    yield rows(x.batch[some], x.doc[some], log[some], x.second[some], x.asked[some], np.zeros(len(some), bool), x.shorter(some))
            else:
                at, found = lookup(known, x.second)
                found &= wait
                if found.any():
                    log[found] += x.asked[found] * (np.log(known_count[at[found]]) - np.log(total))
                done |= found
                some = np.flatnonzero(wait & ~found)
                yield rows(x.batch[some], x.doc[some], log[some], x.second[some], x.asked[some], np.zeros(len(some), bool))
                some = np.flatnonzero(x.kind == NAMES)
                yield rows(x.batch[some], x.doc[some], log[some], x.second[some], x.asked[some], np.ones(len(some), bool))
            keys.append((x.batch[done] << DOC_BITS) | x.doc[done])
            logs.append(log[done])
            size += len(keys[-1])
            if size >= SUMS:
                yield summed()

        def summed() -> pa.RecordBatch:
            nonlocal size
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(logs), minlength=len(key))
            keys.clear()
            logs.clear()
            size = 0
            return rows(key >> DOC_BITS, key & ((1 << DOC_BITS) - 1), sums)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("bucket")[0] != batch.column("bucket")[-1]:  # the last bucket may go on
                table = pa.Table.from_batches(held)
                cut_at = int(np.searchsorted(table.column("bucket").to_numpy(), batch.column("bucket")[-1].as_py()))
                yield from work(table.slice(0, cut_at))
                held = table.slice(cut_at).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))
        if size:
            yield summed()

    return resolve


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words, lm_score`` (mean natural logarithm of the words' scores).

    ``order`` is the length of the longest n-grams; n-grams of two words and more that occur less than ``least_count``
    times in the corpus are not in the count tables. (With 1 they all are, and a document's own n-grams are always found.)
    The first words of a document have shorter contexts, without a discount for that.

    * Null texts and texts without words: 0 words, null score. Texts are read whole; A-Z count as a-z.
    * Null and repeated ids are allowed; rows that repeat both id and text get the same score.
    * An empty table gives an empty result; input columns named like an output column are replaced.
    """
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    rows = without(docs, "n_words", "lm_score").withColumn("__row", F.xxhash64(F.col(id_col), F.col(text_col)))
    texts = rows.select(F.col("__row").alias("row"), F.col(text_col).alias("text"))
    hot = hot_grams(texts, order)
    counted = texts.mapInArrow(counter_of(context.broadcast(hot), order), "k long, g long, word long, n long")
    counts = cut(counted.groupBy("k", "g", "word").agg(F.sum("n").alias("n")))
    words = counts.where("k = 1").select("word", F.col("n").alias("count"))
    total = words.agg(F.sum("count")).first()[0] or 1
    known = cut(frequent_words(words))
    large = known.where(F.col("count") > GROUP_ENTRIES).orderBy("word").toArrow()
    listed = {(r["k"], r["g"], r["word"]): r["n"] for r in counts.where("k <> 1").collect()}  # the frequent n-grams and their contexts
    of = lambda k, sign: np.array([listed.get((sign * k, int(g), int(w) if sign > 0 else 0), 0) for g, w in hot[k]], np.int64)
    model = context.broadcast((
        large.column("word").to_numpy(), large.column("count").to_numpy(), hot, {k: of(k, 1) for k in hot}, {k: of(k, -1) for k in hot},
    ))
    partitions = int(min(MOST_PARTITIONS, max(16, -(-total // (BUCKET_ENTRIES * BUCKETS_A_PARTITION)))))
    buckets = partitions * BUCKETS_A_PARTITION
    sorted_texts = texts.where(F.col("text").isNotNull()).sortWithinPartitions("row")
    if order > 2:  # every level numbers the documents, and must find them in the same partitions
        sorted_texts = cut(sorted_texts)
    sorted_known = known.orderBy("word").toArrow()
    listed_words = context.broadcast((sorted_known.column("word").to_numpy(), sorted_known.column("count").to_numpy()))
    missed, levels = None, []
    for k in range(max(2, order), 1, -1):
        level = sorted_texts.mapInArrow(entries_of(model, min(k, order), order, buckets), NESTED)
        if missed is not None:
            level = level.unionByName(missed)
        dealt = level.repartition(partitions, "bucket").sortWithinPartitions("bucket")
        levels.append(cut(dealt.mapInArrow(resolver(listed_words, k, least_count, backoff, total), PARTS)))
        if k > 2:
            waiting = levels[-1].where("shorter is not null").withColumnRenamed("word", "second")
            missed = shorter_rows(waiting, known, spark, hot[k - 1], model.value[3][k - 1], model.value[4][k - 1], buckets)
            levels[-1] = levels[-1].withColumn("word", F.when(F.col("shorter").isNull(), F.col("word")))
    every = reduce(DataFrame.unionByName, levels)
    rare = every.where("word is not null and not named").join(words, "word").select(
        "batch", "doc", (F.col("log") + F.col("asked") * (F.ln("count") - F.lit(float(np.log(total))))).alias("log"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("length")
    )
    rest = every.where("word is null or named").select("batch", "doc", "log", F.col("word").alias("row"), F.when(F.col("named"), F.col("asked")).alias("length"))
    sums = rest.unionByName(rare).groupBy("batch", "doc").agg(F.sum("log").alias("log"), F.max("row").alias("row"), F.max("length").alias("length"))
    by_row = cut(sums.groupBy("row").agg(F.min("log").alias("log"), F.max("length").cast("long").alias("length")))
    for done in (*levels, counts, known, *([sorted_texts] if order > 2 else [])):
        drop_table(done)
    scored = rows.alias("d").join(by_row.alias("s"), F.col("d.__row") == F.col("s.row"), "left")
    kept = [c for c in rows.columns if c != "__row"]
    n_words = F.coalesce("s.length", F.lit(0).cast("long"))
    return scored.select(*[F.col(f"d.{c}") for c in kept], n_words.alias("n_words"), F.try_divide(F.col("s.log"), n_words).alias("lm_score"))


def shorter_rows(missed: DataFrame, known: DataFrame, spark, hot: np.ndarray, hot_counts: np.ndarray, context_counts: np.ndarray, buckets: int) -> DataFrame:
    """What is not in a count table, as rows of the next shorter context that are asked for and not counted."""
    listed = spark.createDataFrame(
        [(int(g), int(w), int(n), int(c)) for (g, w), n, c in zip(hot, hot_counts, context_counts)], "g long, second long, gram_count long, hot_context long"
    )
    large = known.where(F.col("count") > GROUP_ENTRIES).select(F.col("word").alias("g"), F.col("count").alias("large"))
    further = F.slice("shorter", 2, F.greatest(F.size("shorter") - 1, F.lit(0)))
    rows = missed.select("batch", "second", "doc", "asked", F.get("shorter", F.lit(0)).alias("g"), further.alias("further"))
    rows = rows.join(F.broadcast(listed), ["g", "second"], "left").join(F.broadcast(large), "g", "left")
    salt = F.when(F.col("gram_count").isNotNull(), F.pmod("batch", F.lit(buckets))).when(F.col("large").isNotNull(), F.pmod("second", F.ceil(F.col("large") / GROUP_ENTRIES))).otherwise(F.lit(0))
    return rows.select(
        F.pmod(F.pmod("g", F.lit(buckets)) + salt, F.lit(buckets)).cast("int").alias("bucket"), F.lit(GRAMS).alias("kind"), "batch", F.coalesce("hot_context", "large").alias("context_count"), "gram_count",
        F.array("g").alias("gs"), F.array(F.lit(0)).alias("totals"), F.array("second").alias("seconds"), F.array(F.col("doc").cast("smallint")).alias("docs"), F.array(F.lit(0)).alias("ns"),
        F.array("asked").alias("askeds"), F.array("further").alias("shorters"),
    )
