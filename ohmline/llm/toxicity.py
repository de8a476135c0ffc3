"""Toxicity with noisy-channel deobfuscation.

A disguised word (leetspeak, symbols or spaces between letters, repeated letters) is a path through a lattice:
each character may stand for itself, for the letters it imitates, or for nothing, each at a channel cost. The
Viterbi path under a character trigram model restores the word. Words without a trace of disguise have a
lattice of one path and are taken as they are. The restored text is then scored by a logistic model on word
beginnings and whole words, so inflected forms of a stem count alike. White space between single letters is part
of the lattice: it means nothing or the border of two words.

Both models are fitted by Spark from all labelled documents, near copies but for one left out, and broadcast: the trigrams of all
their words, and the weights of the marks of toxicity. The logistic model is fitted on rows of equal marks, with their number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import cut, drop_table, ship, without

ship(__name__)

#: Features kept at most, the least share of toxic documents that a feature is in, its least log odds, and these times
#: the root of the number of its documents: only marks of toxicity are kept, so long clean texts don't add up weak ones.
FEATURES = 2_000
LEAST = 0.02
LEAST_ODDS, LEAST_EVIDENCE = 3.0, 10.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Entries that a task counts before it hands them on; the ridge and the most steps of the logistic model.
COUNTED = 500_000
RIDGE, STEPS = 1e-5, 100
#: Letters that a character may stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i", "£": "l", "¥": "y",
}
#: Natural logarithms of the channel: a sign means its letter, a sign with such a letter means nothing, another
#: sign means nothing, a letter is a repeat of the last.
LEET_COST, LEET_SKIP_COST, SKIP_COST, REPEAT_COST = -0.3, -8.0, -0.1, -0.5
#: Signs stripped from the ends of a token, and those of them that may be a letter at an end.
EDGES = ".,;:!?\"'()[]{}«»…“”’*#%&$_-~`^|/\\<>+=@€£"
END_SIGNS = "$@€£"
THRICE, TWICE = re.compile(r"(.)\1\1"), re.compile(r"(.)\1+")
HYPHENATED = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
#: Tokens of one letter in a row from which on they are also read as one word.
SPACED = 4
MARK = "\x02"


def log_model(words: Iterable[str]) -> dict[str, float]:
    """Character trigram log probabilities (add-a-tenth), of words between marks; other trigrams share one floor."""
    three = Counter()
    for word, n in Counter(words).items():
        line = f"{MARK}{MARK}{word}{MARK}"
        for i in range(len(line) - 2):
            three[line[i : i + 3]] += n**0.75
    return trigram_model(three)


def trigram_model(three: dict[str, float]) -> dict[str, float]:
    """The log probabilities of weighed trigrams."""
    two, letters = Counter(), set()
    for t, n in three.items():
        two[t[:2]] += n
        letters.update(t)
    room = 0.1 * (len(letters - {MARK}) + 1)
    model = {t: math.log((n + 0.1) / (two[t[:2]] + room)) for t, n in three.items()}
    model[""] = math.log(0.1 / room) - 2.0
    return model


def restore(token: str, model: dict[str, float]) -> str:
    """The most likely word behind ``token``: Viterbi over its lattice, states are the last two letters.

    A space in ``token`` means nothing or a border; the words found are then parted by single spaces.
    """
    floor = model[""]
    paths = {(MARK, MARK): (0.0, None)}
    last = ""
    for c in token:
        if c == " ":
            ends = [(score + model.get(a + b + MARK, floor), (word, " ")) for (a, b), (score, word) in paths.items() if b != MARK]
            if ends:
                best = max(ends, key=lambda x: x[0])
                if (MARK, MARK) not in paths or best[0] > paths[MARK, MARK][0]:
                    paths[MARK, MARK] = best
            continue
        letters = LEET.get(c, "")
        options = [(x, LEET_COST) for x in letters]
        options.append((c, 0.0) if c.isalpha() else ("", LEET_SKIP_COST if letters else SKIP_COST))
        if c == last and c.isalpha():
            options.append(("", REPEAT_COST))
        last = c
        ahead: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (score, word) in paths.items():
            for letter, cost in options:
                state, new, text = ((b, letter), score + cost + model.get(a + b + letter, floor), (word, letter)) if letter else ((a, b), score + cost, word)
                if state not in ahead or new > ahead[state][0]:
                    ahead[state] = (new, text)
        paths = ahead
    return max((score + (0.0 if word and word[1] == " " else model.get(a + b + MARK, floor)), spelt(word)) for (a, b), (score, word) in paths.items())[1]


def spelt(path) -> str:
    """The text of a path, which is kept as (path so far, letter)."""
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


class Learned:
    """Words that a word with doubled letters may stand for, and what they are without any repeats."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = set(words)
        self.single = {TWICE.sub(r"\1", w) for w in self.words}

    def may_be(self, word: str) -> bool:
        return TWICE.sub(r"\1", word) in self.single


NONE_LEARNED = Learned()


def letters_of(word: str, model: dict[str, float], learned: Learned) -> list[str]:
    """The readings of a word of letters only: letters three times in a row are a disguise, those twice in a row may be.

    Of the latter the word itself stays, and what it is without the repeats comes beside it if that is a learned word.
    """
    if THRICE.search(word) is not None:
        return [restore(word, model)]
    if TWICE.search(word) is None or not learned.may_be(word):
        return [word]
    plain = restore(word, model)
    return [word, plain] if plain != word and plain in learned.words else [word]


def readings(token: str, model: dict[str, float], learned: Learned = NONE_LEARNED) -> list[str]:
    """The words that a token without white space holds, restored if it shows a trace of disguise.

    A disguised token is read as one word, and once more as several, with a possible border at any sign, however long it is.
    """
    if token.isalpha():
        return letters_of(token, model, learned)
    core = token.strip(EDGES)
    if not core:
        return restore(token, model).split() if any(map(LEET.__contains__, token)) else []
    at = token.index(core)
    head, tail = token[:at], token[at + len(core) :]
    signs = head[-1:] in END_SIGNS and head[-1:] and head[-2:-1] != head[-1:]
    if signs:
        core = head[-1] + core
    if tail[:1] and tail[0] in END_SIGNS and len(tail) - len(tail.lstrip(tail[0])) < 3:
        core += tail[: len(tail) - len(tail.lstrip(tail[0]))]
    if core.isalpha():
        return letters_of(core, model, learned)
    if HYPHENATED.fullmatch(core):
        return LETTERS.findall(core)
    return [restore(core, model), *restore(NO_LETTER.sub(r" \g<0> ", core), model).split(), *LETTERS.findall(core)]


def runs(tokens: list[str]) -> Iterator[list[str]]:
    """The letters of each row of two or more tokens that are one character, but for signs at their ends."""
    run = []
    for t in tokens:
        if len(t) == 1:
            run.append(t)
        elif not t.isalpha() and len(core := t.strip(EDGES)) == 1:
            run.append(core)
        elif run:
            if len(run) > 1:
                yield run
            run = []
    if len(run) > 1:
        yield run


def spaced(tokens: list[str], model: dict[str, float]) -> Iterator[str]:
    """The words spelt out by tokens of one letter in a row: parted as is most likely, long rows also as one word."""
    for run in runs(tokens):
        yield from restore(" ".join(run), model).split()
        if len(run) >= SPACED:
            yield "".join(run)


def features(words: Iterable[str]) -> set[str]:
    found = {f"={w}" for w in words}
    for w in words:
        found.update(w[:n] for n in PREFIXES if len(w) > n)
    return found


class Reader:
    """The features of a text; those of a token are kept, up to a bound of tokens and of their length."""

    def __init__(self, model: dict[str, float], wanted=None, learned: Learned = NONE_LEARNED, room: int = 250_000, longest: int = 200):
        self.model, self.wanted, self.learned, self.room, self.longest, self.known = model, wanted, learned, room, longest, {}

    def token(self, token: str) -> tuple[str, ...]:
        if len(self.known) >= self.room:
            self.known.clear()
        found = features([w for w in readings(token, self.model, self.learned) if w])
        found = tuple(found if self.wanted is None else found & self.wanted)
        if len(token) <= self.longest:
            self.known[token] = found
        return found

    def features(self, text: str) -> set[str]:
        tokens = text.lower().split()
        known, found = self.known.get, set()
        for t in {*tokens, *spaced(tokens, self.model)}:
            has = known(t)
            if has is None:
                has = self.token(t)
            if has:
                found.update(has)
        return found


def shingle_marks(text: str) -> tuple[int, int]:
    """The least and the greatest hash of the five-word shingles, of which near copies share one."""
    words = text.lower().split()
    hashes = [zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
    return min(hashes), max(hashes)


def lone(tokens: list[str]) -> list[str]:
    """Words of one letter, which are not among others of one letter, as those of a spelt-out word are."""
    return [b for a, b, c in zip(["  ", *tokens], tokens, [*tokens[1:], "  "]) if len(b) == 1 and b.isalpha() and len(a) > 1 and len(c) > 1]


def counted(rows: DataFrame, entries: Callable[[str], Iterable[str]]) -> DataFrame:
    """(key, n): how often ``entries`` gives a key over the texts; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(entries(text.as_py()))
                if len(found) > COUNTED:
                    yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "n"])
                    found.clear()
        yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "n"])

    return rows.select("text").mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]{2,}", text.lower()) + lone(text.lower().split())


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label) of all labelled documents, but of near copies only that of the least id, written once."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label")
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(marked.where("label in (0, 1)"), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    marks = F.arrow_udf(lambda column: pa.StructArray.from_arrays(list(map(pa.array, zip(*map(shingle_marks, column.to_pylist())))) if len(column) else [pa.array([], pa.int64())] * 2, ["least", "greatest"]), "struct<least:long,greatest:long>")
    every = cut(found.withColumn("m", marks("text")).select("id", "label", "text", "m.least", "m.greatest"))
    ids = every.select("id", "least", "greatest")
    for name in ("least", "greatest"):
        ids = ids.join(every.groupBy(name).agg(F.min("id").alias(f"first_{name}")), name)
    firsts = ids.where("id = first_least and id = first_greatest").select("id")
    kept = cut(every.join(firsts, "id", "left_semi").select("id", "text", "label"))
    drop_table(every)
    return kept


def trigrams(words: DataFrame) -> dict[str, float]:
    """The trigram model of counted words (key, n). What comes to the driver is the model: the trigrams that there are."""
    line = F.concat(F.lit(MARK * 2), "key", F.lit(MARK))
    weight = F.round(F.pow(F.col("n"), F.lit(0.75)) * 65536).cast("long")  # whole numbers, so sums don't depend on their order
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(line, i, F.lit(3)))).alias("t"), weight.alias("w"))
    return trigram_model({r["t"]: r["w"] / 65536 for r in each.groupBy("t").agg(F.sum("w").alias("w")).collect()})


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Character model and logistic weights from all labelled documents. An id with several labels counts as toxic if one of them says so.

    A feature counts if it is in ``LEAST`` of the toxic documents, so few do, however many documents there are. Words with
    doubled letters are read as the words that are in a quarter of that.
    """
    context = docs.sparkSession.sparkContext
    kept = labelled(docs, labels, id_col, text_col, label_col)
    n = {r["label"]: r["n"] for r in kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    toxic, clean = kept.where("label = 1"), kept.where("label = 0")
    often = counted(toxic, words_of).withColumn("n", F.col("n") * (n0 / n1 if n0 and n1 else 1.0))  # so both labels weigh alike
    model = trigrams(often.unionByName(counted(clean, words_of)).groupBy("key").agg(F.sum("n").alias("n")))
    if not n1 or not n0:
        return {"model": model, "bias": 4.0 if n1 else -4.0, "weights": {}}

    def reader(wanted=None, learned=()) -> Callable[[str], set[str]]:
        known = share(context, (model, wanted, learned))
        return lambda text: once(known, lambda x: Reader(x[0], x[1], Learned(x[2]))).features(text)

    common = counted(toxic, reader()).where(F.col("n") >= LEAST * n1 / 4).where("key like '=%'").collect()
    learned = sorted(r["key"][1:] for r in common)
    wanted = sorted(r["key"] for r in counted(toxic, reader(None, learned)).where(F.col("n") >= max(2, LEAST * n1)).select("key").collect())
    found = reader(frozenset(wanted), learned)
    listed = F.arrow_udf(lambda column: pa.array([sorted(found(x)) for x in column.to_pylist()], pa.list_(pa.string())), "array<string>")
    marks = cut(kept.withColumn("f", listed("text")).groupBy("label", "f").agg(F.count(F.lit(1)).alias("n")))
    drop_table(kept)
    counts = marks.select("label", "n", F.explode("f").alias("key")).groupBy("key").agg(F.sum("n").alias("seen"), F.sum(F.col("n") * F.col("label")).alias("toxic"))
    gain = {}
    for r in counts.collect():
        odds = math.log((r["toxic"] + 0.5) / (n1 + 1)) - math.log((r["seen"] - r["toxic"] + 0.5) / (n0 + 1))
        if odds >= LEAST_ODDS and odds * math.sqrt(r["seen"]) >= LEAST_EVIDENCE:
            gain[r["key"]] = odds * math.sqrt(r["seen"])
    gain = sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES]
    weights, bias = logistic(marks, gain, n1, n0)
    return {"model": model, "bias": bias, "weights": {f: float(w) for f, w in zip(gain, weights) if abs(w) > 1e-3}}


def logistic(marks: DataFrame, gain: list[str], n1: int, n0: int) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on the features ``gain`` of rows (label, f, n), classes weighed alike."""
    if not gain:
        return np.zeros(0), -4.0
    place = {f: i for i, f in enumerate(gain)}
    vector = F.udf(lambda f: Vectors.sparse(len(place), sorted((place[x], 1.0) for x in f if x in place)), VectorUDT())
    each = F.col("n") * F.when(F.col("label") == 1, 0.5 / n1).otherwise(0.5 / n0)
    rows = cut(marks.select(F.col("label").cast("double").alias("label"), vector("f").alias("features"), each.alias("weight")))
    regression = LogisticRegression(weightCol="weight", regParam=RIDGE, maxIter=STEPS, standardization=False)
    fitted = regression.fit(rows)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def scorer(fitted):
    """An Arrow UDF from text to the probability of the label."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, weights, bias = once(fitted, lambda x: (Reader(x["model"], x["weights"].keys(), Learned(f[1:] for f in x["weights"] if f[0] == "=")), x["weights"], x["bias"]))
        for texts in batches:
            out = []
            for text in texts:
                found = reader.features(text.as_py()) if text.is_valid else ()
                total = bias + math.fsum(weights[f] for f in found)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
            yield pa.array(out, pa.float64())

    return F.arrow_udf(scores, "double")


def score(docs: DataFrame, fitted: dict, *, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    * Null and empty texts get the score of a text without features; long texts are scored whole.
    * Equal texts get equal scores; an empty table gives an empty result.
    * Input columns named like an output column are replaced.
    """
    rows = without(docs, "score", "predicted")
    shared = share(docs.sparkSession.sparkContext, fitted)
    return rows.withColumn("score", scorer(shared)(F.col(text_col))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
