"""Language ID by compression: the language whose dictionary shortens a text the most.

For every language a raw-content zstandard dictionary is made from a bounded sample of its labelled texts.
A text is normalised, encoded whole with each dictionary, block by block, and gets the language with the fewest
bytes; a narrow margin to the runner-up marks it rejected. Dictionaries are small and go to the workers by broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmline.llm.workers import once, share
from ohmline.shared import ship, without

ship(__name__)

UNKNOWN = "und"
#: Bounds of the training sample: documents of a language, and characters of a document, taken from a place in it that a
#: hash picks. Many short pieces keep a mislabelled document, whose copies it would attract, from taking up much of a dictionary.
SAMPLE_DOCS = 800
SAMPLE_CHARS = 140
#: Bytes of a dictionary, and of all of them together: they get smaller if there are very many languages.
DICTIONARY_BYTES, ALL_BYTES = 112_000, 112_000_000
#: A text is rejected if the runner-up needs less than this share of bytes more than the best language.
MARGIN = 0.01
#: Level of all encodings, and of a second one, whose sizes count, of texts for which the first leaves a narrow margin.
LEVEL, CLOSER_LEVEL = 5, 12
#: Longer texts are encoded in equal blocks of at most so many normalised bytes, each with the dictionary anew: a dictionary
#: saves a bounded number of bytes of one frame, so the margin of a single frame would shrink with the text's length.
BLOCK_BYTES = 16_384
NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-case words of letters, single spaces between and around them."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of each language, from at most about ``SAMPLE_DOCS`` distinct texts of it, picked by hash."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(text_col), F.lit(1 << 40)).alias("h")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    shares = [(lang, min(1 << 40, (SAMPLE_DOCS << 40) // n)) for lang, n in counts.items()]
    below = docs.sparkSession.createDataFrame(shares, "lang string, below long")
    begins = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    sample = (
        known.join(F.broadcast(below), "lang")
        .where("h < below")
        .groupBy("lang", "h")
        .agg(F.min(F.substring("text", begins, F.lit(SAMPLE_CHARS))).alias("text"))
        .collect()
    )
    parts: dict[str, list[str]] = {lang: [] for lang in counts}
    for row in sorted(sample, key=lambda r: r["h"]):
        parts[row["lang"]].append(normalise(row["text"]))
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(parts))
    return {lang: "".join(x).encode()[:size] for lang, x in sorted(parts.items())}


def encoder(content: bytes, level: int):
    """A function from bytes to their compressed length with ``content`` as the dictionary."""
    shared = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_dict_id=False).compress
    return lambda data: len(compress(data))


def blockwise(length):
    """A function from bytes to the sum of ``length`` over their blocks, which cover all of them."""

    def total(data: bytes) -> int:
        n = max(1, -(-len(data) // BLOCK_BYTES))
        step = max(1, -(-len(data) // n))
        return length(data) if n == 1 else sum(length(data[i : i + step]) for i in range(0, len(data), step))

    return total


def verdict(sizes: np.ndarray, margin: float) -> tuple[int, bool]:
    """The least of the sizes, the first of equals, and whether another is within the margin."""
    best = int(sizes.argmin())
    rest = np.delete(sizes, best)
    return best, bool(len(rest)) and bool(rest.min() - sizes[best] < margin * max(1.0, sizes[best]))


PREDICTED = "struct<lang:string,score:double,rejected:boolean>"


def predictor(dictionaries, margin: float):
    """An Arrow UDF from text to the language, its score and whether it is rejected."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, lengths = once(dictionaries, lambda known: (list(known), {level: [blockwise(encoder(x, level)) for x in known.values()] for level in (LEVEL, CLOSER_LEVEL)}))
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        for texts in batches:
            out = []
            for text in texts:
                plain = normalise(text.as_py()) if text.is_valid else ""
                if not langs or not any(map(str.isalpha, plain)):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                data = plain.encode()
                for level in (LEVEL, CLOSER_LEVEL):
                    sizes = np.array([f(data) for f in lengths[level]], float)
                    best, narrow = verdict(sizes, margin)
                    if not narrow:
                        break
                out.append((langs[best], float(1 / np.exp(-(sizes - sizes[best])).sum()), narrow))
            yield pa.StructArray.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out) if out else ([], [], []), kind)], fields=list(kind))

    return F.arrow_udf(predict, PREDICTED)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred, score, rejected``.

    * Null texts and texts without a letter: ``und``, score 0, rejected; so is all if nothing was learned.
    * All of a text is encoded, however long, and its length does not narrow the margin; equal texts get equal results; ties go to the first language by name.
    * An empty table gives an empty result; input columns named like an output column are replaced.
    """
    rows = without(docs, "lang_pred", "score", "rejected")
    shared = share(docs.sparkSession.sparkContext, dictionaries)
    found = rows.withColumn("__lang", predictor(shared, margin)(F.col(text_col)))
    return found.select(
        *rows.columns,
        F.col("__lang.lang").alias("lang_pred"),
        F.col("__lang.score").alias("score"),
        F.col("__lang.rejected").alias("rejected"),
    )


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % modulus
