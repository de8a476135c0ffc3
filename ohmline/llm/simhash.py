"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is cut into a ring of eight segments. If two fingerprints differ in three bits at most,
then some chain of segments has, for each of its prefixes of length n, at most 3n/8 differing bits: its first
two segments are equal, and the next three differ in one bit at most, so two of them are equal as well. A
fingerprint therefore has 24 keys of 32 bits (eight starts, three choices of two out of three), and linked
fingerprints share one. Candidates must pass the chain's budgets before the full Hamming check.

Under a key that very many fingerprints share, no pairs are made: each sends itself with up to two of the other 32 bits
flipped. Two are linked exactly if some value is at most one flip from one and at most two from the other, so those
who meet at a value are tied to the least of them that is one flip away, if there is one. Every tie is a link.

Copies are folded into distinct fingerprints before anything is joined, and links are joined, checked and
made into components as tables; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmline.llm.components import roots
from ohmline.shared import cut, ship

ship(__name__)

SHINGLE = 3
SEED = 42
BITS = 3
SEGMENTS, WIDTH = 8, 8
#: Fingerprints that may share a key before they are tied by flips in place of pairs. Pairs grow with the square and are made by
#: one task, flips are 529 rows a fingerprint and spread: measured, they take the same time at about this many.
CROWD = 1_500
#: Words that are hashed at a time, to bound the memory for very long texts.
PIECE = 50_000
#: A-Z to a-z, other bytes as they are.
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def set_counts(data: bytes, width: int, seed: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the word shingles of ``data``, and how many shingles there are."""
    words = data.translate(TO_LOWER).split()
    counts, n = np.zeros(64, np.int64), max(len(words) - width + 1, 1 if words else 0)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        line = b" ".join(words[at : at + PIECE + width - 1])
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.append(gaps, len(line))
        if len(starts) > width:
            starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts, n


def fingerprinter(width: int, seed: int):
    """An Arrow UDF from text to its fingerprint, as a signed 64-bit integer."""

    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts), "<u8")
            for i, text in enumerate(texts):
                if text.is_valid:
                    counts, n = set_counts(text.as_buffer().to_pybytes(), width, seed)
                    out[i : i + 1] = np.packbits(counts * 2 > n, bitorder="little").view("<u8")
            yield pa.array(out.view("<i8"))

    return F.arrow_udf(fingerprint, "long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def chain_mask(start: int, length: int) -> int:
    """Bits of ``length`` segments of the ring from ``start`` on."""
    return sum(((1 << WIDTH) - 1) << (WIDTH * ((start + i) % SEGMENTS)) for i in range(length))


def ring_keys() -> list[tuple[int, int]]:
    """(start, mask of the four segments that must be equal) for each of the 24 keys."""
    segment = lambda i: chain_mask(i, 1)
    return [
        (s, chain_mask(s, 2) | segment(s + a) | segment(s + b)) for s in range(SEGMENTS) for a, b in ((2, 3), (2, 4), (3, 4))
    ]


def within(differing: Column, start: int, bits: int = BITS) -> Column:
    """Whether each prefix of the chain from ``start`` keeps its budget of ``bits`` times its share of the ring."""
    budgets = [F.bit_count(differing.bitwiseAND(F.lit(signed(chain_mask(start, n))))) <= bits * n // SEGMENTS for n in range(1, SEGMENTS)]
    kept = budgets[0]
    for one in budgets[1:]:
        kept = kept & one
    return kept


def flips(spark: SparkSession) -> DataFrame:
    """(k, flip, one): up to two of the 32 bits that are not in a key; ``one`` if it is one bit or none."""
    rows = []
    for k, (_, mask) in enumerate(ring_keys()):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        rows += [(k, signed(a | b), a == b) for i, a in enumerate(free) for b in free[i:]] + [(k, 0, True)]
    return spark.createDataFrame(rows, "k int, flip long, one boolean")


def crowded(keys: DataFrame) -> DataFrame:
    """Ties (high, low) among the fingerprints of each key of ``keys``: links that leave the same components as all links."""
    flipped = keys.join(F.broadcast(flips(keys.sparkSession)), "k").withColumn("value", F.col("fp").bitwiseXOR(F.col("flip")))
    met = flipped.groupBy("k", "part", "value").agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("least"), F.collect_set("fp").alias("met"))  # 529 at most
    tied = met.where(F.col("least").isNotNull() & (F.size("met") > 1)).select("least", F.explode("met").alias("fp")).where("fp <> least")
    return tied.select(F.greatest("fp", "least").alias("high"), F.least("fp", "least").alias("low"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (high, low) of distinct fingerprints of ``prints`` (column ``fp``) that differ in three bits at most.

    Under a key with more than ``crowd`` fingerprints they are not all such pairs, but enough for the same components.
    """
    every = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(mask))) for _, mask in ring_keys()])).alias("k", "part"),
    )
    full = cut(every.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("k", "part"))
    some = not full.isEmpty()
    keys = (every.join(full, ["k", "part"], "left_anti") if some else every).withColumn("start", F.floor(F.col("k") / 3).cast("int"))
    high, low = keys.alias("high"), keys.select("fp", "k", "part").alias("low")
    differing = F.col("high.fp").bitwiseXOR(F.col("low.fp"))
    chain = F.lit(False)
    for s in range(SEGMENTS):
        chain = F.when(F.col("high.start") == s, within(differing, s)).otherwise(chain)
    found = high.join(
        low,
        (F.col("high.k") == F.col("low.k"))
        & (F.col("high.part") == F.col("low.part"))
        & (F.col("high.fp") > F.col("low.fp"))
        & (F.bit_count(differing) <= BITS)  # one instruction, so it comes before the budgets that name the pair's start
        & chain,
    ).select(F.col("high.fp").alias("high"), F.col("low.fp").alias("low"))
    if some:
        found = found.unionByName(crowded(every.join(full, ["k", "part"], "left_semi")))
    return found.distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root) of each distinct fingerprint of ``prints``; ``root`` is the least fingerprint of its component."""
    distinct = prints.select("fp").distinct()
    stars = roots(links(distinct))
    return distinct.join(stars.withColumnRenamed("high", "fp"), "fp", "left").select("fp", F.coalesce("low", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each of ``docs``: its id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    * Null texts and texts without words have fingerprint zero, and link like any other.
    * A text of fewer words than the shingle is one shingle; texts are hashed whole, however long.
    * Repeated rows stay, each with the same result; ids may be null, ``component_id`` is null if all of its are.
    * An empty table gives an empty result; other columns are not carried.
    """
    prints = cut(docs.select(F.col(id_col).alias("__id"), fingerprinter(shingle, seed)(F.col(text_col)).alias("fp")))
    found = groups(prints)
    least = prints.groupBy("fp").agg(F.min("__id").alias("least")).join(found, "fp")
    component = cut(least.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = found.join(component, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, and of its texts that of the least hash.

    A null id is kept only where a component has no other. Rows that repeat both id and text count once.
    """
    own = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    row = docs.withColumnsRenamed(own)
    id_, text = F.col(own[id_col]), F.col(own[text_col])
    row = row.withColumn("__id", F.coalesce(id_.cast("string"), F.lit(""))).withColumn("__text", F.xxhash64(text, F.length(text)))
    prints = cut(row.select("__id", "__text", id_.alias("id"), fingerprinter(shingle, seed)(text).alias("fp")))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "__text")).alias("first"))  # folds copies before the join
    kept = (
        first.join(groups(prints), "fp")
        .groupBy("root")
        .agg(F.min("first").alias("kept"))
        .select(F.coalesce(F.col("kept.id").cast("string"), F.lit("")).alias("__id"), F.col("kept.__text").alias("__text"))
        .distinct()
    )
    once = Window.partitionBy("__id", "__text").orderBy(F.xxhash64(*own.values()))
    rows = row.withColumn("__n", F.row_number().over(once)).where("__n = 1").join(kept, ["__id", "__text"], "left_semi")
    return rows.select(*[F.col(new).alias(old) for old, new in own.items()])
