"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document's expected copies are its source's target over its
source's size; the copies are prefix-summed in a fixed order, shifted by one random offset, and a document is
taken once for every integer boundary that its own stretch of the sum crosses. No Python runs on executors.

The prefix sum is distributed: rows are ordered by (size band, salt, size, id) within their source, so a
source, however large, is spread over ``bands x SALTS`` buckets. Counts of buckets are summed first (a small
table), rows are numbered only inside their bucket. Ordering by size keeps the taken words near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.shared import cut, without

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
#: Buckets that each size band of a source is dealt over: two hexadecimal digits of an MD5.
SALTS = 256
#: Expected copies are held as whole multiples of one over this, so prefix sums are exact.
UNIT = 1 << 24


def word_count(text: Column) -> Column:
    """Number of maximal stretches without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def size_band(size: Column) -> Column:
    """Rises with ``size``: bit length and leading four bits, so sizes within a band differ by an eighth at most."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """Target words of each source: ``share`` of all words dealt by weight, no target above ``max_repeat`` sizes.

    ``sizes`` has one row for each source: __source_key, __source, source_size. Sources in code point order
    (null last) take the weights in turn. The excess over a cap is dealt again by weight until no target is
    above its cap; that is the water level below, which is the largest of the levels found on the way.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    capped = (
        sizes.withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("__weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = capped.withColumn("__level", (F.col("__total") - before) / onward)
    return level.select(
        "__source_key",
        "source_size",
        F.least(F.col("__cap"), F.col("__weight") * F.max("__level").over(everything)).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_repeat: float = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies, taken`` (taken = copies x size, in words).

    * Null text has size 0; null and empty texts can be given copies, they take no words.
    * Null source is a source of its own, the last; null ids are ordered first among equal sizes.
    * Repeated rows and ties are separate rows; which of two equal rows is taken makes no difference.
    * A source without words has target 0 and no copies; an empty table gives an empty result.
    * Input columns named like an output column are replaced.
    """
    words = without(docs, "size", "source_size", "target", "copies", "taken")
    digest = F.md5(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    )
    words = (
        words.withColumn("size", word_count(F.col(text_col)))
        .withColumn("__source_key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
        .withColumn("__band", size_band(F.col("size")))
        .withColumn("__salt", F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"))
    )
    place = ["__source_key", "__band", "__salt"]
    buckets = cut(
        words.groupBy(*place).agg(
            F.first(source_col).alias("__source"), F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words")
        )
    )
    sources = buckets.groupBy("__source_key").agg(
        F.first("__source").alias("__source"), F.sum("__words").alias("source_size")
    )
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = (
        buckets.groupBy("__source_key", "__band")
        .agg(F.sum("__n").alias("__n"))
        .select("__source_key", "__band", before(Window.partitionBy("__source_key").orderBy("__band")).alias("__band_start"))
    )
    starts = (
        buckets.withColumn("__salt_start", before(Window.partitionBy("__source_key", "__band").orderBy("__salt")))
        .join(bands, ["__source_key", "__band"])
        .join(targets(sources, weights, share, max_repeat), "__source_key")
        .select(*place, (F.col("__band_start") + F.col("__salt_start")).alias("__start"), "source_size", "target")
    )
    expected = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))
    ).otherwise(F.lit(0)).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source_key"))), 1, 6), 16, 10).cast("long")
    in_bucket = Window.partitionBy(*place).orderBy("size", F.col(id_col).asc_nulls_first())
    upto = F.col("__start") + F.row_number().over(in_bucket)
    crossed = lambda rank: F.call_function("shiftright", F.col("__each") * rank + F.col("__offset"), F.lit(24))
    return (
        words.join(starts, place)
        .withColumn("__each", expected)
        .withColumn("__offset", offset)
        .withColumn("__rank", upto)
        .withColumn("copies", (crossed(F.col("__rank")) - crossed(F.col("__rank") - 1)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*place, "__start", "__each", "__offset", "__rank")
    )


def mixed_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as :func:`mix` takes it, with the columns of ``docs`` alone."""
    own = {c: f"__{i}_{c}" for i, c in enumerate(docs.columns)}
    taken = mix(
        docs.withColumnsRenamed(own), id_col=own[id_col], text_col=own[text_col], source_col=own[source_col], **options
    )
    often = taken.select(*own.values(), F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("__one"))
    return often.select(*[F.col(new).alias(old) for old, new in own.items()])
