"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a score from the hash of (key, shard); the record goes to the shard with the highest score.
A new shard only takes the records on which its score is the highest, so no record moves between old shards.
No Python runs on executors. Slots are numbered with a two-level count: rows are numbered inside small
buckets of a shard, and the buckets' counts (a small table) are prefix-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.shared import cut, without

SHARDS = 16
#: Hexadecimal digits of an MD5 that name the bucket of a row inside its shard: 4,096 buckets.
BUCKET_DIGITS = 3


def score(key: Column, shard: int, weight: float) -> Column:
    """Weighted rendezvous score: weight over the exponential variate of a 52-bit hash in (0, 1)."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10)
    unit = (digits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(float(weight)) / -F.ln(unit)


def choose(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, low) of the best shard; ``low`` is minus the shard's number, so ties go to the lower number."""
    return F.array_max(F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("low")) for i, w in enumerate(weights) if w > 0]))


def shard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
) -> DataFrame:
    """All rows of ``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text plus 1, ``slot`` counts from 0 without gaps in each shard,
    ``grown_shard`` is the shard if one more, of ``grown_weight``, is added.

    * Null text: size 1, text_crc32 null. Null ids share one key (the empty string) and so one shard.
    * Repeated ids go to the same shard with a slot each; ties in the slot order are equal rows.
    * A shard of weight 0 gets nothing; an empty table gives an empty result.
    * Input columns named like an output column are replaced.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat(key, F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    placed = (
        without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        .withColumn("size", (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(F.encode(F.col(text_col), "UTF-8")))
        .withColumn("law", F.lit("key"))
        .withColumn("__best", choose(key, weights))
        .withColumn("shard", -F.col("__best.low"))
        .withColumn(
            "grown_shard",
            F.when(score(key, len(weights), grown_weight) > F.col("__best.score"), F.lit(len(weights))).otherwise(F.col("shard")),
        )
        .withColumn("__bucket", F.substring(digest, 1, BUCKET_DIGITS))
        .drop("__best")
    )
    counts = cut(placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    earlier = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(F.col(id_col).asc_nulls_first(), "size", F.col("text_crc32").asc_nulls_first())
    numbered = placed.join(starts, ["shard", "__bucket"]).withColumn("slot", F.col("__start") + F.row_number().over(inside) - 1)
    kept = [c for c in placed.columns if c not in ("__bucket", "grown_shard")]
    return numbered.select(*kept, "slot", "grown_shard")
