"""Log analytics: node-hour buckets, sizes, top-k, filters and alerts.

Log rows have tag, epoch, date, node, month, day, time, rest (as the reader of node logs gives them); the hour is
the start of ``time``. Buckets are counted before anything else, so lines are shuffled only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.operators.segments import with_latest

BUCKET = ("date", "hour", "node")


def with_hour(lines: DataFrame) -> DataFrame:
    return lines.withColumn("hour", F.substring_index("time", ":", 1).try_cast("int"))


def group_by_node_hour(lines: DataFrame, *, key: Sequence[str] = BUCKET, line: str | None = None) -> DataFrame:
    """Number of lines of each bucket; with ``line``, also the lines themselves, sorted."""
    counts = [F.count(F.lit(1)).alias("n")]
    if line:
        counts.append(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.groupBy(*key).agg(*counts)


def bucket_sizes(buckets: DataFrame) -> DataFrame:
    """Total, number and greatest size of counted buckets, in one row."""
    return buckets.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("buckets"), F.max("n").alias("largest"))


def largest_buckets(buckets: DataFrame, k: int = 1, order: str = "n") -> DataFrame:
    """The ``k`` largest of counted buckets, and those as large as the smallest of them."""
    least = buckets.orderBy(F.desc(order)).limit(k).agg(F.min(order).alias("__least"))
    return buckets.join(F.broadcast(least), F.col(order) >= F.col("__least")).drop("__least")


def abnormally_large(buckets: DataFrame, threshold: int = 100_000) -> DataFrame:
    """Buckets of at least ``threshold`` lines."""
    return buckets.where(F.col("n") >= threshold)


def lines_of(lines: DataFrame, buckets: DataFrame, key: Sequence[str] = BUCKET) -> DataFrame:
    """The lines of the given buckets."""
    return lines.join(buckets.select(*key), list(key), "left_semi")


def grep(lines: DataFrame, pattern: str, *, key: Sequence[str] = BUCKET, text: str = "rest") -> DataFrame:
    """Buckets of which a line matches the regular expression."""
    return lines.groupBy(*key).agg(F.bool_or(F.coalesce(F.col(text).rlike(pattern), F.lit(False))).alias("hit")).where("hit").drop("hit")


def messages_within(lines: DataFrame, month: str, days: tuple[int, int], hours: tuple[int, int]) -> DataFrame:
    """Lines of a month, of days and hours above the lower and up to the upper bounds."""
    return lines.where(
        (F.col("month") == month) & (F.col("day") > days[0]) & (F.col("day") <= days[1]) & (F.col("hour") > hours[0]) & (F.col("hour") <= hours[1])
    )


def messages_from(lines: DataFrame, node: object) -> DataFrame:
    return lines.where(F.col("node") == F.lit(node))


def tagged_alerts(lines: DataFrame) -> DataFrame:
    """Lines that carry a tag; ``-`` is none."""
    return lines.where(F.col("tag") != "-")


def detect_alerts(lines: DataFrame, rules: Mapping[str, str], *, key: Sequence[str] = BUCKET, text: str = "rest") -> DataFrame:
    """Buckets with a matching line, with the names of the rules that match, sorted."""
    named = F.array_compact(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))
    hits = lines.select(*key, F.explode(named).alias("rule"))
    return hits.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


def contains_filter(lines: DataFrame, needle: str, *, text: str = "rest") -> DataFrame:
    """Number of all lines and of those whose upper-cased text has ``needle``, in one row."""
    hit = F.upper(F.col(text)).contains(needle.upper())
    return lines.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))


def first_match_per_bucket(lines: DataFrame, condition: str | Column, *, key: Sequence[str] = BUCKET, order: str = "pos", text: str = "rest") -> DataFrame:
    """The first line of each bucket for which ``condition`` holds."""
    return lines.where(condition).groupBy(*key).agg(F.min(order).alias(order), F.min_by(text, order).alias(text))


def active_hours_per_node(lines: DataFrame, more_than: int = 2) -> DataFrame:
    """Nodes with lines in more than so many hours, and how many."""
    hours = lines.select("node", "date", "hour").distinct()
    return hours.groupBy("node").agg(F.count(F.lit(1)).alias("hours")).where(F.col("hours") > more_than)


def timing_summary(lines: DataFrame, text: str = "value", prefixes: Sequence[str] = ()) -> DataFrame:
    """Sum and mean milliseconds for each function (and caller) of lines ``Time <function> [from <caller>]: ms``.

    ``prefixes`` are cut from the names.
    """
    line = F.col(text)
    name = F.regexp_extract(line, r"^Time (\S+?):?(?: from (\S+?))?:? \S*$", 1)
    caller = F.regexp_extract(line, r"^Time \S+ from (\S+?):? \S*$", 1)
    key = F.when(caller != "", F.concat_ws(" ", name, caller)).otherwise(name)
    for prefix in prefixes:
        key = F.replace(key, F.lit(prefix), F.lit(""))
    ms = F.element_at(F.split(line, r"\s+"), -1).try_cast("double")
    timed = lines.where(name != "").select(key.alias("name"), ms.alias("ms"))
    return timed.groupBy("name").agg(F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))


def section_filter(lines: DataFrame, *, text: str = "value", order: str = "pos", file: str = "file", heading: str = "app fractions:", stretch: int | None = 16_000_000) -> DataFrame:
    """Rows below a heading whose last two fields are numbers and not both zero, with the first word of the heading.

    A file is worked on in stretches of its places, so that a long one takes many tasks.
    """
    words = F.split(F.trim(text), r"\s+")
    uuid = F.when(F.col(text).contains(heading), F.element_at(words, 1))
    a, b = F.try_element_at(words, F.lit(-2)).try_cast("double"), F.try_element_at(words, F.lit(-1)).try_cast("double")
    seen = with_latest(lines, [file], order, stretch, uuid=uuid).withColumns({"__a": a, "__b": b})
    kept = seen.where("uuid is not null and __a is not null and __b is not null and not (__a = 0 and __b = 0)")
    return kept.where(~F.col(text).contains(heading)).drop("__a", "__b")


#: Bytes of a sample's parts, each feature having a name and a number, each of five numbers eight bytes.
UUID_BYTES, MODEL_BYTES, FEATURE_BYTES, NUMBER_BYTES, EVENT_BYTES, STATE_BYTES, OTHER_BYTES = 36, 20, 7 + 16, 5 * 8, 4, 10, 50


def record_sizes(samples: DataFrame, *, key: str = "time", features: str | Column = "size(features)", packed: str | None = None) -> DataFrame:
    """Estimated kilobytes of a sample, from its fixed parts and its features, and its measured packed size, if there is one."""
    n = F.expr(features) if isinstance(features, str) else features
    size = n * FEATURE_BYTES + UUID_BYTES + MODEL_BYTES + NUMBER_BYTES + EVENT_BYTES + STATE_BYTES + OTHER_BYTES
    return samples.select(key, (size / 1000).alias("kilobytes"), *([packed] if packed else []))
