"""Sinks and maintenance of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.operators.rates import exclude_daemons

RESULT_COLUMNS = ("nature", "key1", "key2", "xmax", "ev", "ev_neg", "distance", "users_with", "users_without", "prob", "prob_neg", "apps")


def result_rows(comparisons: DataFrame) -> DataFrame:
    """Labelled comparisons in the columns of the result table; what a comparison lacks is null."""
    kinds = {"nature": "string", "key1": "string", "key2": "string", "users_with": "long", "users_without": "long", "prob": "array<struct<bucket:int,mass:double>>", "prob_neg": "array<struct<bucket:int,mass:double>>", "apps": "array<string>"}
    have = set(comparisons.columns)
    return comparisons.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "double")).alias(c) for c in RESULT_COLUMNS])


def write_results(results: DataFrame, path: str, dry: bool = False) -> DataFrame:
    """Results by nature; only the natures that ``results`` has are replaced. A dry run writes nothing."""
    rows = result_rows(results)
    if not dry:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("nature").parquet(path)
    return rows


def expire_results(old: DataFrame, new: DataFrame, skipped: DataFrame) -> DataFrame:
    """Old results that still hold: of the natures in ``new`` those still found, without bugs of new hogs or results of skipped apps."""
    o, n = old.alias("o"), new.select("nature", "key1", "key2").distinct().alias("n")
    same = (F.col("o.nature") == F.col("n.nature")) & F.col("o.key1").eqNullSafe(F.col("n.key1")) & F.col("o.key2").eqNullSafe(F.col("n.key2"))
    kept = o.join(n, same, "left_semi")
    new_hogs = new.where("nature = 'hog'").select(F.col("key1").alias("app"))
    gone = skipped.select("app").unionByName(new_hogs.join(skipped.select("app"), "app", "left_anti")).distinct()
    bug_or_hog = F.col("o.nature").isin("hog", "bug")
    kept = kept.join(skipped.select("app").distinct().alias("s"), bug_or_hog & (F.col("o.key1") == F.col("s.app")), "left_anti")
    return kept.join(gone.alias("g"), (F.col("o.nature") == "bug") & (F.col("o.key1") == F.col("g.app")), "left_anti")


def remove_daemons(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Results without hogs and bugs of daemons."""
    apps = results.where(F.col("nature").isin("hog", "bug"))
    return results.where(~F.col("nature").isin("hog", "bug")).unionByName(exclude_daemons(apps, names, app="key1"))


def delete_rows(table: DataFrame, condition: str | Column) -> DataFrame:
    """The rows that stay if those meeting the condition are deleted; write them in place of the table."""
    gone = F.expr(condition) if isinstance(condition, str) else condition
    return table.where(~F.coalesce(gone, F.lit(False)))


def device_samples(samples: DataFrame, uuid: object, after: float | None = None) -> DataFrame:
    """(time, level, state) of one device, in order of time."""
    one = samples.where(F.col("uuid") == F.lit(uuid))
    if after is not None:
        one = one.where(F.col("time") > after)
    return one.select("time", "level", "state").orderBy("time")


def dump_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_text(table: DataFrame, path: str, separator: str = ", ") -> DataFrame:
    """One line of text for each row; returns what is written."""
    lines = table.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in table.columns]).alias("value"))
    lines.write.mode("overwrite").text(path)
    return lines


def plot_data(dist: DataFrame, group: Sequence[str] = (), x: str = "x", y: str = "p") -> DataFrame:
    """Points of a plot, in order."""
    return dist.select(*group, F.col(x).alias("x"), F.col(y).alias("y")).orderBy(*group, "x")


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def ordered_correlations(correlations: DataFrame) -> DataFrame:
    """Correlations by their size, the greatest first; nulls last."""
    return correlations.orderBy(F.abs("r").desc_nulls_last(), "kind", "value")


def curve_lines(curve: DataFrame, start: str | Column, *, pattern: str = "EEE MMM dd HH:mm:ss yyyy", end: str = "end_s") -> DataFrame:
    """Battery curve as (date, level)."""
    begin = F.expr(start) if isinstance(start, str) else start
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(begin) + F.col(end)), pattern)
    return curve.select(*[c for c in curve.columns if c not in (end, "level", "block")], date.alias("date"), "level")


def larger_groups_first(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows with the size of their group, those of larger groups first."""
    return rows.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*group))).orderBy(F.desc("group_size"), *group)
