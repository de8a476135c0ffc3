"""Operators on whole series: energy, gaps, downsampling, battery curves, schedules, slopes.

Where an operator takes ``chunk_rows``, a long series is worked on in chunks, as in ``segments``, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.operators.segments import SAMPLING_STEP, SERIES, STEP_TOLERANCE, col, numbered, positioned, with_before
from ohmline.shared import joined_on, ship

ship(__name__)

ROWS_A_SECOND = 5000


def total_energy(rows: DataFrame, *, series: Sequence[str] = SERIES, power: str | Column = "current_ma * voltage_v", rate: float = ROWS_A_SECOND) -> DataFrame:
    """Milliwatt-hours of each series: the sum of powers over rows per second and seconds per hour."""
    return rows.groupBy(*series).agg((F.sum(col(power)) / rate / 3600).alias("mwh"))


def find_gaps(rows: DataFrame, *, series: Sequence[str] = SERIES, order: str = "num", time: str = "time_s", step: float = SAMPLING_STEP, tolerance: float = STEP_TOLERANCE, chunk_rows: int | None = None) -> DataFrame:
    """(from_s, to_s, step_s) wherever the time from row to row is not the sampling step."""
    seen = with_before(rows, list(series), order, chunk_rows, __from=F.col(time)).select(*series, F.col("__from").alias("from_s"), F.col(time).alias("to_s"))
    return seen.withColumn("step_s", F.col("to_s") - F.col("from_s")).where(F.abs(F.col("step_s") - step) > tolerance)


def integrate_power(rows: DataFrame, *, series: Sequence[str] = SERIES, order: str = "num", time: str = "time_s", power: str | Column = "current_ma * voltage_v", ends: str | Column = "false", chunk_rows: int | None = None) -> DataFrame:
    """Left-hold integral of each segment: its duration and watt-hours. A row where ``ends`` holds closes a segment."""
    keys = list(series)
    timed = rows.withColumns({"__time": F.col(time), "__power": col(power), "__ends": F.coalesce(col(ends).cast("int"), F.lit(0))})
    seen = with_before(timed, keys, order, chunk_rows, __last="__time", __held="__power")
    chunked = chunk_rows is not None
    placed = numbered(seen, F.col("__ends"), keys, order, chunked, "__upto")
    cut_up = placed.select(
        *keys,
        (F.col("__upto") - F.col("__ends")).alias("segment"),
        F.col("__time"),
        F.coalesce("__last", "__time").alias("__from"),
        (F.col("__held") * (F.col("__time") - F.col("__last"))).alias("__work"),
    )
    return cut_up.groupBy(*keys, "segment").agg(
        (F.max("__time") - F.min("__from")).alias("duration_s"),
        (F.coalesce(F.sum("__work"), F.lit(0.0)) / 1000 / 3600).alias("watt_hours"),
    )


def block_of(span: int) -> Column:
    """The block of ``span`` rows that a numbered row is in."""
    return F.floor((F.col("__pos") - 1) / span)


def downsample_by_count(
    rows: DataFrame,
    span: int = 2500,
    *,
    series: Sequence[str] = SERIES,
    order: str = "num",
    time: str = "time_s",
    power: str | Column = "current_ma * voltage_v",
    drop_partial: bool = False,
    most_span: int | None = 5000,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Mean time and power of every ``span`` rows; a span outside 1 to ``most_span`` counts as 2500."""
    if span < 1 or (most_span is not None and span > most_span):
        span = 2500
    keys = list(series)
    placed = positioned(rows.withColumn("__power", col(power)), keys, order, chunk_rows)
    blocks = placed.withColumn("block", block_of(span)).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.avg(time).alias("time_s"), F.avg("__power").alias("mw")
    )
    return blocks.where(F.col("n") == span) if drop_partial else blocks


def downsample_runs(runs: DataFrame, span: int, *, series: Sequence[str] = SERIES, order: str = "num", time: str = "time_s", power: str | Column = "current_ma * voltage_v", step: float = SAMPLING_STEP, tolerance: float = STEP_TOLERANCE, chunk_rows: int | None = None) -> DataFrame:
    """Mean power of every ``span`` rows of a run that follow their predecessor by the sampling step; whole blocks only.

    ``time_ms`` counts the rows so far in sampling steps.
    """
    keys = [*series, "run_id"]
    seen = with_before(runs.withColumn("__power", col(power)), keys, order, chunk_rows, __last=F.col(time))
    steady = seen.where((F.col(time) - F.col("__last")).between(step - tolerance, step + tolerance)).select(*runs.columns, "__power")
    blocks = downsample_by_count(steady, span, series=keys, order=order, time=time, power="__power", drop_partial=True, most_span=None, chunk_rows=chunk_rows)
    return blocks.select(*keys, "block", ((F.col("block") + 1) * span * F.lit(step * 1000)).alias("time_ms"), "mw")


def downsample_first(rows: DataFrame, limit: int, span: int, *, order: str = "num", **options) -> DataFrame:
    """Downsampled first ``limit`` rows (by their number) of each series; a short last block is dropped."""
    return downsample_by_count(rows.where(F.col(order) <= limit), span, order=order, drop_partial=True, most_span=None, **options)


def battery_curve(
    rows: DataFrame,
    capacity: float,
    start_level: float,
    *,
    span: int = 300_000,
    series: Sequence[str] = SERIES,
    order: str = "num",
    time: str = "time_s",
    current: str | Column = "current_ma",
    voltage: str | Column | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Battery level at the end of every block of ``span`` rows: used charge is the block's time times its current.

    A short last block is kept; its current is divided by the full span all the same. ``voltage`` is the
    auxiliary channel's, whose sum over 4 scales the charge.
    """
    keys = list(series)
    volts = F.lit(0.0) if voltage is None else col(voltage)
    placed = positioned(rows.withColumns({"__ma": col(current), "__v": volts}), keys, order, chunk_rows)
    blocks = placed.withColumn("block", block_of(span)).groupBy(*keys, "block").agg(
        F.max_by(time, order).alias("end_s"), F.sum("__ma").alias("__ma"), F.sum("__v").alias("__v")
    )
    w = Window.partitionBy(*keys).orderBy("block")
    took = F.col("end_s") - F.coalesce(F.lag("end_s").over(w), F.lit(0.0))
    used = took * F.col("__ma") * (F.lit(1.0) if voltage is None else F.col("__v") / 4) / span / 3600
    spent = F.sum("__used").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("__used", used).select(*keys, "block", "end_s", ((capacity - spent) / capacity * start_level).alias("level"))


def battery_curve_by_mean(rows: DataFrame, capacity: float, start: str | Column, *, span: int = ROWS_A_SECOND, series: Sequence[str] = SERIES, order: str = "num", time: str = "time_s", current: str | Column = "current_ma", chunk_rows: int | None = None) -> DataFrame:
    """Charge left and clock time after every block: each takes its mean current over 3600; the short last one too."""
    keys = list(series)
    placed = positioned(rows.withColumn("__ma", col(current)), keys, order, chunk_rows)
    blocks = placed.withColumn("block", block_of(span)).groupBy(*keys, "block").agg(
        F.max(time).alias("end_s"), F.avg("__ma").alias("__ma")
    )
    spent = F.sum(F.col("__ma") / 3600).over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    clock = F.date_format(F.timestamp_seconds(F.unix_timestamp(col(start)) + F.col("end_s")), "HH:mm:ss")
    return blocks.select(*keys, "block", clock.alias("clock"), (capacity - spent).alias("left_mah"))


def label_by_schedule(rows: DataFrame, schedule: DataFrame, base: str, *, time: str = "time_s") -> DataFrame:
    """``rows`` with the label of the schedule's interval that their time lies inside (ends excluded), else ``base``.

    Intervals must not overlap (a row would come once for each). The time of the schedule is cut into as many bins as there
    are intervals, and rows and intervals meet by bin: intervals that do not overlap touch two bins each on average.
    """
    slots = schedule.where("start_offset_s < end_offset_s").select(F.col("label").alias("__label"), F.col("start_offset_s").cast("double").alias("__from"), F.col("end_offset_s").cast("double").alias("__to"))
    width = (F.max("__to") - F.min("__from")) / F.count(F.lit(1))
    span = slots.agg(F.min("__from").alias("__first"), F.max("__to").alias("__last"), F.when(F.count(F.lit(1)) > 0, width).alias("__width"))
    first, last, wide = (span.select(c).scalar() for c in span.columns)
    bin_of = lambda t: F.floor((t - first) / wide)
    binned = slots.select("__label", "__from", "__to", F.explode(F.sequence(bin_of(F.col("__from")), bin_of(F.col("__to")))).alias("__slot"))
    at = F.col(time).cast("double")
    asked = rows.withColumn("__bin", F.when(at.between(first, last), bin_of(at)))
    inside = (F.col("__bin") == F.col("__slot")) & (F.col(time) > F.col("__from")) & (F.col(time) < F.col("__to"))
    return asked.join(binned, inside, "left").withColumn("label", F.coalesce("__label", F.lit(base))).drop("__label", "__from", "__to", "__bin", "__slot")


def mark_ends(rows: DataFrame, first: str | None = "start", last: str | None = "end", *, series: Sequence[str] = SERIES, order: str = "num", events: str = "events") -> DataFrame:
    """The first and last row of each series get one more event token; ``None`` leaves that end alone."""
    w = Window.partitionBy(*series)
    up = F.row_number().over(w.orderBy(order)) == 1
    down = F.row_number().over(w.orderBy(F.desc(order))) == 1
    token = lambda here, name: F.when(here, F.array(F.lit(name))).otherwise(F.array().cast("array<string>")) if name else F.array().cast("array<string>")
    return rows.withColumns({"__first": token(up, first), "__last": token(down, last)}).withColumn(
        events, F.concat(F.col(events), "__first", "__last")
    ).drop("__first", "__last")


def slopes_between(points: DataFrame, intervals: DataFrame, *, series: Sequence[str] = SERIES, time: str = "time_s", value: str = "value", range_points: int = 1_000_000) -> DataFrame:
    """Slope (y0 - y1) / (x1 - x0) of each series between the first points at or after the bounds of each interval.

    ``intervals`` has (interval_id, t0, t1) and is small next to the points. Past the end, the last point counts; equal
    times give a null slope. Time is cut into ranges of some ``range_points`` points: bounds look ahead inside their range
    first, then at the first point of the next range of the series that has one. Points without a time take no part.
    """
    keys = list(series)
    ends = intervals.select("interval_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("side"), F.col("t1").alias("t")))).alias("b"))
    bounds = points.select(*keys).distinct().join(ends.select("interval_id", "b.side", F.col("b.t").alias("__t")))
    at = points.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("__t"), F.struct(F.col(time).alias("x"), F.col(value).alias("y")).alias("__p"))
    both = at.unionByName(bounds, allowMissingColumns=True)
    span = at.agg(F.min("__t").alias("__first"), ((F.max("__t") - F.min("__t")) / F.ceil(F.count("__t") / range_points)).alias("__width"))
    place = [*keys, "__range"]
    first, wide = (span.select(c).scalar() for c in span.columns)
    both = both.withColumn("__range", F.coalesce(F.floor(F.try_divide(F.col("__t") - first, wide)), F.lit(0)))
    firsts = both.groupBy(*place).agg(F.min(F.when(F.col("__p").isNotNull(), F.struct("__t", "__p"))).alias("__f"), F.max(F.when(F.col("__p").isNotNull(), F.struct("__t", "__p"))).alias("__l"))
    by_range = Window.partitionBy(*keys).orderBy("__range")
    following = F.first("__f.__p", ignorenulls=True).over(by_range.rowsBetween(1, Window.unboundedFollowing))
    final = F.max("__l").over(Window.partitionBy(*keys))
    ends_of = firsts.select(*place, F.coalesce(following, final["__p"]).alias("__later"))
    w = Window.partitionBy(*place).orderBy(F.desc("__t"), F.col("side").asc_nulls_first())
    ahead = F.last("__p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hit = joined_on(both.withColumn("__ahead", ahead).where("interval_id is not null"), ends_of, place).withColumn("__q", F.coalesce("__ahead", "__later"))
    pairs = hit.groupBy(*keys, "interval_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("__q"))).alias("p0"), F.max(F.when(F.col("side") == 1, F.col("__q"))).alias("p1")
    )
    return pairs.select(*keys, "interval_id", F.try_divide(F.col("p0.y") - F.col("p1.y"), F.col("p1.x") - F.col("p0.x")).alias("slope"))


def slope_histogram(points: DataFrame, intervals: DataFrame, *, series: Sequence[str] = SERIES, decimals: int = 6, **options) -> DataFrame:
    """How often each slope occurs in each series over the intervals."""
    slopes = slopes_between(points, intervals, series=series, **options)
    return slopes.groupBy(*series, (F.round("slope", decimals) + 0.0).alias("slope")).agg(F.count(F.lit(1)).alias("n"))


def random_intervals(points: DataFrame, n: int, *, time: str = "time_s", seed: str = "1") -> DataFrame:
    """(interval_id, t0, t1): ``n`` intervals between the first and the last time of the points, drawn by a hash of ``seed``."""
    span = points.agg(F.min(time).alias("first"), F.max(time).alias("last"))
    drawn = lambda end: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{end}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / (1 << 52)
    at = lambda end: F.col("first") + drawn(end) * (F.col("last") - F.col("first"))
    both = points.sparkSession.range(n).join(span).select(F.col("id").alias("interval_id"), at(0).alias("a"), at(1).alias("b"))
    return both.select("interval_id", F.least("a", "b").alias("t0"), F.greatest("a", "b").alias("t1"))


def series_stats(rows: DataFrame, value: str = "value", *, series: Sequence[str] = SERIES, time: str = "time_s") -> DataFrame:
    """Mean and sample standard deviation of a value and of the time."""
    return rows.groupBy(*series).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.avg(time).alias("time_mean"), F.stddev_samp(time).alias("time_stddev")
    )


def idle_marks(rows: DataFrame, idle: float, *, series: Sequence[str] = SERIES, order: str = "num", time: str = "time_s", power: str | Column = "current_ma * voltage_v", interval: float = 0.5, chunk_rows: int | None = None) -> DataFrame:
    """Per interval of ``interval`` seconds: its end and whether its mean power is below ``idle``, with the work done before it.

    ``end_s`` is the time of the first row past the interval, which closes it.
    """
    keys = list(series)
    timed = with_before(rows.withColumns({"__time": F.col(time), "__power": col(power)}), keys, order, chunk_rows, __last="__time", __held="__power")
    work = F.coalesce(F.col("__held") * (F.col("__time") - F.col("__last")), F.lit(0.0))
    slots = timed.withColumn("__work", work).groupBy(*keys, F.floor(F.col("__time") / interval).alias("slot")).agg(
        F.avg("__power").alias("mw"), F.sum("__work").alias("work"), F.min("__time").alias("from_s"), F.max("__time").alias("to_s")
    )
    ahead = Window.partitionBy(*keys).orderBy("slot")
    return slots.withColumn("end_s", F.lead("from_s").over(ahead)).withColumn("is_idle", F.col("mw") < idle)


def detect_runs_by_checkpoint(
    rows: DataFrame,
    idle: float,
    at_least: float | Sequence[float],
    *,
    series: Sequence[str] = SERIES,
    shortest: float = 2.0,
    **options,
) -> DataFrame:
    """Stretches between idle checkpoints that last more than ``shortest`` and more than ``at_least`` seconds.

    A stretch of ``shortest`` to ``at_least`` seconds is added to the next; one of at most ``shortest`` is dropped.
    A list of ``at_least`` gives each emitted run of a series its own minimum. The rest after the last run is
    reported as the tail (``is_tail``). The fold runs on one row for each checkpoint, not on the measurements.
    """
    keys = list(series)
    wanted = [float(at_least)] if isinstance(at_least, (int, float)) else [float(x) for x in at_least]
    marks = idle_marks(rows, idle, series=keys, **options)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        began, work, found, out = 0.0, 0.0, 0, []
        group = group.sort_values("slot")
        key = tuple(group[k].iloc[0] for k in keys)
        for mw_idle, end, done, last in zip(group.is_idle, group.end_s, group.work, group.to_s):
            work += done
            if not mw_idle or end != end or end <= began:
                continue
            least = wanted[min(found, len(wanted) - 1)]
            if end > began + shortest:
                if end > began + least:
                    out.append((*key, began, end, end - began, work / 1000 / 3600, False))
                    began, work, found = end, 0.0, found + 1
            else:
                began, work = end, 0.0
        out.append((*key, began, last, last - began, work / 1000 / 3600, True))
        return pd.DataFrame(out, columns=[*keys, "start_s", "end_s", "duration_s", "watt_hours", "is_tail"])

    return marks.groupBy(*keys).applyInPandas(fold, f"{kinds}, start_s double, end_s double, duration_s double, watt_hours double, is_tail boolean")
