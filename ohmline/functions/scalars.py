"""Scalar functions: rounding, differences, and uniform distributions held as two columns (lo, hi)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A point is widened by this on both sides where an interval is asked whether it holds a value.
POINT_WIDTH = 0.0005


def n_decimal(x: Column, decimals: int) -> Column:
    """Rounded half up, towards plus infinity; 0 decimals leave the value as it is."""
    if decimals == 0:
        return x
    scale = float(10**decimals)
    return F.floor(x * scale + 0.5) / scale


def n_int(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def ev_difference(with_: Column, without: Column) -> Column:
    """1 - without / with; 0 if both are 0, null if only ``with_`` is."""
    return F.when((with_ == 0) & (without == 0), F.lit(0.0)).otherwise(1 - F.try_divide(without, with_))


def improvement_hours(with_: Column, without: Column) -> Column:
    """Hours of battery life gained: the time to drain 100 % at either rate, apart."""
    return (F.try_divide(F.lit(100.0), without) - F.try_divide(F.lit(100.0), with_)) / 3600


def days_and_hours(hours: Column) -> tuple[Column, Column]:
    days = F.floor(hours / 24)
    return days, hours - days * 24


def is_point(lo: Column, hi: Column) -> Column:
    return lo == hi


def mean(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


def contains(lo: Column, hi: Column, x: Column) -> Column:
    """Whether the half-open interval holds ``x``; a point holds what is within its width."""
    return F.when(lo == hi, (x >= lo - POINT_WIDTH) & (x < lo + POINT_WIDTH)).otherwise((x >= lo) & (x < hi))


def overlaps(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return F.when(lo == hi, (lo >= start) & (lo < end)).otherwise((lo < end) & (start < hi))


def density(lo: Column, hi: Column) -> Column:
    """Probability of a unit of length; null for a point."""
    return F.when(lo != hi, 1 / (hi - lo))


def probability_at(lo: Column, hi: Column, x: Column) -> Column:
    """Density at ``x``; 1 for a point that holds it, 0 outside."""
    return F.when(contains(lo, hi, x), F.when(lo == hi, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), hi - lo))).otherwise(0.0)


def overlap_probability(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """Share of the interval that lies in [start, end); a point is in or out."""
    share = F.try_divide(F.greatest(F.least(hi, end) - F.greatest(lo, start), F.lit(0.0)), hi - lo)
    return F.when(lo == hi, ((lo >= start) & (lo < end)).cast("double")).otherwise(share)


def discretize(lo: Column, hi: Column, decimals: int) -> Column:
    """Grid points of ``decimals`` decimals from lo to hi, both included."""
    scale = 10**decimals
    return F.transform(F.sequence(F.round(lo * scale).cast("long"), F.round(hi * scale).cast("long")), lambda i: i / scale)


def uniform_text(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.format_string("%.6f", lo)).otherwise(F.format_string("%.6f..%.6f", lo, hi))


def log_base(xmax: Column, smallest: float, buckets: int) -> Column:
    """Ratio of one logarithmic bucket's edge to the next."""
    return F.exp(F.ln(xmax / smallest) / buckets)


def equal_bucket(x: Column, xmax: Column, buckets: int) -> Column:
    """Bucket of equal width, 0 to buckets - 1."""
    return F.least(F.floor(F.coalesce(F.try_divide(x, xmax), F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")


def log_bucket(x: Column, xmax: Column, smallest: float, buckets: int) -> Column:
    """Bucket of logarithmic width, 0 to buckets - 1; values of 0 and below the smallest go to 0."""
    place = buckets - F.ln(xmax / x) / (F.ln(xmax / smallest) / buckets)
    return F.when(x > 0, F.least(F.greatest(place.cast("int"), F.lit(0)), F.lit(buckets - 1))).otherwise(0)


def equal_centre(bucket: Column, xmax: Column, buckets: int) -> Column:
    return (bucket + 0.5) / buckets * xmax


def log_edges(bucket: Column, xmax: Column, smallest: float, buckets: int) -> tuple[Column, Column]:
    """Lower and upper edge of a logarithmic bucket; the lower edge of bucket 0 is 0."""
    step = F.ln(xmax / smallest) / buckets
    upper = xmax * F.exp(-step * (buckets - 1 - bucket))
    lower = F.when(bucket == 0, F.lit(0.0)).otherwise(xmax * F.exp(-step * (buckets - bucket)))
    return lower, upper


def log_centre(bucket: Column, xmax: Column, smallest: float, buckets: int) -> Column:
    lower, upper = log_edges(bucket, xmax, smallest, buckets)
    return (lower + upper) / 2
