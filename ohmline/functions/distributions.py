"""Distributions of rates in long form: (group..., x, p), and histograms: (group..., bucket, mass).

Rates need rate_id, rate, rate_lo, rate_hi (both bounds null: a point). A range stands for the slice of the
a-priori distribution inside it. Slices are looked up by prefix sums in two levels, over bins of x and inside a
bin, so neither the rates nor the a-priori values pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.functions import scalars
from ohmline.shared import cut, joined_on

#: Width of the bins of x in which prefix sums are taken.
BIN_WIDTH = 0.00005


def bin_of(x: Column, width: float = BIN_WIDTH) -> Column:
    return F.floor(x / width)


def a_priori(rates: DataFrame) -> DataFrame:
    """(x, n, p) of the distinct point rates; empty if there are none."""
    counts = rates.where("rate_lo is null and rate is not null").groupBy(F.col("rate").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("__all"))).select("x", "n", (F.col("n") / F.col("__all")).alias("p"))


def prefixed(rows: DataFrame, values: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Running sums ``__<value>`` of each value in the order of x, then ``order``; rows have x and the keys."""
    binned = rows.withColumn("__bin", bin_of(F.col("x")))
    bins = binned.groupBy(*keys, "__bin").agg(*[F.sum(v).alias(f"__b_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "__bin", *[F.coalesce(F.sum(f"__b_{v}").over(earlier), F.lit(0)).alias(f"__b_{v}") for v in values])
    inside = Window.partitionBy(*keys, "__bin").orderBy("x", *order).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined_on(binned, bins, [*keys, "__bin"])
    sums = {f"__{v}": F.col(f"__b_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return joined.withColumns(sums).drop("__bin", *[f"__b_{v}" for v in values])


def running(rows: DataFrame, values: dict[str, Column], keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """``rows`` with the running sums of ``values`` in the order of ``x``, which is distinct for given keys.

    Rows are dealt by ranges of x and written; the sums of the ranges, a small table, are added up first.
    """
    keys = list(keys)
    dealt = cut(rows.withColumns({f"__{n}": v for n, v in values.items()}).repartitionByRange(*keys, x).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__range").agg(*[F.sum(f"__{n}").alias(f"__s_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "__range", *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__s_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in values})
    same = F.col("__range") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    starts = starts.select(F.col("__range").alias("__at"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__s_{n}" for n in values])
    return own.join(starts, same).select(*rows.columns, *[(F.col(f"__s_{n}") + F.col(f"__{n}")).alias(n) for n in values])


def rate_points(rates: DataFrame, prior: DataFrame) -> DataFrame:
    """``rates`` with ``slice`` (a-priori count in a range, null for a point), ``below`` (that below it), ``mass`` (0 or 1) and ``mean``.

    A point has mass 1 at its rate; a range whose slice is empty has mass 0 and mean 0, and so has a null rate.
    """
    at = prior.select("x", F.lit(1).alias("side"), F.col("n").alias("c"), (F.col("n") * F.col("x")).alias("cx"))
    bounds = rates.where("rate_lo is not null").select(
        "rate_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("rate_lo").alias("x")), F.struct(F.lit(1).alias("end"), F.col("rate_hi").alias("x")))).alias("b")
    )
    asked = bounds.select("rate_id", "b.end", "b.x", F.lit(0).alias("side"))
    sums = prefixed(at.unionByName(asked, allowMissingColumns=True), ["c", "cx"], ["side"]).where("rate_id is not null")
    end = lambda k, c: F.max(F.when(F.col("end") == k, F.col(c)))
    slices = sums.groupBy("rate_id").agg((end(1, "__c") - end(0, "__c")).alias("slice"), end(0, "__c").alias("below"), (end(1, "__cx") - end(0, "__cx")).alias("__sum"))
    found = rates.join(slices, "rate_id", "left")
    point = F.col("rate_lo").isNull() & F.col("rate").isNotNull()
    return found.withColumns(
        {
            "mass": F.when(point | (F.col("slice") > 0), 1).otherwise(0),
            "mean": F.when(point, F.col("rate")).when(F.col("slice") > 0, F.col("__sum") / F.col("slice")).otherwise(0.0),
        }
    ).drop("__sum")


def frequencies(points: DataFrame, prior: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., x, w): weight of each value over the rates of a group.

    A point adds 1 at its rate, a range adds its a-priori slice scaled to 1. The ranges' part at x is the
    a-priori count there times the sum of 1/slice over the ranges that hold x, a running sum of steps.
    """
    keys = list(group)
    single = points.where("rate_lo is null and rate is not null").select(*keys, F.col("rate").alias("x"), F.lit(1.0).alias("w"))
    ranges = points.where("rate_lo is not null and slice > 0")
    each = 1 / F.col("slice")
    steps = ranges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("rate_lo").alias("x"), each.alias("s"), F.lit(1).alias("k")),
                F.struct(F.col("rate_hi").alias("x"), (-each).alias("s"), F.lit(-1).alias("k")),
            )
        ).alias("e"),
    ).select(*keys, "e.x", "e.s", "e.k", F.lit(0).alias("side"))
    if keys:
        most = prior.agg(F.max("x").alias("most"))
        ends = ranges.join(most).select(*keys, F.explode(F.array(F.struct(bin_of(F.col("rate_lo")).alias("bin"), F.lit(1).alias("step")), F.struct((bin_of(F.least("rate_hi", "most")) + 1).alias("bin"), F.lit(-1).alias("step")))).alias("e"))
        turns = ends.groupBy(*keys, "e.bin").agg(F.sum("e.step").alias("step"))  # no more than the bins of the a-priori values
        by_bin = Window.partitionBy(*keys).orderBy("bin")
        held = turns.select(*keys, "bin", F.sum("step").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)).alias("open"), F.lead("bin").over(by_bin).alias("next")).where("open > 0")
        covered = held.select(*keys, F.explode(F.sequence("bin", F.col("next") - 1)).alias("bin"))
        grid = covered.join(prior.select("x", "n", bin_of(F.col("x")).alias("bin")), "bin")
    else:
        grid = prior.select("x", "n")
    marks = grid.select(*keys, "x", F.lit(1).alias("side"), "n")
    sums = prefixed(steps.unionByName(marks, allowMissingColumns=True), ["s", "k"], ["side"], keys).where("side = 1 and __k > 0")
    spread = sums.select(*keys, "x", (F.col("n") * F.col("__s")).alias("w"))
    return single.unionByName(spread).groupBy(*keys, "x").agg(F.sum("w").alias("w"))


def prob_dist(freqs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., x, p): frequencies over their total; a group without any has no rows."""
    keys = list(group)
    totals = freqs.groupBy(*keys).agg(F.sum("w").alias("__total"))
    return joined_on(freqs, totals, keys).select(*keys, "x", (F.col("w") / F.col("__total")).alias("p"))


def expected_value(dist: DataFrame, group: Sequence[str] = (), weight: str = "p") -> DataFrame:
    return dist.groupBy(*group).agg(F.sum(F.col("x") * F.col(weight)).alias("ev"))


def xmax_of(left: DataFrame, right: DataFrame, x: str = "x") -> DataFrame:
    """One row: the greatest value of both distributions, 0 if either is empty."""
    a, b = left.agg(F.max(x).alias("a")), right.agg(F.max(x).alias("b"))
    return a.join(b).select(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.greatest("a", "b")).alias("xmax"))


def zero_filled(hist: DataFrame, groups: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """``hist`` with a row of mass 0 for each bucket that a group lacks."""
    grid = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return joined_on(grid, hist, [*keys, "bucket"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def histogram(dist: DataFrame, bucket: Column, buckets: int, group: Sequence[str], decimals: int, weight: str = "p") -> DataFrame:
    """Mass of each bucket, rounded half up, zero filled; ``bucket`` is a column of the bucket's number."""
    keys = list(group)
    sums = dist.groupBy(*keys, bucket.alias("bucket")).agg(scalars.n_decimal(F.sum(weight), decimals).alias("mass"))
    return zero_filled(sums, dist.select(*keys).distinct(), buckets, keys)


def equal_width_histogram(dist: DataFrame, xmax: DataFrame, buckets: int = 100, decimals: int = 0, group: Sequence[str] = (), weight: str = "p") -> DataFrame:
    """Histogram of equal widths up to ``xmax`` (a one-row table, or one with the group's columns)."""
    keys = [k for k in group if k in xmax.columns]
    joined = joined_on(dist, xmax, keys)
    return histogram(joined, scalars.equal_bucket(F.col("x"), F.col("xmax"), buckets), buckets, group, decimals, weight)


def log_histogram(dist: DataFrame, xmax: DataFrame, buckets: int = 100, smallest: float = 0.0001, decimals: int = 0, group: Sequence[str] = (), weight: str = "p") -> DataFrame:
    """Histogram of logarithmic widths from ``smallest`` up to ``xmax``."""
    keys = [k for k in group if k in xmax.columns]
    joined = joined_on(dist, xmax, keys)
    return histogram(joined, scalars.log_bucket(F.col("x"), F.col("xmax"), smallest, buckets), buckets, group, decimals, weight)


def normalised_log_histogram(freqs: DataFrame, xmax: DataFrame, buckets: int = 100, smallest: float = 0.0001, decimals: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """Logarithmic histogram of frequencies over their total, with ``ev`` of the group and whether it sums to 1."""
    keys = list(group)
    hist = log_histogram(prob_dist(freqs, keys), xmax, buckets, smallest, 0, keys)
    hist = joined_on(hist, xmax, [k for k in keys if k in xmax.columns])
    w = Window.partitionBy(*keys)
    return hist.select(
        *keys,
        "bucket",
        scalars.n_decimal(F.col("mass"), decimals).alias("mass"),
        F.sum(F.col("mass") * scalars.log_centre(F.col("bucket"), F.col("xmax"), smallest, buckets)).over(w).alias("ev"),
        F.sum("mass").over(w).between(0.99, 1.01).alias("sums_to_one"),
    )


def tops(points: DataFrame, prior: DataFrame) -> DataFrame:
    """``points`` with ``top``, the greatest value that a rate stands for; null for a range without any."""
    upto = running(prior.select("x", "n"), {"upto": F.col("n")}).select(F.col("x").alias("__x"), "upto")
    end = F.when(F.col("slice") > 0, F.col("below") + F.col("slice"))
    found = points.join(upto, end == F.col("upto"), "left")
    return found.withColumn("top", F.when(F.col("rate_lo").isNull(), F.col("rate")).otherwise(F.col("__x"))).drop("__x", "upto")


def bucket_masses(points: DataFrame, prior: DataFrame, buckets: int = 100, smallest: float = 0.0001, ends: DataFrame | None = None) -> DataFrame:
    """``points``, which have ``xmax``, once for each logarithmic bucket up to it that a rate has mass in, with ``bucket`` and ``mass``.

    A range's part of a bucket is told by counts of a-priori values: those below it, those in it, and those below the
    bucket's edges, of which there are no more than buckets and values of ``xmax`` (``ends``, if they are known). The edges
    are written first, so that Spark sees how few they are and the rates stay where they are.
    """
    place = lambda x: scalars.log_bucket(x, F.col("xmax"), smallest, buckets)
    some = (points if ends is None else ends).select("xmax").distinct()
    held = prior.join(some).groupBy("xmax", place(F.col("x")).alias("bucket")).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("xmax").orderBy("bucket"))
    edges = cut(held.select("xmax", "bucket", upto.alias("__to"), (upto - F.col("n")).alias("__from")))
    point = F.col("rate_lo").isNull()
    known = points.where((point & F.col("rate").isNotNull()) | (~point & (F.col("slice") > 0)))
    touched = known.withColumn("bucket", F.explode(F.sequence(place(F.coalesce("rate_lo", "rate")), place(F.when(point, F.col("rate")).otherwise(F.col("rate_hi"))))))
    part = (F.least(F.col("below") + F.col("slice"), F.col("__to")) - F.greatest("below", "__from")) / F.col("slice")
    spread = touched.join(edges, ["xmax", "bucket"], "left").withColumn("mass", F.when(point, 1.0).when(F.col("__to").isNotNull(), part))
    return spread.where("mass > 0").select(*points.columns, "bucket", "mass")


def compare_distributions(with_: DataFrame, without: DataFrame, group: Sequence[str] = (), buckets: int | None = None, smallest: float = 0.0001) -> DataFrame:
    """(group..., ev, ev_neg, xmax, distance, prob, prob_neg) of two distributions; none where either is empty.

    The distributions are packed as arrays of (x, p), or with ``buckets`` as arrays of (bucket, mass) of logarithmic
    buckets up to the greater maximum, those without mass left out.
    """
    keys = list(group)
    side = lambda d, name: d.groupBy(*keys).agg(F.sum(F.col("x") * F.col("p")).alias(f"ev{name}"), F.max("x").alias(f"__top{name}"))
    one, two = side(with_, ""), side(without, "_neg")
    pair = joined_on(one, two, keys).where("ev is not null and ev_neg is not null")
    pair = pair.withColumn("xmax", F.greatest("__top", "__top_neg")).drop("__top", "__top_neg").withColumn("distance", scalars.ev_difference(F.col("ev"), F.col("ev_neg")))
    for dist, name in ((with_, "prob"), (without, "prob_neg")):
        if buckets is None:
            packed = dist.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "p"))).alias(name))
        else:
            at = joined_on(dist, pair.select(*keys, "xmax"), keys)
            sums = at.groupBy(*keys, scalars.log_bucket(F.col("x"), F.col("xmax"), smallest, buckets).alias("bucket")).agg(F.sum("p").alias("mass"))
            packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "mass"))).alias(name))
        pair = joined_on(pair, packed, keys)
    return pair


def equal_histogram_ev(hist: DataFrame, xmax: float, buckets: int, group: Sequence[str] = ()) -> DataFrame:
    """Expected value of a histogram of equal widths, from the bucket centres."""
    return hist.groupBy(*group).agg(F.sum(scalars.equal_centre(F.col("bucket"), F.lit(float(xmax)), buckets) * F.col("mass")).alias("ev"))


def log_histogram_ev(hist: DataFrame, xmax: float, smallest: float, buckets: int, group: Sequence[str] = ()) -> DataFrame:
    """Expected value of a histogram of logarithmic widths, from the bucket middles."""
    return hist.groupBy(*group).agg(F.sum(scalars.log_centre(F.col("bucket"), F.lit(float(xmax)), smallest, buckets) * F.col("mass")).alias("ev"))


def range_histogram(ranges: DataFrame, xmax: float | DataFrame, buckets: int, group: Sequence[str] = (), decimals: int = 0, smallest: float | None = None) -> DataFrame:
    """Histogram of uniform ranges (lo, hi): each bucket gets the share of a range that lies in it, a point adds 1.

    Masses are over their total. ``xmax`` is a number or a one-row table. Widths are equal, or logarithmic if ``smallest``
    is given. A range is only expanded into the buckets that it touches.
    """
    keys = list(group)
    ranges = ranges.join(xmax.select(F.col("xmax").alias("__top"))) if isinstance(xmax, DataFrame) else ranges.withColumn("__top", F.lit(float(xmax)))
    top = F.col("__top")
    place = (lambda x: scalars.equal_bucket(x, top, buckets)) if smallest is None else (lambda x: scalars.log_bucket(x, top, smallest, buckets))
    if smallest is None:
        edges = F.col("bucket") * top / buckets, (F.col("bucket") + 1) * top / buckets
    else:
        edges = scalars.log_edges(F.col("bucket"), top, smallest, buckets)
    touched = ranges.withColumn("bucket", F.explode(F.sequence(place(F.col("lo")), place(F.col("hi")))))
    part = F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(scalars.overlap_probability(F.col("lo"), F.col("hi"), *edges))
    sums = touched.groupBy(*keys, "bucket").agg(F.sum(part).alias("mass"))
    total = F.sum("mass").over(Window.partitionBy(*keys))
    filled = zero_filled(sums, ranges.select(*keys).distinct(), buckets, keys)
    return filled.withColumn("mass", scalars.n_decimal(F.try_divide(F.col("mass"), total), decimals))


def cdf(dist: DataFrame, xmax: DataFrame | None = None, group: Sequence[str] = ()) -> DataFrame:
    """(group..., x, cumulative) of distributions that are tables of distinct values; with ``xmax``, an end point (xmax, 1)."""
    keys = list(group)
    sums = running(dist.select(*keys, "x", "p"), {"cumulative": F.col("p")}, keys).select(*keys, "x", "cumulative")
    if xmax is None:
        return sums
    ends = dist.select(*keys).distinct().join(xmax).select(*keys, F.col("xmax").alias("x"), F.lit(1.0).alias("cumulative"))
    return joined_on(sums, ends, [*keys, "x"], "left_anti").unionByName(ends)


def upper_edge_log_buckets(dist: DataFrame, xmax: float, buckets: int = 23, base: float = 1.5, group: Sequence[str] = ()) -> DataFrame:
    """(group..., edge, mass): each value goes to the first edge xmax / base^k not below it, k < ``buckets``."""
    keys = list(group)
    edges = [xmax / base ** (buckets - i - 1) for i in range(buckets)]
    return upper_edges(dist, edges, keys)


def upper_edge_equal_buckets(dist: DataFrame, xmax: float, buckets: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """(group..., edge, mass): each value goes to the first of ``buckets`` equally spaced edges not below it."""
    return upper_edges(dist, [xmax / buckets * (i + 1.0) for i in range(buckets)], list(group))


def upper_edges(dist: DataFrame, edges: list[float], keys: list[str]) -> DataFrame:
    numbers = F.array(*[F.lit(e) for e in edges])
    first = F.element_at(F.filter(numbers, lambda e: e >= F.col("x")), 1)
    sums = dist.where(F.col("x") <= edges[-1]).groupBy(*keys, first.alias("edge")).agg(F.sum("p").alias("mass"))
    grid = dist.select(*keys).distinct().select(*keys, F.explode(numbers).alias("edge"))
    return joined_on(grid, sums, [*keys, "edge"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def ks_distance(first: DataFrame, second: DataFrame, metric: str = "signed", group: Sequence[str] = ()) -> DataFrame:
    """(group..., distance) between two distributions.

    ``signed``: greatest second minus first cumulative, not below 0, at the points of the later-starting one.
    ``absolute``: the difference of greatest size, with its sign. ``weighted``: differences times half the way
    between the sides' latest points, the greatest in size. A distribution is a table of distinct values.
    """
    keys = list(group)
    both = first.select(*keys, "x", F.col("p").alias("a"), F.lit(0.0).alias("b"), F.col("x").alias("xa"), F.lit(None).cast("double").alias("xb")).unionByName(
        second.select(*keys, "x", F.lit(0.0).alias("a"), F.col("p").alias("b"), F.lit(None).cast("double").alias("xa"), F.col("x").alias("xb"))
    )
    at = both.groupBy(*keys, "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("xa").alias("xa"), F.max("xb").alias("xb"))
    counted = running(at, {"diff": F.col("b") - F.col("a"), "na": F.col("xa").isNotNull().cast("long"), "nb": F.col("xb").isNotNull().cast("long")}, keys)
    starts = at.groupBy(*keys).agg(F.min("xa").alias("fa"), F.min("xb").alias("fb"))
    last = lambda side: counted.where(f"x{side} is not null").select(*keys, F.col(f"n{side}"), F.col(f"x{side}").alias(f"l{side}"))
    sums = joined_on(joined_on(counted, last("a"), [*keys, "na"], "left"), last("b"), [*keys, "nb"], "left")
    sums = joined_on(sums, starts, keys)
    if metric == "signed":
        later = F.when(F.col("fa") > F.col("fb"), F.col("xa").isNotNull()).otherwise(F.col("xb").isNotNull())
        return sums.where(later).groupBy(*keys).agg(F.greatest(F.max("diff"), F.lit(0.0)).alias("distance"))
    value = F.col("diff") if metric == "absolute" else F.col("diff") * (F.col("la") - F.col("lb")) / 2
    return sums.withColumn("__v", value).where("__v is not null").groupBy(*keys).agg(F.max_by("__v", F.struct(F.abs("__v"), "__v")).alias("distance"))


def spread(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """(group..., mean, sum_sq_dev, root): the sum of squared deviations is what the reference calls variance."""
    squares = F.var_pop(value) * F.count(value)
    return rows.groupBy(*group).agg(F.avg(value).alias("mean"), squares.alias("sum_sq_dev"), F.sqrt(squares).alias("root"))


def normalize(rows: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``normalized``: deviation from the mean over the root of ``spread``; null if that is 0."""
    keys = list(group)
    stats = spread(rows, value, keys)
    joined = joined_on(rows, stats, keys)
    return joined.withColumn("normalized", F.try_divide(F.col(value) - F.col("mean"), F.when(F.col("root") != 0, F.col("root")))).drop("mean", "sum_sq_dev", "root")


def correlation(x: Column, y: Column) -> Column:
    """Correlation of the rows where both are known; null if either is constant there."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(left: DataFrame, right: DataFrame, key: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row with the correlation of x and y by key; a key that the right side lacks counts as 0."""
    joined = left.join(right, list(key), "left")
    return joined.agg(correlation(F.col(x), F.coalesce(y, F.lit(0.0))).alias("r"))


def mixture_stddev(ranges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., ev, stddev) of the even mixture of uniform ranges (lo, hi) around the mean of their middles."""
    mid, second = (F.col("lo") + F.col("hi")) / 2, (F.col("lo") * F.col("lo") + F.col("lo") * F.col("hi") + F.col("hi") * F.col("hi")) / 3
    sums = ranges.groupBy(*group).agg(F.avg(mid).alias("ev"), F.avg(second).alias("__second"))
    return sums.withColumn("stddev", F.sqrt(F.greatest(F.col("__second") - F.col("ev") * F.col("ev"), F.lit(0.0)))).drop("__second")


def ev_with_evidence(points: DataFrame, group: Sequence[str], least: int = 10) -> DataFrame:
    """(group..., ev, n_rates, n_users) of the groups with at least ``least`` rates."""
    sums = points.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("mass") * F.col("mean")), F.sum("mass")).alias("ev"),
        F.count(F.lit(1)).alias("n_rates"),
        F.count_distinct("uuid").alias("n_users"),
    )
    return sums.where(F.col("n_rates") >= least)


def non_zero(values: DataFrame, value: str = "mass", group: Sequence[str] = ()) -> DataFrame:
    """Rows above zero, with the group's sum."""
    return values.where(F.col(value) > 0).withColumn("total", F.sum(value).over(Window.partitionBy(*group)))
