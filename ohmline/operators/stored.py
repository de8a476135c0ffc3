"""Comparisons with their distributions, as they are stored: xmax and both sides' logarithmic histograms.

Histograms add up: of a set's complement it is that of all rates less that of the set, if the buckets' edges are the same.
Where both sides together are all rates, the edges end at one greatest value. Else they end at the greatest value of the
pair; the other side has the greatest value of all users, or the next user's, so an app has two different ends at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.operators import fleet as C
from ohmline.operators.rates import current_os_model
from ohmline.shared import cut, joined_on

BUCKETS, SMALLEST = 100, 0.0001
#: Mass below this is a rounding error of the difference of two sums.
LEAST_MASS = 1e-9


def packed(hist: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each key with its histogram over its total, as an array in bucket order without empty buckets."""
    kept = hist.where(F.col("mass") > LEAST_MASS)
    entries = F.sort_array(F.collect_list(F.struct("bucket", "mass")))
    total = F.sum("mass")
    return kept.groupBy(*keys).agg(entries.alias("__e"), total.alias("__t")).select(
        *keys, F.expr("transform(__e, e -> named_struct('bucket', e.bucket, 'mass', e.mass / __t))").alias(name)
    )


def by_bucket(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "bucket").agg(F.sum("mass").alias("mass"))


def less(total: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms ``total`` less ``part``, by keys and bucket."""
    both = joined_on(total, part.withColumnRenamed("mass", "__part"), [*keys, "bucket"], "left")
    return both.select(*keys, "bucket", (F.col("mass") - F.coalesce("__part", F.lit(0.0))).alias("mass"))


def described(found: DataFrame, keys: list[str], own: DataFrame, rest: DataFrame) -> DataFrame:
    """Comparisons ``found``, which have xmax, with both histograms."""
    return joined_on(joined_on(found, packed(own, keys, "prob"), keys, "left"), packed(rest, keys, "prob_neg"), keys, "left")


def against_all(found: DataFrame, keys: list[str], own: DataFrame, all_: DataFrame, xmax: DataFrame) -> DataFrame:
    """Comparisons of a set of rates with all others, under one xmax."""
    total = found.select(*keys).join(all_)
    return described(found.join(xmax), keys, own, less(total, own, keys))


def pair_ends(most: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., uuid, xmax) of each user's current rates against the other users' rates; ``most`` has (scope..., uuid, top, now_top)."""
    best = most.groupBy(*scope).agg(F.max(F.struct("top", "uuid")).alias("__b")).select(*scope, F.col("__b.top").alias("__one"), F.col("__b.uuid").alias("__who"))
    with_best = most.join(best, scope) if scope else most.join(best)
    second = with_best.where(F.col("uuid") != F.col("__who")).groupBy(*scope, "__one", "__who").agg(F.max("top").alias("__two"))
    joined = most.join(second, scope) if scope else most.join(second)
    return joined.select(*scope, "uuid", F.greatest("now_top", F.when(F.col("uuid") == F.col("__who"), F.col("__two")).otherwise(F.col("__one"))).alias("xmax"))


def shares(hist: Column) -> Column:
    """A histogram, an array of (bucket, mass) in bucket order, over its total and without empty buckets; null if it has none."""
    kept = F.filter(hist, lambda e: e["mass"] > LEAST_MASS)
    over = lambda total: F.when(total > 0, F.transform(kept, lambda e: F.struct(e["bucket"].alias("bucket"), (e["mass"] / total).alias("mass"))))
    return F.aggregate(kept, F.lit(0.0), lambda total, e: total + e["mass"], over)


def filled(hist: Column) -> Column:
    """The masses of all buckets of such an array, null taken as empty; in one pass, as bucket by bucket it would be a search each."""
    hist = F.coalesce(hist, F.array().cast("array<struct<bucket:int,mass:double>>"))
    none = lambda n: F.array_repeat(F.lit(0.0), n)
    later = F.zip_with(hist, F.slice(hist, 2, BUCKETS), lambda e, after: F.concat(F.array(e["mass"]), none(F.coalesce(after["bucket"], F.lit(BUCKETS)) - e["bucket"] - 1)))
    return F.concat(none(F.coalesce(F.get(hist, F.lit(0))["bucket"], F.lit(BUCKETS))), F.flatten(later))


def against_others(found: DataFrame, scope: list[str], every: DataFrame, prior: DataFrame) -> DataFrame:
    """Comparisons of one user's current rates (``now`` is true) with other users' rates (of each scope, such as an app).

    The rates of a user stay together from the join with the user's end on, and only arrays of buckets meet the totals.
    """
    keys = [*scope, "uuid"]
    most = cut(every.groupBy(*keys).agg(F.max("top").alias("top"), F.max(F.when(F.col("now"), F.col("top"))).alias("now_top")))
    ends = cut(found.select(*keys).join(pair_ends(most, scope), keys))
    some = cut(ends.select(*scope, "xmax").distinct())
    entries = lambda mass: F.sort_array(F.collect_list(F.struct("bucket", F.col(mass).alias("mass"))))
    rows = D.bucket_masses(every.join(ends, keys).repartition(*keys), prior, BUCKETS, SMALLEST, some)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum("mass").alias("mine"), F.sum(F.when(F.col("now"), F.col("mass"))).alias("own"))
    users = sums.groupBy(*keys).agg(entries("own").alias("__own"), entries("mine").alias("__mine"))
    of_all = D.bucket_masses(every.join(some, scope) if scope else every.join(some), prior, BUCKETS, SMALLEST, some)
    totals = cut(by_bucket(of_all, [*scope, "xmax"]).groupBy(*scope, "xmax").agg(filled(entries("mass")).alias("__all")))
    joined = found.join(ends, keys).join(users, keys, "left").join(totals, [*scope, "xmax"], "left")
    less_mine = F.zip_with("__all", filled(F.col("__mine")), lambda a, b: a - b)
    rest = F.transform(less_mine, lambda mass, bucket: F.struct(bucket.alias("bucket"), mass.alias("mass")))
    return joined.select(*found.columns, "xmax", shares(F.col("__own")).alias("prob"), shares(rest).alias("prob_neg"))


NATURES = ("os", "model", "similar", "hog", "result", "bug")


def stored_results(points: DataFrame, prior: DataFrame, daemons: Sequence[str] = (), least_users: int = C.LEAST_USERS, natures: Sequence[str] = NATURES) -> dict[str, DataFrame]:
    """The comparisons of each of the natures, labelled, with xmax, prob, prob_neg, and the apps of a user."""
    current = current_os_model(points).select("uuid", F.col("os").alias("__os"))
    flagged = joined_on(D.tops(points, prior), current, ["uuid"], "left").withColumn("now", F.col("os").eqNullSafe(F.col("__os")))
    points, found = cut(flagged.drop("__os")), {}
    if set(natures) & {"os", "model", "similar", "hog"}:
        xmax = cut(points.agg(F.coalesce(F.max("top"), F.lit(0.0)).alias("xmax")))
        masses = cut(D.bucket_masses(points.join(xmax), prior, BUCKETS, SMALLEST, xmax).select("os", "model", "apps", "bucket", "mass"))
        all_ = by_bucket(masses, [])
    for nature, compare in (("os", C.compare_os), ("model", C.compare_model)):
        if nature in natures:
            found[nature] = C.labelled(against_all(compare(points), [nature], by_bucket(masses, [nature]), all_, xmax), nature, [nature])
    if "similar" in natures:
        similar = C.similar_sums(C.user_sets(points, daemons), masses.select("apps", "bucket", "mass"), ["mass"], ["bucket"], daemons)
        found["similar"] = C.labelled(against_all(C.similar_users(points, daemons), ["uuid"], similar, all_, xmax), "similar", ["uuid"])
    if "hog" in natures:
        hogs = cut(C.hogs(points, daemons, least_users))
        by_app = by_bucket(masses.withColumn("app", F.explode("apps")).join(hogs.select("app"), "app", "left_semi"), ["app"])
        found["hog"] = C.labelled(against_all(hogs, ["app"], by_app, all_, xmax), "hog", ["app"])
    if "result" in natures:
        found["result"] = C.labelled(against_others(cut(C.user_profile(points, daemons)), [], points, prior), "result", ["uuid"])
    if "bug" in natures:
        bugs = cut(C.bugs(points, daemons, least_users))
        having = lambda rows: rows.withColumn("app", F.explode("apps")).join(bugs.select("app").distinct(), "app", "left_semi")
        found["bug"] = C.labelled(against_others(bugs, ["app"], having(points), prior), "bug", ["app", "uuid"])
    return found
