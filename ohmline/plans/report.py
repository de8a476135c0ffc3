"""The whole fleet report in one call: a dictionary of DataFrames instead of callbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.operators import fleet as C
from ohmline.operators import rates as R
from ohmline.operators import stored
from ohmline.shared import cut


def tall_report(report: dict[str, DataFrame]) -> DataFrame:
    """The comparisons, scores and correlations of a report in one table: (part, key1, key2, n, value, value_neg, distance)."""
    shapes = {
        "os": ("os", None, "n", "ev", "ev_neg", "distance"), "model": ("model", None, "n", "ev", "ev_neg", "distance"), "users": ("uuid", None, "n_rates", "ev", "ev_neg", "distance"),
        "similar": ("uuid", None, "n_similar", "ev", "ev_neg", "distance"), "hogs": ("app", None, "users_with", "ev", "ev_neg", "distance"), "bugs": ("app", "uuid", "n", "ev", "ev_neg", "distance"),
        "skipped": ("app", "reason", "users_with", None, None, None), "scores": ("uuid", None, None, "j_score", None, None), "correlations": ("kind", "value", None, "r", None, None),
        "hog_correlations": ("app", "value", None, "r", None, None), "os_variance": ("os", None, "samples", "ev", "sum_sq_dev", None), "model_variance": ("model", None, "samples", "ev", "sum_sq_dev", None),
        "usage": ("uuid", "app", None, "rate_share", "time_share", None),
    }
    kinds = ("string", "string", "long", "double", "double", "double")
    names = ("key1", "key2", "n", "value", "value_neg", "distance")
    parts = [
        report[part].select(F.lit(part).alias("part"), *[(F.col(c) if c else F.lit(None)).cast(k).alias(n) for c, k, n in zip(shape, kinds, names)])
        for part, shape in shapes.items()
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def full_report(samples: DataFrame, registrations: DataFrame, daemons: Sequence[str] = (), least_users: int = C.LEAST_USERS) -> dict[str, DataFrame]:
    """Every comparison of the fleet. Rates, and rates with mass and mean, are written once; all else is lazy."""
    rates = cut(R.pairwise_rates(R.asof_os_model(samples, registrations)).withColumn("rate_id", F.xxhash64("uuid", "time1", "time2")))
    prior = D.a_priori(rates)
    points = cut(D.rate_points(rates, prior))
    profiles = C.user_profile(points, daemons)
    hogs = C.hogs(points, daemons, least_users)
    return {
        "rates": rates,
        "a_priori": prior,
        "os": C.compare_os(points),
        "model": C.compare_model(points),
        "users": profiles,
        "similar": C.similar_users(points, daemons),
        "hogs": hogs,
        "bugs": C.bugs(points, daemons, least_users),
        "skipped": C.skipped_apps(points, daemons, least_users),
        "scores": C.j_scores(profiles),
        "correlations": C.correlations(points, daemons),
        "hog_correlations": C.correlations_by_app(points, hogs),
        "os_variance": C.group_variance(points, "os"),
        "model_variance": C.group_variance(points, "model"),
        "usage": C.app_usage(rates),
        "points": points,
    }

