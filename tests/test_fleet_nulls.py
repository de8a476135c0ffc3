"""Devices without a registration and samples without a level, through rates, distributions and comparisons."""

import pytest
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.operators import fleet as C
from ohmline.operators import rates as R
from ohmline.shared import cut

EVENT = "batterylevelchanged"


@pytest.fixture(scope="module")
def rates(spark):
    """Devices a and b are registered, c is not, d has a sample without a level in the middle."""
    level = {"a": [1.0, 0.9, 0.7], "b": [0.8, 0.7], "c": [0.9, 0.5, 0.4], "d": [1.0, None, 0.8, 0.7]}
    samples = [(u, 1e6 * i, x, EVENT if u != "c" or i < 2 else "screen on", "unplugged", [f"x{i % 2}"]) for u, xs in level.items() for i, x in enumerate(xs)]
    regs = [("a", "v1", "m1", 0.0), ("b", "v1", "m2", 0.0), ("d", "v2", "m2", 0.0)]
    samples = spark.createDataFrame(samples, "uuid string, time double, level double, event string, state string, apps array<string>")
    return cut(R.classified_pairs(R.asof_os_model(samples, spark.createDataFrame(regs, "uuid string, os string, model string, time double"))).withColumn("rate_id", F.monotonically_increasing_id()))


def test_pairs_without_a_level_are_not_used(rates):
    reasons = {(r["uuid"], r["time2"]): r["reject_reason"] for r in rates.collect()}
    assert {k for k, v in reasons.items() if v == "no level"} == {("d", 1e6), ("d", 2e6)}
    assert sum(v is None for v in reasons.values()) == 6
    assert {r["kind"]: r["n"] for r in R.rejection_counts(rates).collect()} == {"no level": 2, "point": 5, "range": 1}


def test_null_rates_have_no_mass(rates):
    points = D.rate_points(rates, D.a_priori(rates.where("reject_reason is null")))
    assert {r["mass"] for r in points.where("rate is null").collect()} == {0}
    freqs = D.frequencies(points, D.a_priori(rates.where("reject_reason is null")))
    assert freqs.where("x is null").count() == 0 and freqs.agg(F.sum("w")).first()[0] == pytest.approx(points.agg(F.sum("mass")).first()[0])


def test_devices_without_a_registration_stay(rates):
    used = rates.where("reject_reason is null")
    prior = D.a_priori(used)
    points = cut(D.rate_points(used, prior))
    assert {r["uuid"]: r["n"] for r in R.current_os_rates(points).groupBy("uuid").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 1, "c": 2, "d": 1}
    assert {r["uuid"] for r in C.user_profile(points).collect()} == {"a", "b", "c", "d"}
    assert {r["os"] for r in C.compare_os(points).collect()} == {"v1", "v2", None}
    dist = D.prob_dist(D.frequencies(points, prior, ["os"]), ["os"])
    assert {r["os"]: r["p"] for r in dist.groupBy("os").agg(F.sum("p").alias("p")).collect()} == {"v1": pytest.approx(1), "v2": pytest.approx(1), None: pytest.approx(1)}
    hist = D.equal_width_histogram(dist, dist.agg(F.max("x").alias("xmax")), 5, 6, ["os"])
    assert hist.where("os is null").count() == 5 and hist.where("os is null").agg(F.sum("mass")).first()[0] == pytest.approx(1)
    both = D.compare_distributions(dist, dist, ["os"])
    assert {r["os"]: r["distance"] for r in both.collect()} == {"v1": 0.0, "v2": 0.0, None: 0.0}
    assert {r["os"]: r["distance"] for r in D.ks_distance(dist, dist, "absolute", ["os"]).collect()} == {"v1": 0.0, "v2": 0.0, None: 0.0}
    numbers = C.correlations(points).where("value = 'rates'").first()["r"]
    by_hand = points.join(points.groupBy("uuid").agg(F.count("*").cast("double").alias("k")), "uuid").agg(F.corr("mean", "k")).first()[0]
    assert numbers == pytest.approx(by_hand)
    assert C.correlations(points.withColumn("apps", F.array(F.lit("x")))).where("value = 'apps'").first()["r"] is None
    labels = {r["title"] for r in C.labelled(C.compare_os(points), "os", ["os"]).collect()}
    assert labels == {"OS v1 running", "OS v2 running", "OS unknown running"}
