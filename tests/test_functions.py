import random

import pytest
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.functions import scalars as X
from ohmline.operators import fleet as C
from ohmline.operators import logs as L
from ohmline.operators import rates as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_rounding_goes_up(spark):
    assert one(spark, X.n_int(F.lit(-2.5))) == -2 and one(spark, X.n_int(F.lit(2.5))) == 3
    assert one(spark, X.n_decimal(F.lit(0.125), 2)) == pytest.approx(0.13) and one(spark, X.n_decimal(F.lit(0.125), 0)) == 0.125


@pytest.mark.parametrize("a, b, want", [(0.0, 0.0, 0.0), (2.0, 1.0, 0.5), (0.0, 1.0, None)])
def test_ev_difference(spark, a, b, want):
    assert one(spark, X.ev_difference(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("x, bucket", [(1.0, 99), (0.0, 0), (0.00005, 0)])
def test_log_bucket(spark, x, bucket):
    assert one(spark, X.log_bucket(F.lit(x), F.lit(1.0), 0.0001, 100)) == bucket


def test_top_k_keeps_ties(spark):
    sizes = lambda *n: spark.createDataFrame([(i, k) for i, k in enumerate(n)], "b long, n long")
    assert sorted(r["n"] for r in L.largest_buckets(sizes(10, 5, 5, 3), 2).collect()) == [5, 5, 10]
    assert sorted(r["n"] for r in L.largest_buckets(sizes(10, 5, 3), 2).collect()) == [5, 10]


def test_asof(spark):
    regs = spark.createDataFrame([("u", o, "m", float(t)) for t, o in ((10, "A"), (20, "B"), (30, "C"))], "uuid string, os string, model string, time double")
    samples = spark.createDataFrame([("u", float(t)) for t in (5, 10, 15, 25, 40)] + [("w", 1.0)], "uuid string, time double")
    found = R.asof_os_model(samples, regs).orderBy("uuid", "time").collect()
    assert [r["os"] for r in found] == ["A", "A", "A", "B", "C", None]


def test_rate_values(spark):
    low, high = R.range_rate(F.lit(0.80), F.lit(0.75), F.lit(1000.0))
    assert one(spark, R.point_rate(F.lit(0.80), F.lit(0.75), F.lit(1000.0))) == pytest.approx(0.005)
    assert one(spark, low) == pytest.approx(0.0, abs=1e-12) and one(spark, high) == pytest.approx(0.01)


def rates(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", *r) for i, r in enumerate(rows)], "rate_id long, uuid string, rate double, rate_lo double, rate_hi double")


def test_frequencies_of_points_and_ranges(spark):
    r = rates(spark, [(1.0, None, None), (1.0, None, None), (2.0, None, None), (4.0, None, None), (2.5, 1.0, 4.0), (5.5, 5.0, 6.0)])
    prior = D.a_priori(r)
    points = D.rate_points(r, prior)
    found = {x["x"]: x["w"] for x in D.frequencies(points, prior).collect()}
    assert found == pytest.approx({1.0: 2 + 2 / 3, 2.0: 1 + 1 / 3, 4.0: 1.0})
    assert D.expected_value(D.prob_dist(D.frequencies(points, prior))).first()["ev"] == pytest.approx((8 / 3 + 8 / 3 + 4) / 5)
    assert [p["mass"] for p in points.orderBy("rate_id").collect()] == [1, 1, 1, 1, 1, 0]


def test_slices_agree_with_brute_force(spark):
    rng = random.Random(1)
    rows = [(round(rng.uniform(0, 0.01), 4), None, None) for _ in range(200)]
    for _ in range(100):
        a = round(rng.uniform(0, 0.01), 4)
        rows.append((0.0, a, a + round(rng.uniform(0.0001, 0.004), 4)))
    r = rates(spark, rows)
    prior = D.a_priori(r)
    values = [x for x, lo, _ in rows if lo is None]
    for p in D.rate_points(r, prior).where("rate_lo is not null").collect():
        inside = [v for v in values if p["rate_lo"] <= v < p["rate_hi"]]
        assert p["mass"] == int(bool(inside))
        assert p["mean"] == pytest.approx(sum(inside) / len(inside) if inside else 0.0)


def test_scores_with_ties(spark):
    users = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0), ("e", None)], "uuid string, distance double")
    assert [r["j_score"] for r in C.j_scores(users).orderBy("uuid").collect()] == [0.75, 0.25, 0.25, 0.0]


def test_empty_rates(spark):
    r = rates(spark, [(1.0, None, None)]).limit(0)
    prior = D.a_priori(r)
    assert prior.count() == 0 and D.rate_points(r, prior).count() == 0


def test_ks_of_equal_distributions(spark):
    d = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5)], "x double, p double")
    for metric in ("signed", "absolute", "weighted"):
        assert D.ks_distance(d, d, metric).first()["distance"] == 0.0


def test_running_sums_by_ranges(spark):
    import random

    from ohmline.functions import distributions as D
    from pyspark.sql import functions as F

    rng = random.Random(7)
    rows = [(k, float(x), rng.random()) for k in ("a", "b", None) for x in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "k string, x double, p double")
    found = {(r["k"], r["x"]): r["total"] for r in D.running(df, {"total": F.col("p")}, ["k"]).collect()}
    for k in ("a", "b", None):
        total = 0.0
        for _, x, p in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            total += p
            assert abs(found[k, x] - total) < 1e-9
    assert len(found) == len(rows)


def test_bucket_masses_add_up_to_frequencies(spark):
    import random

    from ohmline.functions import distributions as D
    from ohmline.functions import scalars
    from pyspark.sql import functions as F

    rng = random.Random(9)
    points = [(i, round(rng.uniform(0.0002, 0.03), 4), None, None) for i in range(60)]
    ranges = [(100 + i, None, lo, lo + rng.uniform(0, 0.02)) for i in range(60) for lo in [rng.choice([0.0, rng.uniform(0, 0.03)])]]
    rates = spark.createDataFrame(points + ranges, "rate_id long, rate double, rate_lo double, rate_hi double")
    prior = D.a_priori(rates)
    found = D.tops(D.rate_points(rates, prior), prior)
    xmax = found.agg(F.max("top").alias("xmax"))
    masses = {r["bucket"]: r["m"] for r in D.bucket_masses(found.join(xmax), prior, 30).groupBy("bucket").agg(F.sum("mass").alias("m")).collect()}
    freqs = D.frequencies(found, prior).join(xmax).groupBy(scalars.log_bucket(F.col("x"), F.col("xmax"), 0.0001, 30).alias("bucket")).agg(F.sum("w").alias("m"))
    want = {r["bucket"]: r["m"] for r in freqs.collect()}
    assert masses.keys() == want.keys() and all(abs(masses[b] - want[b]) < 1e-9 for b in want)
    best = {r["rate_id"]: r["top"] for r in found.collect()}
    values = sorted(r[1] for r in points)
    for i, rate, lo, hi in points + ranges:
        inside = [x for x in values if lo is not None and lo <= x < hi]
        assert best[i] == (rate if lo is None else max(inside, default=None))
