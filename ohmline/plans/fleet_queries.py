"""Registered queries from samples to fleet comparisons, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.functions import scalars
from ohmline.operators import fleet as C
from ohmline.operators import rates as R
from ohmline.operators import stored
from ohmline.plans import standins as I
from ohmline.plans.series_queries import rounded
from ohmline.sources import readers, sinks
from ohmline.shared import cut, read_table, shared_dir

DAEMONS = ["app0", "app1*"]
RATE = ["uuid", "os", "model", "time1", "time2", "rate", "rate_lo", "rate_hi"]


def apps_text(df):
    return df.withColumn("apps", F.array_join(F.sort_array("apps"), ","))


def p1_registration_history(spark, sf_dir):
    return rounded(R.registration_history(I.all_registrations(spark, sf_dir)), "time", decimals=3)


def p2_asof(spark, sf_dir):
    return rounded(I.samples(spark, sf_dir).select("uuid", "time", "os", "model"), "time", decimals=3)


def p3_rates(spark, sf_dir):
    return rounded(apps_text(I.rates(spark, sf_dir)).select(*RATE, "apps"), "time1", "time2", decimals=3).withColumns({n: F.round(n, 9) for n in ("rate", "rate_lo", "rate_hi")})


def p4_unabridged_rates(spark, sf_dir):
    return R.unabridged_rates(I.samples(spark, sf_dir)).groupBy("uuid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rate_lo").isNull().cast("long")).alias("points"), F.round(F.sum("rate"), 6).alias("rate"))


def p5_rates_of(spark, sf_dir):
    return rounded(R.rates_of(I.raw_samples(spark, sf_dir), "7", "v9", "m9").select(*RATE), "time1", "time2", decimals=3).withColumns({n: F.round(n, 9) for n in ("rate", "rate_lo", "rate_hi")})


def p6_rate_value(spark, sf_dir):
    p = I.pairs(spark, sf_dir)
    took = F.col("time2") - F.col("time1")
    low, high = R.range_rate(F.col("level1"), F.col("level2"), took)
    return p.select("uuid", F.round("time2", 3).alias("time2"), F.round(R.point_rate(F.col("level1"), F.col("level2"), took), 9).alias("point"), (F.round(low, 9) + 0.0).alias("lo"), (F.round(high, 9) + 0.0).alias("hi"))


def p7_rate_attributes(spark, sf_dir):
    p = I.pairs(spark, sf_dir)
    entries = F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.sort_array(e["value"]), "|")))
    return p.select("uuid", F.round("time2", 3).alias("time2"), F.array_join(F.sort_array("apps"), ",").alias("apps"), F.array_join(F.sort_array("events"), ",").alias("events"), F.array_join(entries, ",").alias("features"))


def p8_plausible(spark, sf_dir):
    r = R.pairwise_rates(I.samples(spark, sf_dir), plausible=False)
    return R.plausible_rates(r, 0.0005).groupBy("uuid").agg(F.count(F.lit(1)).alias("n"))


def p9_rejections(spark, sf_dir):
    return R.rejection_counts(I.pairs(spark, sf_dir))


HISTORY = ["level", "state", "event", "model", "os", "apps"]


def history(spark, sf_dir):
    """Of the columns and the extra features; levels as whole percents, which both engines write alike."""
    return R.feature_history(I.samples(spark, sf_dir).withColumn("level", F.round(F.col("level") * 100).cast("long")), HISTORY)


def p10_feature_history(spark, sf_dir):
    return rounded(history(spark, sf_dir), "time", decimals=3)


def p11_feature_changes(spark, sf_dir):
    return R.feature_change_pairs(history(spark, sf_dir))


def p12_last_features(spark, sf_dir):
    models = readers.latest_registrations(I.registrations(spark, sf_dir))
    return R.last_features(history(spark, sf_dir), models)


def p13_current_os(spark, sf_dir):
    return R.current_os_model(I.rates(spark, sf_dir))


def p14_limit_users(spark, sf_dir):
    return R.limit_users(I.rates(spark, sf_dir), 12).groupBy("uuid").agg(F.count(F.lit(1)).alias("n"))


def p15_current_os_rates(spark, sf_dir):
    return R.current_os_rates(I.rates(spark, sf_dir)).groupBy("uuid", "os").agg(F.count(F.lit(1)).alias("n"))


def p16_exclude_daemons(spark, sf_dir):
    apps = I.rates(spark, sf_dir).select("uuid", F.explode("apps").alias("app"))
    return R.exclude_daemons(apps, DAEMONS).groupBy("app").agg(F.count(F.lit(1)).alias("n"))


def p17_samples_text(spark, sf_dir):
    s = I.raw_samples(spark, sf_dir).withColumn("time", F.floor("time"))
    return R.samples_text(s).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def p17_registrations_text(spark, sf_dir):
    return R.registrations_text(I.all_registrations(spark, sf_dir).withColumn("time", F.floor("time")))


def p18_rates_text(spark, sf_dir):
    return R.rates_text(I.rates(spark, sf_dir).withColumn("time2", F.floor("time2"))).select("uuid", "time2", "line")


def p19_point_rates(spark, sf_dir):
    return R.point_rates(I.rates(spark, sf_dir)).select("uuid", F.round("time1", 3).alias("time1"), F.round("rate", 9).alias("rate"))


def p20_by_rate(spark, sf_dir):
    return R.by_rate(I.rates(spark, sf_dir)).select("uuid", F.round("time2", 3).alias("time2"), F.round("rate", 9).alias("rate"))


def d1_a_priori(spark, sf_dir):
    return D.a_priori(I.rates(spark, sf_dir)).select(F.round("x", 9).alias("x"), F.round("p", 9).alias("p"))


def d2_frequencies(spark, sf_dir):
    points, prior = I.points(spark, sf_dir)
    return D.frequencies(points, prior, ["os"]).select("os", F.round("x", 9).alias("x"), F.round("w", 5).alias("w"))


def d3_prob_dist(spark, sf_dir):
    points, prior = I.points(spark, sf_dir)
    return D.prob_dist(D.frequencies(points, prior, ["model"]), ["model"]).select("model", F.round("x", 9).alias("x"), F.round("p", 6).alias("p"))


def d4_expected_value(spark, sf_dir):
    points, prior = I.points(spark, sf_dir)
    return rounded(D.expected_value(D.prob_dist(D.frequencies(points, prior, ["os"]), ["os"]), ["os"]), "ev", decimals=8)


def d5_equal_histogram_ev(spark, sf_dir):
    return rounded(D.equal_histogram_ev(flag_hist(spark, sf_dir), 105.0, 20, ["flag"]), "ev")


def d6_log_histogram_ev(spark, sf_dir):
    dist = I.prices(spark, sf_dir)
    hist = D.log_histogram(dist, spark.range(1).select(F.lit(105.5).alias("xmax")), 20, 0.7, 0, ["flag"])
    return rounded(D.log_histogram_ev(hist, 105.5, 0.7, 20, ["flag"]), "ev")


def d7_rate_ev(spark, sf_dir):
    points, _ = I.points(spark, sf_dir)
    return points.select("uuid", F.round("time2", 3).alias("time2"), "mass", F.round("mean", 8).alias("mean"))


def d8_uniform_functions(spark, sf_dir):
    lo, hi = F.col("l_discount"), F.col("l_discount") + F.col("l_tax")
    items = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), F.round(hi, 2).alias("hi"))
    lo, hi, x, a, b = F.col("lo"), F.col("hi"), F.lit(0.0501), F.lit(0.0303), F.lit(0.0705)
    return items.select("l_orderkey", "l_linenumber", scalars.contains(lo, hi, x).alias("holds"), scalars.overlaps(lo, hi, a, b).alias("meets"), F.round(scalars.overlap_probability(lo, hi, a, b), 6).alias("part"), F.round(scalars.probability_at(lo, hi, x), 6).alias("at"), scalars.is_point(lo, hi).alias("point"), F.round(scalars.mean(lo, hi), 6).alias("mean"))


def d9_discretize(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    grid = scalars.discretize(F.col("l_discount"), F.round(F.col("l_discount") + F.col("l_tax"), 2), 2)
    return items.select("l_orderkey", "l_linenumber", F.size(grid).cast("long").alias("n"), F.round(F.aggregate(grid, F.lit(0.0), lambda s, g: s + g), 6).alias("total"))


FLAG_PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))


def by_flag_pair(spark, sf_dir, compare):
    """What ``compare`` gives for the distributions of each two return flags."""
    d = cut(I.prices(spark, sf_dir))
    found = [compare(d.where(F.col("flag") == a), d.where(F.col("flag") == b)).withColumn("flags", F.lit(a + b)) for a, b in FLAG_PAIRS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def d10_xmax(spark, sf_dir):
    return by_flag_pair(spark, sf_dir, D.xmax_of)


def flag_hist(spark, sf_dir):
    return D.equal_width_histogram(I.prices(spark, sf_dir), spark.range(1).select(F.lit(105.0).alias("xmax")), 20, 0, ["flag"])


def d11_equal_histogram(spark, sf_dir):
    return rounded(flag_hist(spark, sf_dir), "mass")


def rate_ranges(spark, sf_dir):
    return I.rates(spark, sf_dir).select("os", F.coalesce("rate_lo", "rate").alias("lo"), F.coalesce("rate_hi", "rate").alias("hi"))


def d12_range_histogram(spark, sf_dir):
    ranges = rate_ranges(spark, sf_dir)
    return rounded(D.range_histogram(ranges, ranges.agg(F.max("hi").alias("xmax")), 20, ["os"]), "mass")


def d13_log_histogram(spark, sf_dir):
    return rounded(D.log_histogram(I.prices(spark, sf_dir), spark.range(1).select(F.lit(105.5).alias("xmax")), 20, 0.7, 0, ["flag"]), "mass")


def d14_normalised_log_histogram(spark, sf_dir):
    freqs = I.prices(spark, sf_dir).select("flag", "x", (F.col("p") * 1000).alias("w"))
    found = D.normalised_log_histogram(freqs, spark.range(1).select(F.lit(105.5).alias("xmax")), 20, 0.7, 0, ["flag"])
    return rounded(found, "mass", "ev")


def d15_range_log_histogram(spark, sf_dir):
    ranges = rate_ranges(spark, sf_dir)
    return rounded(D.range_histogram(ranges, ranges.agg(F.max("hi").alias("xmax")), 20, ["os"], smallest=0.00001), "mass", decimals=5)


def d16_bucket_coordinates(spark, sf_dir):
    hist = flag_hist(spark, sf_dir)
    return hist.select("flag", "bucket", F.round(scalars.equal_centre(F.col("bucket"), F.lit(105.0), 20), 6).alias("equal"), F.round(scalars.log_centre(F.col("bucket"), F.lit(105.0), 0.7, 20), 6).alias("log"))


def d17_cdf(spark, sf_dir):
    return rounded(D.cdf(I.prices(spark, sf_dir), spark.range(1).select(F.lit(106.0).alias("xmax")), ["flag"]), "cumulative")


def d18_upper_edge_log(spark, sf_dir):
    return rounded(D.upper_edge_log_buckets(I.prices(spark, sf_dir), 106.0, group=["flag"]), "edge", "mass")


def d19_upper_edge_equal(spark, sf_dir):
    return rounded(D.upper_edge_equal_buckets(I.prices(spark, sf_dir), 106.5, group=["flag"]), "edge", "mass")


def ks(metric):
    def query(spark, sf_dir):
        found = by_flag_pair(spark, sf_dir, lambda a, b: D.ks_distance(a, b, metric))
        return found.select("flags", (F.round("distance", 6) + 0.0).alias("distance"))

    return query


def d23_spread(spark, sf_dir):
    return rounded(D.spread(I.measurements(spark, sf_dir), "cents", ["series_id"]), "mean", "sum_sq_dev", "root", decimals=3)


def d24_normalize(spark, sf_dir):
    return rounded(D.normalize(I.measurements(spark, sf_dir).select("series_id", "num", "cents"), "cents", ["series_id"]), "normalized")


def d25_pearson(spark, sf_dir):
    m = I.measurements(spark, sf_dir)
    x = m.groupBy("series_id").agg(F.sum("cents").cast("double").alias("x"))
    y = m.where("event_type = 'error'").groupBy("series_id").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return rounded(D.pearson(x, y, ["series_id"]), "r")


def d26_mixture_stddev(spark, sf_dir):
    return rounded(D.mixture_stddev(rate_ranges(spark, sf_dir), ["os"]), "ev", "stddev", decimals=8)


def d27_rounding(spark, sf_dir):
    x = F.col("value") - 50.125
    return read_table(spark, sf_dir, "events").select("event_id", scalars.n_decimal(x, 1).alias("one"), scalars.n_int(x).cast("long").alias("whole"))


def d28_ev_difference(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.round(scalars.ev_difference(F.col("l_discount"), F.col("l_tax")), 6).alias("d"))


def d29_improvement(spark, sf_dir):
    hours = scalars.improvement_hours(F.col("l_discount") / 1000, F.col("l_tax") / 1000)
    days, rest = scalars.days_and_hours(F.round(hours, 6))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(hours, 6).alias("hours"), days.cast("long").alias("days"), F.round(rest, 6).alias("rest"))


def d30_compare_distributions(spark, sf_dir):
    points, prior = I.points(spark, sf_dir)
    sides = points.withColumn("has", F.array_contains("apps", "app3"))
    dist = D.prob_dist(D.frequencies(sides, prior, ["has"]), ["has"])
    pair = D.compare_distributions(dist.where("has").drop("has"), dist.where("not has").drop("has"), buckets=100)
    return compared(pair).withColumns({"xmax": F.round("xmax", 8), "prob": masses_text("prob"), "prob_neg": masses_text("prob_neg")})


def masses_text(name):
    """A packed histogram as text, the masses in ten thousandths."""
    return F.array_join(F.transform(name, lambda e: F.concat(e["bucket"].cast("string"), F.lit(":"), F.floor(e["mass"] * 10000 + 0.500001).cast("string"))), ",")


def c3_user_profile(spark, sf_dir):
    found = stored.stored_results(*I.points(spark, sf_dir), DAEMONS, natures=["result"])["result"]
    return compared(found).select("uuid", "n_rates", "n_apps", "ev", "ev_neg", "distance", F.array_join("apps", ",").alias("apps"), F.round("xmax", 8).alias("xmax"), masses_text("prob").alias("prob"), masses_text("prob_neg").alias("prob_neg"))


def d31_evidence(spark, sf_dir):
    points, _ = I.points(spark, sf_dir)
    return rounded(D.ev_with_evidence(points, ["model", "os"], 10), "ev", decimals=8)


def d32_non_zero(spark, sf_dir):
    return rounded(D.non_zero(flag_hist(spark, sf_dir), "mass", ["flag"]), "mass", "total")


def compared(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in ("ev", "ev_neg")} | {"distance": F.round("distance", 5)})


def with_points(f):
    def query(spark, sf_dir):
        return f(I.points(spark, sf_dir)[0])

    return query


def c9_j_scores(points):
    return C.j_scores(C.user_profile(points, DAEMONS).withColumn("distance", F.round("distance", 5)))


def c10_correlations(points):
    return rounded(C.correlations(points, DAEMONS), "r", decimals=5)


def c11_correlations_by_app(points):
    apps = points.select(F.explode("apps").alias("app")).distinct()
    return rounded(C.correlations_by_app(points, apps), "r", decimals=5)


def c12_group_variance(spark, sf_dir):
    found = C.group_variances(*I.points(spark, sf_dir))
    rates = {n: F.round(n, 8) for n in ("ev", "user_mean", "term_mean")} | {n: F.round(n, 10) for n in ("user_sum_sq_dev", "term_sum_sq_dev")}
    whole = lambda side: F.round(F.col(f"{side}_days") * 24 + F.col(f"{side}_hours") + F.col(f"{side}_minutes") / 60, 3).alias(f"{side}_all_hours")
    return found.select("*", whole("term"), whole("user")).withColumns(rates).drop(*[f"{side}_{part}" for side in ("term", "user") for part in ("days", "hours", "minutes")])


def c13_app_usage(spark, sf_dir):
    return rounded(C.app_usage(I.rates(spark, sf_dir)), "rate_share", "time_share")


def ranges_of(points):
    return points.where("uuid in ('3', '7', '11')").groupBy("uuid").agg(F.min("time1").alias("t0"), (F.min("time1") + 1200000).alias("t1"))


def c14_excluding(points):
    hog, slices = C.excluding_ranges(points, "app3", ranges_of(points))
    return compared(hog)


def c14_slices(points):
    hog, slices = C.excluding_ranges(points, "app3", ranges_of(points))
    return compared(slices).select("uuid", F.round("t0", 3).alias("t0"), "n", "ev", "ev_neg", "distance")


def c15_ev_by_user_count(points):
    return rounded(C.ev_by_user_count(points), "ev", decimals=8)


def c15_user_ev_by_user_count(points):
    return rounded(C.user_ev_by_user_count(points), "ev", decimals=8)


def c16_user_slice(spark, sf_dir):
    points, prior = I.points(spark, sf_dir)
    some = C.user_slice(points, "7", 1704500000.0, 1706000000.0)
    return D.frequencies(some, prior).select(F.round("x", 9).alias("x"), F.round("w", 6).alias("w"))


def c18_labels(points):
    natures = {"bug": (C.bugs(points, DAEMONS), ["app", "uuid"]), "similar": (C.similar_users(points, DAEMONS), ["uuid"]), "result": (C.user_profile(points, DAEMONS), ["uuid"])}
    return results_of(points, C.hogs(points, DAEMONS), natures).select("nature", "key1", "key2", "title", "title_neg")


def results_of(points, hogs, more):
    """Labelled comparisons of hogs, operating systems, models, and the natures of ``more``."""
    natures = {"hog": (hogs, ["app"]), "os": (C.compare_os(points), ["os"]), "model": (C.compare_model(points), ["model"]), **more}
    parts = [C.labelled(rows, nature, keys) for nature, (rows, keys) in natures.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def k1_results(spark, sf_dir):
    """All natures, written to the shared folder and read back."""
    path = f"{shared_dir(spark)}/ohmline/results-{uuid.uuid4().hex}"
    for rows in stored.stored_results(*I.points(spark, sf_dir), DAEMONS).values():
        sinks.write_results(rows, path)
    found = compared(spark.read.parquet(path)).withColumns({"xmax": F.round("xmax", 8), "prob": masses_text("prob"), "prob_neg": masses_text("prob_neg"), "apps": F.array_join("apps", ",")})
    return found.select("nature", "key1", "key2", "xmax", "ev", "ev_neg", "distance", "users_with", "users_without", "prob", "prob_neg", "apps")


def k3_expire(points):
    """Results of apps that were compared, of which only hogs are found again, beside those of the other natures."""
    skipped, bugs = C.skipped_apps(points, DAEMONS), {"bug": (cut(C.bugs(points, DAEMONS)), ["app", "uuid"])}
    old, new = (sinks.result_rows(results_of(points, rows(points, DAEMONS), bugs)) for rows in (C.compared_apps, C.hogs))
    return sinks.expire_results(old, new, skipped).select("nature", "key1", "key2")


def k4_remove_daemons(points):
    return sinks.remove_daemons(sinks.result_rows(results_of(points, C.compared_apps(points), {})), DAEMONS).select("nature", "key1")


def k5_delete(spark, sf_dir):
    return sinks.delete_rows(I.raw_samples(spark, sf_dir), "uuid = '7' or state = 'charging'").groupBy("uuid").agg(F.count(F.lit(1)).alias("n"))


def k6_device(spark, sf_dir):
    return rounded(sinks.device_samples(I.raw_samples(spark, sf_dir), "7", 1704500000.0), "time", decimals=3)


def k9_plot_data(spark, sf_dir):
    return rounded(sinks.plot_data(I.prices(spark, sf_dir), ["flag"]), "y")


def k12_larger_first(spark, sf_dir):
    return rounded(sinks.larger_groups_first(I.rates(spark, sf_dir).select("uuid", "time2"), ["uuid"]), "time2", decimals=3)


def s8_latest_registrations(spark, sf_dir):
    """The latest registration of every user; events without a user are those of one, which stays null."""
    found = readers.latest_registrations(readers.load_registrations(I.all_registrations(spark, sf_dir)))
    return found.select("uuid", "model", "os").replace("", None)


def s10_scan(spark, sf_dir):
    return readers.scan(read_table(spark, sf_dir, "events"), equal={"event_type": "click"}, among={"user_id": [3, 7, 11]}, above={"value": 20.0}, columns=["event_id", "value"])


def s12_incremental(spark, sf_dir):
    """Three loads into one table: the earlier samples, all of them, and all of them again, which brings nothing new."""
    base = f"{shared_dir(spark)}/ohmline/loaded-{uuid.uuid4().hex}"
    samples = I.raw_samples(spark, sf_dir).select("uuid", "time")
    for rows in (samples.where("time <= 1706000000"), samples, samples):
        loaded = readers.load_incrementally(rows, f"{base}/samples", f"{base}/mark")
    mark = F.lit(readers.saved_watermark(spark, f"{base}/mark"))
    return loaded.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).select("uuid", "n", F.round(mark, 3).alias("watermark"))


def s16_replicate(spark, sf_dir):
    return readers.replicate_fleet(I.raw_samples(spark, sf_dir).select("uuid", "time"), 2).groupBy("uuid").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("time"), 3).alias("last"))


def s1_measurements(spark, sf_dir):
    m = I.measurements(spark, sf_dir)
    bad = F.col("event_type") == "error"
    line = F.concat_ws(",", F.col("num").cast("string"), F.floor("time_s").cast("string"), F.when(bad, "x").otherwise((F.col("cents") / 100).cast("string")), F.lit("4.0"))
    parsed = readers.parse_measurements(m.select("series_id", line.alias("value")), series="series_id")
    return parsed.groupBy("series_id", "bad").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("current_ma"), 2).alias("ma"))


def s6_fleet_text(spark, sf_dir):
    s = read_table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    line = F.concat_ws(", ", stamp, F.col("user_id").cast("string"), (F.col("event_id") % 101).cast("string"), F.when(F.col("event_type") == "error", "changed pluggedin").otherwise("changed unplugged"), F.lit("1;Mail"), F.lit("2;Maps"))
    return readers.parse_fleet_text(s.select(line.alias("value"))).select("uuid", F.col("time").cast("long").alias("time"), F.round("level", 2).alias("level"), "event", "state", F.array_join(readers.app_names("apps"), ",").alias("apps"))


POINTS = {
    "c1_compare_os": lambda p: compared(C.compare_os(p)), "c2_compare_model": lambda p: compared(C.compare_model(p)), "c4_similar_users": lambda p: compared(C.similar_users(p, DAEMONS)),
    "c5_hogs": lambda p: compared(C.hogs(p, DAEMONS)), "c6_bugs": lambda p: compared(C.bugs(p, DAEMONS)), "c7_skipped": lambda p: C.skipped_apps(p, DAEMONS, 100), "c8_relaxed_hogs": lambda p: compared(C.hogs(p, DAEMONS, 100, relaxed=True)),
    "c9_j_scores": c9_j_scores, "c10_correlations": c10_correlations, "c11_correlations_by_app": c11_correlations_by_app, "c14_excluding": c14_excluding, "c14_slices": c14_slices,
    "c15_ev_by_user_count": c15_ev_by_user_count, "c15_user_ev_by_user_count": c15_user_ev_by_user_count, "c18_labels": c18_labels, "k3_expire": k3_expire, "k4_remove_daemons": k4_remove_daemons,
}

QUERIES = {name: with_points(f) for name, f in POINTS.items()} | {"d20_ks_signed": ks("signed"), "d21_ks_absolute": ks("absolute"), "d22_ks_weighted": ks("weighted")} | {
    f.__name__: f
    for f in (
        p1_registration_history, p2_asof, p3_rates, p4_unabridged_rates, p5_rates_of, p6_rate_value, p7_rate_attributes, p8_plausible, p9_rejections, p10_feature_history, p11_feature_changes, p12_last_features,
        p13_current_os, p14_limit_users, p15_current_os_rates, p16_exclude_daemons, p17_samples_text, p17_registrations_text, p18_rates_text, p19_point_rates, p20_by_rate,
        d1_a_priori, d2_frequencies, d3_prob_dist, d4_expected_value, d5_equal_histogram_ev, d6_log_histogram_ev, d7_rate_ev, d8_uniform_functions, d9_discretize, d10_xmax, d11_equal_histogram, d12_range_histogram,
        d13_log_histogram, d14_normalised_log_histogram, d15_range_log_histogram, d16_bucket_coordinates, d17_cdf, d18_upper_edge_log, d19_upper_edge_equal, d23_spread, d24_normalize, d25_pearson, d26_mixture_stddev,
        d27_rounding, d28_ev_difference, d29_improvement, d30_compare_distributions, d31_evidence, d32_non_zero, c3_user_profile, c12_group_variance, c13_app_usage, c16_user_slice, k1_results, k5_delete, k6_device, k9_plot_data, k12_larger_first,
        s1_measurements, s6_fleet_text, s8_latest_registrations, s10_scan, s12_incremental, s16_replicate,
    )
}
