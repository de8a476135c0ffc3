"""From samples and registrations to drain rates.

Samples: uuid, time (s), level (0 to 1), event, state, apps, and any features. Registrations: uuid, os, model, time.
Rates: one row for each usable pair of consecutive samples of a device, a point or a uniform range in % per second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ohmline.shared import joined_on

#: States, event and models that decide whether a pair is used.
CHARGING, UNKNOWN = "charging", "unknown"
POINT_EVENTS = ("batterylevelchanged",)
TEST_MODELS = ("Simulator", "sdk")
#: Greatest plausible point rate, % per second; half a step of the battery level.
MOST_RATE = 0.04
LEVEL_STEP = 0.05


def registration_history(regs: DataFrame) -> DataFrame:
    """Registrations at which the OS of a device changed, the first included."""
    w = Window.partitionBy("uuid").orderBy("time", "os", "model")
    first = F.row_number().over(w) == 1
    return regs.withColumn("__new", first | ~F.col("os").eqNullSafe(F.lag("os").over(w))).where("__new").drop("__new")


def asof_os_model(samples: DataFrame, regs: DataFrame) -> DataFrame:
    """``samples`` with ``os, model`` of the latest registration up to their time, else of the earliest one.

    A device without registrations gets nulls. Of registrations at one time, the one that sorts last counts.
    """
    side = regs.select("uuid", "time", F.struct("os", "model").alias("__reg"), F.lit(0).alias("__side"))
    rows = samples.select(*[c for c in samples.columns if c.lower() not in ("os", "model")]).withColumn("__side", F.lit(1))
    both = rows.unionByName(side, allowMissingColumns=True)
    w = Window.partitionBy("uuid").orderBy("time", "__side", F.col("__reg").asc_nulls_first())
    upto = F.last("__reg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    earliest = F.first("__reg", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = both.withColumn("__at", F.coalesce(upto, earliest)).where("__side = 1")
    return found.select(*[c for c in rows.columns if c != "__side"], F.col("__at.os").alias("os"), F.col("__at.model").alias("model"))


def classified_pairs(
    samples: DataFrame,
    *,
    plausible: bool = True,
    excluded_models: Sequence[str] = TEST_MODELS,
    exclude_unknown: bool = True,
    point_events: Sequence[str] = POINT_EVENTS,
    both_points: bool = True,
) -> DataFrame:
    """Every pair of consecutive samples of a device at different times, with ``reject_reason`` (null: usable).

    The reasons, in the order they are looked for: model, charging, negative drain, all zero, no level (either is null),
    and with ``plausible`` also zero drain and abandoned (a point rate above ``MOST_RATE``). If the samples have ``features``, a
    map, a pair has those of both: each key with the values of either, once.
    """
    w = Window.partitionBy("uuid").orderBy("time", "event", "level")
    features = ["features"] if "features" in samples.columns else []
    before = F.struct("time", "level", "event", "state", "apps", *features)
    pairs = samples.withColumn("__p", F.lag(before).over(w)).where("__p is not null and __p.time <> time")
    p = lambda name: F.col(f"__p.{name}")
    is_event = lambda c: F.lower(c).isin(*point_events)
    point = is_event(p("event")) & is_event(F.col("event")) if both_points else is_event(F.col("event"))
    took = F.col("time") - p("time")
    drained = p("level") - F.col("level")
    bad_states = [CHARGING, UNKNOWN] if exclude_unknown else [CHARGING]
    charging = p("state").isin(*bad_states) | F.col("state").isin(*bad_states)
    rate = point_rate(p("level"), F.col("level"), took)
    reason = (
        F.when(F.coalesce(F.col("model").isin(*excluded_models), F.lit(False)), "model")
        .when(charging, "charging")
        .when(drained < 0, "negative drain")
        .when((p("level") == 0) & (F.col("level") == 0), "all zero")
        .when(drained.isNull(), "no level")
    )
    if plausible:
        reason = reason.when(point & (rate == 0), "zero drain").when(point & (rate > MOST_RATE), "abandoned")
    low, high = range_rate(p("level"), F.col("level"), took)
    return pairs.select(
        "uuid",
        "os",
        "model",
        p("time").alias("time1"),
        F.col("time").alias("time2"),
        p("level").alias("level1"),
        F.col("level").alias("level2"),
        F.array_distinct(F.concat(F.split(p("event"), " "), F.split(F.col("event"), " "))).alias("events"),
        F.array_distinct(F.concat(F.coalesce(p("apps"), F.array()), F.coalesce("apps", F.array()))).alias("apps"),
        *[merged_features(listed_features(samples, p(f)), listed_features(samples, F.col(f))).alias(f) for f in features],
        F.when(point, rate).otherwise((low + high) / 2).alias("rate"),
        F.when(~point, low).alias("rate_lo"),
        F.when(~point, high).alias("rate_hi"),
        reason.alias("reject_reason"),
    )


def pairwise_rates(samples: DataFrame, **options) -> DataFrame:
    """Rates of the usable pairs."""
    return classified_pairs(samples, **options).where("reject_reason is null").drop("reject_reason")


def unabridged_rates(samples: DataFrame) -> DataFrame:
    """Rates without the plausibility rules: simulators and charging are left out, one event of the kind makes a point."""
    return pairwise_rates(samples, plausible=False, excluded_models=("Simulator",), exclude_unknown=False, both_points=False)


def rates_of(samples: DataFrame, uuid: str, os: str, model: str) -> DataFrame:
    """Rates of one device under a given OS and model; only charging pairs are left out."""
    one = samples.where(F.col("uuid") == uuid).withColumns({"os": F.lit(os), "model": F.lit(model)})
    return pairwise_rates(one, plausible=False, excluded_models=("",), exclude_unknown=False)


def point_rate(level1: Column, level2: Column, took: Column) -> Column:
    return (level1 - level2) * 100 / took


def range_rate(level1: Column, level2: Column, took: Column) -> tuple[Column, Column]:
    """Bounds of the rate if the levels are known to half a step of the other."""
    drained = level1 - level2
    low = F.when(drained.isNotNull(), F.greatest((drained - LEVEL_STEP) * 100 / took, F.lit(0.0)))
    return low, (drained + LEVEL_STEP) * 100 / took


def plausible_rates(rates: DataFrame, most: float = MOST_RATE) -> DataFrame:
    """Ranges, and point rates above 0 and up to ``most``."""
    return rates.where(F.col("rate_lo").isNotNull() | ((F.col("rate") > 0) & (F.col("rate") <= most)))


def rejection_counts(pairs: DataFrame) -> DataFrame:
    """How many classified pairs there are of each reason; usable points and ranges apart."""
    kind = F.coalesce("reject_reason", F.when(F.col("rate_lo").isNull(), "point").otherwise("range"))
    return pairs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def merged_features(left: Column, right: Column) -> Column:
    """Per key, the values of both maps of string arrays, each once."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(left, right, lambda _, a, b: F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def listed_features(samples: DataFrame, features: Column) -> Column:
    """A map of features with lists of texts as values; null counts as empty."""
    kind = samples.schema["features"].dataType.valueType.simpleString()
    listed = features if kind.startswith("array") else F.transform_values(features, lambda _, v: F.array(v.cast("string")))
    return F.coalesce(listed, F.create_map().cast("map<string,array<string>>"))


def feature_history(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """(uuid, feature, time, value) wherever the value of a feature differs from the device's sample before that has it.

    Features are the named columns, arrays as their sorted values, and every key of the map ``features``, if there is one.
    """
    as_text = [F.concat_ws(" ", F.sort_array(c)) if dict(samples.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in features]
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.array(*as_text).alias("value")))
    long = samples.select("uuid", "time", pairs.alias("__f")).select("uuid", "time", F.col("__f.feature").alias("feature"), F.col("__f.value").alias("value"))
    if "features" in samples.columns:
        extra = samples.select("uuid", "time", F.explode(listed_features(samples, F.col("features"))).alias("feature", "value"))
        long = long.unionByName(extra.withColumn("value", F.concat_ws(" ", F.sort_array("value"))))
    w = Window.partitionBy("uuid", "feature").orderBy("time", "value")
    changed = (F.row_number().over(w) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(w))
    return long.withColumn("__new", changed).where("__new").drop("__new")


def feature_change_pairs(history: DataFrame) -> DataFrame:
    """Distinct (feature, before, after) of consecutive values of a device."""
    w = Window.partitionBy("uuid", "feature").orderBy("time", "value")
    moved = history.withColumn("before", F.lag("value").over(w)).where("before is not null")
    return moved.select("feature", "before", F.col("value").alias("after")).distinct()


def last_features(history: DataFrame, models: DataFrame) -> DataFrame:
    """Latest value of each feature of each device, with the device's model."""
    last = history.groupBy("uuid", "feature").agg(F.max_by("value", F.struct("time", "value")).alias("value"))
    return last.join(models.select("uuid", "model"), "uuid", "left")


def current_os_model(rates: DataFrame) -> DataFrame:
    """OS and model of each device at its latest rate."""
    last = F.max_by(F.struct("os", "model"), F.struct("time2", "time1", "os", "model"))
    return rates.groupBy("uuid").agg(last.alias("__l")).select("uuid", F.col("__l.os").alias("os"), F.col("__l.model").alias("model"))


def limit_users(rates: DataFrame, n: int) -> DataFrame:
    """Rates of the first ``n`` devices in lexical order."""
    return rates.join(rates.select("uuid").distinct().orderBy("uuid").limit(n), "uuid", "left_semi")


def current_os_rates(rates: DataFrame) -> DataFrame:
    """Rates of each device under its current OS, which may be unknown (null)."""
    return joined_on(rates, current_os_model(rates).select("uuid", "os"), ["uuid", "os"], "left_semi")


def no_daemon(app: Column, names: Sequence[str]) -> Column:
    """Whether an app is on no name list; a name that ends in ``*`` is a prefix. A null is on none."""
    keep = ~app.isin([n for n in names if not n.endswith("*")])
    for prefix in (n[:-1] for n in names if n.endswith("*")):
        keep = keep & ~app.startswith(prefix)
    return keep | app.isNull()


def exclude_daemons(apps: DataFrame, names: Sequence[str], *, app: str = "app") -> DataFrame:
    """Rows whose app is no daemon."""
    return apps.where(no_daemon(F.col(app), names))


def point_rates(rates: DataFrame) -> DataFrame:
    """Rates that are no ranges, in order of time."""
    return rates.where("rate_lo is null").orderBy("time1", "uuid")


def by_rate(rates: DataFrame) -> DataFrame:
    return rates.orderBy("rate")


def samples_text(samples: DataFrame) -> DataFrame:
    """One line for each sample: its scalars, its apps, then its features, those of one value apart from lists."""
    parts = ["uuid", F.col("time").cast("string"), F.col("level").cast("string"), "event", "state", F.concat_ws(" ", F.sort_array("apps"))]
    if "features" in samples.columns:
        entries = F.array_sort(F.map_entries(listed_features(samples, F.col("features"))))
        single = F.transform(F.filter(entries, lambda e: F.size(e["value"]) == 1), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"][0], F.lit(""))))
        lists = F.transform(F.filter(entries, lambda e: F.size(e["value"]) != 1), lambda e: F.concat(e["key"], F.lit("=["), F.concat_ws(" ", F.sort_array(e["value"])), F.lit("]")))
        parts += [F.when(F.size(x) > 0, F.concat_ws(" ", x)) for x in (single, lists)]
    return samples.select(F.concat_ws(", ", *parts).alias("line")).orderBy("line")


def registrations_text(regs: DataFrame) -> DataFrame:
    return regs.select(F.concat_ws(", ", "uuid", "model", "os", F.col("time").cast("string")).alias("line")).orderBy("line")


def rates_text(rates: DataFrame) -> DataFrame:
    """One line for each rate, in order of device and end time."""
    number = lambda c: F.format_string("%.6f", c)
    span = F.when(F.col("rate_lo").isNull(), number("rate")).otherwise(F.concat(number("rate_lo"), F.lit(".."), number("rate_hi")))
    return rates.orderBy("uuid", "time2").select("uuid", "time2", F.concat_ws(" ", "uuid", "os", "model", span, F.concat_ws(",", F.sort_array("apps"))).alias("line"))
