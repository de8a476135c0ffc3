"""Inputs of the registered queries, derived from the given tables, and the same derivations as SQL.

``MEASUREMENTS``, ``LOGS``, ``SAMPLES``, ``REGS`` and so on are common table expressions over ``events`` that
mirror, column by column, what the functions of this module make with Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.operators import rates as R
from ohmline.shared import cut, read_table

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of powers for each user: num from 1, seconds, whole cents, amount."""
    events = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("series_id"),
        F.row_number().over(w).cast("long").alias("num"),
        (F.expr(MICROS) / 1e6).alias("time_s"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "value",
        "event_type",
        "ts",
        "event_id",
    )


MEASUREMENTS = """m AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num, epoch_us(ts) / 1e6 AS time_s,
         round(value * 100)::BIGINT AS cents, value, event_type, ts, event_id FROM events)"""


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long series with a dense order."""
    events = read_table(spark, sf_dir, "events")
    return events.select(F.lit(0).alias("series_id"), F.col("event_id").alias("num"), (F.expr(MICROS) / 1e6).alias("time_s"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")


ONE_SERIES = "m AS (SELECT 0 AS series_id, event_id AS num, epoch_us(ts) / 1e6 AS time_s, round(value * 100)::BIGINT AS cents, event_type FROM events)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: the user is the node, a view carries no tag, props are the text."""
    events = read_table(spark, sf_dir, "events")
    return events.select(
        F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")).alias("tag"),
        F.date_format("ts", "yyyy.MM.dd").alias("date"),
        F.col("user_id").alias("node"),
        F.date_format("ts", "MMM").alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.col("props").alias("rest"),
        F.col("event_id").alias("pos"),
    )


LOGS = """l AS (
  SELECT CASE WHEN event_type = 'view' THEN '-' ELSE event_type END AS tag, strftime(ts, '%Y.%m.%d') AS date, user_id AS node,
         strftime(ts, '%b') AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, props AS rest, event_id AS pos FROM events)"""


def all_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registration of each user and week of the events."""
    events = read_table(spark, sf_dir, "events").withColumn("t", F.expr(MICROS) / 1e6)
    week = F.floor(F.col("t") / 604800)
    weeks = events.groupBy("user_id", week.alias("week")).agg(F.min("t").alias("time"))
    return weeks.select(F.col("user_id").cast("string").alias("uuid"), F.concat(F.lit("v"), (F.col("week") % 4).cast("string")).alias("os"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), "time")


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrations that samples meet: one user in thirteen has none."""
    return all_registrations(spark, sf_dir).where("cast(uuid as long) % 13 <> 4")


REGS = """g AS (
  SELECT user_id::VARCHAR AS uuid, 'v' || (week % 4)::VARCHAR AS os, 'm' || (user_id % 7)::VARCHAR AS model, time
  FROM (SELECT user_id, floor(epoch_us(ts) / 1e6 / 604800)::BIGINT AS week, min(epoch_us(ts) / 1e6) AS time FROM events WHERE user_id % 13 <> 4 GROUP BY ALL))"""
ALL_REGS = REGS.replace(" WHERE user_id % 13 <> 4", "")


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as battery samples of devices, with three app names each; one in nineteen has no level."""
    events = read_table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    app = lambda c, n: F.concat(F.lit("app"), (c % n).cast("string"))
    return events.select(
        F.col("user_id").cast("string").alias("uuid"),
        (F.expr(MICROS) / 1e6).alias("time"),
        F.when(F.col("event_id") % 19 != 6, cents % 101 / F.lit(100.0)).alias("level"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "batterylevelchanged").otherwise("screen on").alias("event"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "charging").otherwise("unplugged").alias("state"),
        F.array_distinct(F.array(app(F.col("event_id"), 23), app(F.col("user_id"), 11), app(cents, 7))).alias("apps"),
        F.map_filter(
            F.create_map(F.lit("kind"), F.array("event_type"), F.lit("wifi"), F.array(F.concat(F.lit("net"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("net"), (F.col("event_id") % 5).cast("string")))),
            lambda k, _: (k == "kind") | (F.col("event_id") % 4 > 0),
        ).alias("features"),
    )


SAMPLES = """s AS (
  SELECT user_id::VARCHAR AS uuid, epoch_us(ts) / 1e6 AS time, CASE WHEN event_id % 19 <> 6 THEN (round(value * 100)::BIGINT % 101) / 100.0::DOUBLE END AS level,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'batterylevelchanged' ELSE 'screen on' END AS event,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'charging' ELSE 'unplugged' END AS state,
         list_sort(list_distinct(['app' || (event_id % 23)::VARCHAR, 'app' || (user_id % 11)::VARCHAR, 'app' || (round(value * 100)::BIGINT % 7)::VARCHAR])) AS apps,
        [event_type] AS kind, CASE WHEN event_id % 4 > 0 THEN list_sort(['net' || (event_id % 3)::VARCHAR, 'net' || (event_id % 5)::VARCHAR]) END AS wifi
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.asof_os_model(raw_samples(spark, sf_dir), registrations(spark, sf_dir))


ASOF = f"""{REGS}, {SAMPLES}, a AS (
  SELECT s.*, coalesce(
           (SELECT max_by(g.os, g.time) FROM g WHERE g.uuid = s.uuid AND g.time <= s.time),
           (SELECT min_by(g.os, g.time) FROM g WHERE g.uuid = s.uuid)) AS os,
         (SELECT any_value(g.model) FROM g WHERE g.uuid = s.uuid) AS model FROM s)"""

PAIRS = ASOF + """, q AS (
  SELECT uuid, os, model, lag(time) OVER w AS time1, time AS time2, lag(level) OVER w AS level1, level AS level2, lag(event) OVER w AS event1, event AS event2,
         lag(state) OVER w AS state1, state AS state2, lag(apps) OVER w AS apps1, apps AS apps2,
         lag(kind) OVER w AS kind1, kind AS kind2, lag(wifi) OVER w AS wifi1, wifi AS wifi2
  FROM a WINDOW w AS (PARTITION BY uuid ORDER BY time, event, level)
), p AS (
  SELECT *, (level1 - level2) * 100 / (time2 - time1) AS drain, event1 = 'batterylevelchanged' AND event2 = 'batterylevelchanged' AS point,
         CASE WHEN level1 - level2 IS NOT NULL THEN greatest(((level1 - level2) - 0.05) * 100 / (time2 - time1), 0) END AS lo, ((level1 - level2) + 0.05) * 100 / (time2 - time1) AS hi
  FROM q WHERE time1 IS NOT NULL AND time1 <> time2
), c AS (
  SELECT *, CASE WHEN model IN ('Simulator', 'sdk') THEN 'model' WHEN state1 IN ('charging', 'unknown') OR state2 IN ('charging', 'unknown') THEN 'charging'
                 WHEN level1 - level2 < 0 THEN 'negative drain' WHEN level1 = 0 AND level2 = 0 THEN 'all zero' WHEN level1 IS NULL OR level2 IS NULL THEN 'no level'
                 WHEN point AND drain = 0 THEN 'zero drain' WHEN point AND drain > 0.04 THEN 'abandoned' END AS reject_reason FROM p
), r AS (
  SELECT uuid, os, model, time1, time2, level1, level2, list_sort(list_distinct(list_concat(apps1, apps2))) AS apps,
         CASE WHEN point THEN drain ELSE (lo + hi) / 2 END AS rate, CASE WHEN NOT point THEN lo END AS rate_lo, CASE WHEN NOT point THEN hi END AS rate_hi,
         uuid || '@' || time2::VARCHAR AS rate_id
  FROM c WHERE reject_reason IS NULL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classified_pairs(samples(spark, sf_dir))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs(spark, sf_dir).where("reject_reason is null").drop("reject_reason")
    return found.withColumn("rate_id", F.xxhash64("uuid", "time1", "time2"))


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rates with mass and mean, and the a-priori distribution, written once, as they are read often.

    Comparisons use no features and events, so these do not go through the windows and joins that make the rates.
    """
    plain = R.asof_os_model(raw_samples(spark, sf_dir).drop("features"), registrations(spark, sf_dir))
    found = R.pairwise_rates(plain).withColumn("rate_id", F.xxhash64("uuid", "time1", "time2"))
    kept = cut(found.drop("events", "level1", "level2"))
    prior = cut(D.a_priori(kept))
    return cut(D.rate_points(kept, prior)), prior


PRIOR = PAIRS + ", ap AS (SELECT rate AS x, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM r WHERE rate_lo IS NULL GROUP BY rate)"

POINTS = PRIOR + """, sl AS (SELECT r.rate_id, sum(ap.n) AS slice, sum(ap.n * ap.x) AS sx FROM r JOIN ap ON ap.x >= r.rate_lo AND ap.x < r.rate_hi GROUP BY r.rate_id),
pt AS (SELECT r.*, slice, CASE WHEN rate_lo IS NULL OR slice > 0 THEN 1 ELSE 0 END AS mass, CASE WHEN rate_lo IS NULL THEN rate WHEN slice > 0 THEN sx / slice ELSE 0 END AS mean
       FROM r LEFT JOIN sl USING (rate_id)),
cu AS (SELECT uuid, max_by(os, time2) AS os FROM r GROUP BY uuid)"""

FREQS = POINTS + """, fq AS (
  SELECT rate_id, uuid, os, model, apps, rate AS x, 1.0::DOUBLE AS w FROM pt WHERE rate_lo IS NULL
  UNION ALL SELECT rate_id, uuid, os, model, apps, ap.x, ap.n / slice FROM pt JOIN ap ON ap.x >= rate_lo AND ap.x < rate_hi WHERE slice > 0)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of whole thousands of the extended price, by return flag."""
    items = read_table(spark, sf_dir, "lineitem")
    freqs = items.groupBy(F.col("l_returnflag").alias("flag"), F.ceil(F.col("l_extendedprice") / 1000).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("w"))
    return D.prob_dist(freqs, ["flag"])


PRICES = """d AS (SELECT flag, x, w / sum(w) OVER (PARTITION BY flag) AS p
  FROM (SELECT l_returnflag AS flag, ceil(l_extendedprice / 1000)::DOUBLE AS x, count(*) AS w FROM lineitem GROUP BY ALL))"""
