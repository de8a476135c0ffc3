"""Registered queries over ordered series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmline.operators import segments as G
from ohmline.operators import series as S
from ohmline.plans import standins as I
from ohmline.shared import ship

ship(__name__)

THRESHOLD, WINDOW, CHUNK = 6000, 5, 4096


def rounded(df: DataFrame, *names: str, decimals: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, decimals) for n in names})


RUNS = """, act AS (
  SELECT *, count(*) OVER w5 = 5 AND sum(cents) OVER w5 >= 30000 AS active FROM m
  WINDOW w5 AS (PARTITION BY series_id ORDER BY num ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
), ris AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY series_id ORDER BY num), false) AS rises FROM act),
ids AS (SELECT *, sum(rises::INT) OVER (PARTITION BY series_id ORDER BY num) AS rid FROM ris),
bounds AS (SELECT series_id, rid AS run_id, min(num) - 4 AS a, max(num) AS b FROM ids WHERE active GROUP BY series_id, rid),
runs AS (SELECT m.*, run_id FROM bounds JOIN m ON m.series_id = bounds.series_id AND m.num BETWEEN a AND b)"""


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.detect_runs(I.measurements(spark, sf_dir), THRESHOLD, WINDOW, power="cents")


def r1_detect_runs(spark, sf_dir):
    return runs_of(spark, sf_dir).groupBy("series_id", "run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


R1_SQL = f"WITH {I.MEASUREMENTS}{RUNS} SELECT series_id, run_id::BIGINT AS run_id, min(num) AS first_num, max(num) AS last_num, count(*) AS n, sum(cents)::BIGINT AS cents FROM runs GROUP BY ALL"


def r1_detect_runs_long_series(spark, sf_dir):
    found = G.detect_runs(I.one_series(spark, sf_dir), 7000, WINDOW, power="cents", chunk_rows=CHUNK)
    return found.groupBy("run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.count(F.lit(1)).alias("n"))


R1_LONG_SQL = f"WITH {I.ONE_SERIES}{RUNS.replace('30000', '35000')} SELECT run_id::BIGINT AS run_id, min(num) AS first_num, max(num) AS last_num, count(*) AS n FROM runs GROUP BY ALL"


def r2_detect_runs_with(spark, sf_dir):
    make = lambda: G.MovingAverageDetector(THRESHOLD, WINDOW, lambda row: row.cents)
    found = G.detect_runs_with(I.measurements(spark, sf_dir).select("series_id", "num", "cents"), make)
    return found.groupBy("series_id", "run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.sum("cents").alias("cents"))


R2_SQL = f"WITH {I.MEASUREMENTS}{RUNS} SELECT series_id, run_id::BIGINT AS run_id, min(num) AS first_num, max(num) AS last_num, sum(cents)::BIGINT AS cents FROM runs GROUP BY ALL"


def r1_wide_window(spark, sf_dir):
    """Runs under a window of 2,500 rows, as captures at 5 kHz have them: their first and last active rows."""
    found = G.detect_runs(I.one_series(spark, sf_dir), WIDE_THRESHOLD, 2500, power="cents", chunk_rows=CHUNK)
    return found.groupBy("run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


WIDE_THRESHOLD = 5000
R1_WIDE_SQL = f"""WITH {I.ONE_SERIES}, act AS (
  SELECT *, row_number() OVER (ORDER BY num) AS k, count(*) OVER w = 2500 AND sum(cents) OVER w >= {WIDE_THRESHOLD * 2500} AS active FROM m WINDOW w AS (ORDER BY num ROWS BETWEEN 2499 PRECEDING AND CURRENT ROW)
), ris AS (SELECT *, active AND NOT coalesce(lag(active) OVER (ORDER BY k), false) AS rises FROM act),
ids AS (SELECT *, sum(rises::INT) OVER (ORDER BY k) AS rid FROM ris),
bounds AS (SELECT rid AS run_id, min(k) - 2499 AS a, max(k) AS b FROM ids WHERE active GROUP BY rid)
SELECT run_id::BIGINT AS run_id, min(num) AS first_num, max(num) AS last_num, count(*) AS n, sum(cents)::BIGINT AS cents FROM bounds JOIN act ON k BETWEEN a AND b GROUP BY run_id"""


def r2_detect_runs_with_long_series(spark, sf_dir):
    make = lambda: G.MovingAverageDetector(7000, WINDOW, lambda row: row.cents)
    found = G.detect_runs_with(I.one_series(spark, sf_dir).select("series_id", "num", "cents"), make, chunk_rows=CHUNK)
    return found.groupBy("run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.count(F.lit(1)).alias("n"))


def r6_bucket_with_long_series(spark, sf_dir):
    found = G.bucket_with(I.one_series(spark, sf_dir).select("series_id", "num", "event_type"), lambda: G.KeyChangeDetector(lambda row: row.event_type), chunk_rows=CHUNK)
    return found.groupBy("bucket_id").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("num").alias("first_num"))


def r3_detect_runs_tuples(spark, sf_dir):
    tuples = I.measurements(spark, sf_dir).select("series_id", F.col("num").alias("n"), F.col("time_s").alias("s"), (F.col("cents") / 100).alias("ma"), F.lit(100.0).alias("v"))
    found = G.detect_runs(tuples, float(THRESHOLD), WINDOW, order="n", power=F.round(F.col("ma") * F.col("v")))
    return found.groupBy("series_id").agg(F.count_distinct("run_id").alias("runs"), F.count(F.lit(1)).alias("n_rows"))


R3_SQL = f"WITH {I.MEASUREMENTS}{RUNS} SELECT series_id, count(DISTINCT run_id) AS runs, count(*) AS n_rows FROM runs GROUP BY ALL"

ISLANDS = """, t AS (SELECT *, num > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY series_id ORDER BY num) AS turn FROM m),
b AS (SELECT *, sum(turn::INT) OVER (PARTITION BY series_id ORDER BY num) AS bucket_id FROM t)"""


def r4_bucket_consecutive(spark, sf_dir):
    found = G.bucket_consecutive(I.measurements(spark, sf_dir), ["event_type"])
    return found.groupBy("series_id", "bucket_id").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


R4_SQL = f"WITH {I.MEASUREMENTS}{ISLANDS} SELECT series_id, bucket_id::BIGINT AS bucket_id, any_value(event_type) AS event_type, count(*) AS n FROM b GROUP BY ALL"


def r4_bucket_long_series(spark, sf_dir):
    found = G.bucket_consecutive(I.one_series(spark, sf_dir), ["event_type"], chunk_rows=CHUNK)
    return found.groupBy("bucket_id").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("num").alias("first_num"))


R4_LONG_SQL = f"WITH {I.ONE_SERIES}{ISLANDS.replace('num > 1', 'num > 0')} SELECT bucket_id::BIGINT AS bucket_id, any_value(event_type) AS event_type, count(*) AS n, min(num) AS first_num FROM b GROUP BY ALL"

HOURS = """, t AS (SELECT *, num > 1 AND (day(ts), hour(ts)) IS DISTINCT FROM lag((day(ts), hour(ts))) OVER (PARTITION BY series_id ORDER BY num) AS turn FROM m),
b AS (SELECT *, sum(turn::INT) OVER (PARTITION BY series_id ORDER BY num) AS bucket_id FROM t)"""


def r5_hour_buckets(spark, sf_dir):
    return G.hour_buckets(I.measurements(spark, sf_dir)).groupBy("series_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


R5_SQL = f"WITH {I.MEASUREMENTS}{HOURS} SELECT series_id, bucket_id::BIGINT AS bucket_id, count(*) AS n, sum(cents)::BIGINT AS cents FROM b GROUP BY ALL"


def r6_bucket_with(spark, sf_dir):
    found = G.bucket_with(I.measurements(spark, sf_dir).select("series_id", "num", "event_type"), lambda: G.KeyChangeDetector(lambda row: row.event_type))
    return found.groupBy("series_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"))


R6_SQL = f"WITH {I.MEASUREMENTS}{ISLANDS} SELECT series_id, bucket_id::BIGINT AS bucket_id, count(*) AS n FROM b GROUP BY ALL"


def r7_time_buckets(spark, sf_dir):
    return G.time_buckets(I.measurements(spark, sf_dir)).groupBy("series_id").agg(F.count_distinct("bucket_id").alias("buckets"), F.count(F.lit(1)).alias("n_rows"))


R7_SQL = f"WITH {I.MEASUREMENTS}{HOURS} SELECT series_id, count(DISTINCT bucket_id) AS buckets, count(*) AS n_rows FROM b GROUP BY ALL"


def r8_run_energy(spark, sf_dir):
    found = G.run_energy(runs_of(spark, sf_dir), power="cents", step=7200.0, tolerance=7200.0)
    return rounded(found, "start_s", "end_s", "watt_hours")


R8_SQL = f"""WITH {I.MEASUREMENTS}{RUNS}, st AS (SELECT *, coalesce(time_s - lag(time_s) OVER (PARTITION BY series_id, run_id ORDER BY num) BETWEEN 0 AND 14400, false) AS ok FROM runs)
SELECT series_id, run_id::BIGINT AS run_id, round(min(time_s), 6) AS start_s, round(max(time_s), 6) AS end_s, sum(ok::INT) * 7200.0::DOUBLE AS duration_s,
       round(sum(CASE WHEN ok THEN cents ELSE 0 END)::DOUBLE * 7200.0 / 1000 / 3600, 6) AS watt_hours FROM st GROUP BY series_id, run_id"""


def r9_total_energy(spark, sf_dir):
    return rounded(S.total_energy(I.measurements(spark, sf_dir), power="cents"), "mwh")


R9_SQL = f"WITH {I.MEASUREMENTS} SELECT series_id, round(sum(cents)::DOUBLE / 5000 / 3600, 6) AS mwh FROM m GROUP BY series_id"


def r10_find_gaps(spark, sf_dir):
    return rounded(S.find_gaps(I.measurements(spark, sf_dir), step=36000.0, tolerance=36000.0), "from_s", "to_s", "step_s", decimals=3)


R10_SQL = f"""WITH {I.MEASUREMENTS}, g AS (SELECT series_id, lag(time_s) OVER (PARTITION BY series_id ORDER BY num) AS f, time_s AS t FROM m)
SELECT series_id, round(f, 3) AS from_s, round(t, 3) AS to_s, round(t - f, 3) AS step_s FROM g WHERE abs(t - f - 36000.0) > 36000.0"""


def r11_checkpoint_runs(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).withColumn("time_s", F.col("time_s") - 1704067200)
    return rounded(S.detect_runs_by_checkpoint(rows, 5000.0, 100000.0, power="cents", interval=43200.0, shortest=43200.0), "start_s", "end_s", "duration_s", "watt_hours", decimals=3)


def r12_checkpoint_runs_list(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).withColumn("time_s", F.col("time_s") - 1704067200)
    return rounded(S.detect_runs_by_checkpoint(rows, 5000.0, [50000.0, 150000.0, 100000.0], power="cents", interval=43200.0, shortest=43200.0), "start_s", "end_s", "duration_s", "watt_hours", decimals=3)


def checkpoint_sql(least: str) -> str:
    """The fold over checkpoints as a recursion over their numbers; ``least`` is in terms of the runs found so far."""
    return f"""WITH RECURSIVE {I.MEASUREMENTS}, x AS (SELECT series_id, num, time_s - 1704067200 AS t, cents, coalesce(lag(cents) OVER w * (time_s - lag(time_s) OVER w), 0) AS work FROM m WINDOW w AS (PARTITION BY series_id ORDER BY num)),
sl AS (SELECT series_id, floor(t / 43200) AS slot, avg(cents) < 5000 AS idle, sum(work) AS work, min(t) AS f, max(t) AS last_t FROM x GROUP BY ALL),
mk AS (SELECT *, lead(f) OVER w AS e, row_number() OVER w AS k, count(*) OVER (PARTITION BY series_id) AS n FROM sl WINDOW w AS (PARTITION BY series_id ORDER BY slot)),
st AS (
  SELECT series_id, 0::BIGINT AS k, 0.0::DOUBLE AS began, 0.0::DOUBLE AS work, 0 AS found, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::DOUBLE AS done FROM mk WHERE k = 1
  UNION ALL
  SELECT st.series_id, mk.k, CASE WHEN marks AND (short OR emits) THEN mk.e ELSE st.began END, CASE WHEN marks AND (short OR emits) THEN 0 ELSE st.work + mk.work END, st.found + (marks AND emits)::INT,
         CASE WHEN marks AND emits THEN st.began END, CASE WHEN marks AND emits THEN mk.e END, CASE WHEN marks AND emits THEN st.work + mk.work END
  FROM st JOIN mk ON mk.series_id = st.series_id AND mk.k = st.k + 1, LATERAL (SELECT mk.idle AND mk.e IS NOT NULL AND mk.e > st.began AS marks, mk.e <= st.began + 43200 AS short, mk.e > st.began + 43200 AND mk.e > st.began + {least} AS emits)
)
SELECT series_id, round(s, 3) AS start_s, round(e, 3) AS end_s, round(e - s, 3) AS duration_s, round(done / 1000 / 3600, 3) AS watt_hours, false AS is_tail FROM st WHERE s IS NOT NULL
UNION ALL SELECT st.series_id, round(began, 3), round(last_t, 3), round(last_t - began, 3), round(st.work / 1000 / 3600, 3), true FROM st JOIN mk ON mk.series_id = st.series_id AND mk.k = st.k WHERE mk.k = mk.n"""


R11_SQL = checkpoint_sql("100000")
R12_SQL = checkpoint_sql("CASE st.found WHEN 0 THEN 50000 WHEN 1 THEN 150000 ELSE 100000 END")


def long_series(spark, sf_dir):
    return I.one_series(spark, sf_dir).withColumn("time_s", F.col("time_s") - 1704067200)


def r13_integrate_long_series(spark, sf_dir):
    return rounded(S.integrate_power(long_series(spark, sf_dir), power="cents", ends="event_type = 'error'", chunk_rows=CHUNK), "duration_s", "watt_hours", decimals=2)


def r10_gaps_long_series(spark, sf_dir):
    return rounded(S.find_gaps(long_series(spark, sf_dir), step=300.0, tolerance=300.0, chunk_rows=CHUNK), "from_s", "to_s", "step_s", decimals=3)


def r14_downsample_long_series(spark, sf_dir):
    return rounded(S.downsample_by_count(long_series(spark, sf_dir), 8, power="cents", chunk_rows=CHUNK), "time_s", "mw", decimals=2)


def r17_battery_curve_long_series(spark, sf_dir):
    return rounded(S.battery_curve(long_series(spark, sf_dir), 1e9, 100.0, span=10, current="cents", chunk_rows=CHUNK), "end_s", "level", decimals=2)


LONG = I.ONE_SERIES.replace("epoch_us(ts) / 1e6", "epoch_us(ts) / 1e6 - 1704067200")
LONG_SQL = {
    "r13_integrate_long_series": f"""WITH {LONG}, x AS (
  SELECT series_id, time_s, coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment,
         coalesce(lag(time_s) OVER w, time_s) AS f, lag(cents) OVER w * (time_s - lag(time_s) OVER w) AS work FROM m WINDOW w AS (PARTITION BY series_id ORDER BY num))
SELECT series_id, segment::BIGINT AS segment, round(max(time_s) - min(f), 2) AS duration_s, round(coalesce(sum(work), 0) / 1000 / 3600, 2) AS watt_hours FROM x GROUP BY series_id, segment""",
    "r10_gaps_long_series": f"WITH {LONG}, g AS (SELECT series_id, lag(time_s) OVER (ORDER BY num) AS f, time_s AS t FROM m) SELECT series_id, round(f, 3) AS from_s, round(t, 3) AS to_s, round(t - f, 3) AS step_s FROM g WHERE abs(t - f - 300.0) > 300.0",
    "r14_downsample_long_series": f"WITH {LONG}, z AS (SELECT *, (row_number() OVER (ORDER BY num) - 1) // 8 AS block FROM m) SELECT series_id, block, count(*) AS n, round(avg(time_s), 2) AS time_s, round(avg(cents), 2) AS mw FROM z GROUP BY series_id, block",
    "r17_battery_curve_long_series": f"""WITH {LONG}, bl AS (SELECT series_id, block, max_by(time_s, num) AS end_s, sum(cents) AS ma FROM (SELECT *, (row_number() OVER (ORDER BY num) - 1) // 10 AS block FROM m) GROUP BY series_id, block),
us AS (SELECT *, (end_s - coalesce(lag(end_s) OVER (ORDER BY block), 0)) * ma / 10 / 3600 AS used FROM bl)
SELECT series_id, block, round(end_s, 2) AS end_s, round((1e9 - sum(used) OVER (ORDER BY block)) / 1e9 * 100, 2) AS level FROM us""",
}


def r13_integrate_power(spark, sf_dir):
    return rounded(S.integrate_power(I.measurements(spark, sf_dir), power="cents", ends="event_type = 'error'"), "duration_s", "watt_hours", decimals=3)


R13_SQL = f"""WITH {I.MEASUREMENTS}, x AS (
  SELECT series_id, time_s, coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment,
         coalesce(lag(time_s) OVER w, time_s) AS f, lag(cents) OVER w * (time_s - lag(time_s) OVER w) AS work FROM m WINDOW w AS (PARTITION BY series_id ORDER BY num))
SELECT series_id, segment::BIGINT AS segment, round(max(time_s) - min(f), 3) AS duration_s, round(coalesce(sum(work), 0) / 1000 / 3600, 3) AS watt_hours FROM x GROUP BY series_id, segment"""


def r14_downsample(spark, sf_dir):
    return rounded(S.downsample_by_count(I.measurements(spark, sf_dir), 8, power="cents"), "time_s", "mw", decimals=3)


R14_SQL = f"WITH {I.MEASUREMENTS} SELECT series_id, (num - 1) // 8 AS block, count(*) AS n, round(avg(time_s), 3) AS time_s, round(avg(cents), 3) AS mw FROM m GROUP BY series_id, (num - 1) // 8"


def r15_downsample_runs(spark, sf_dir):
    found = S.downsample_runs(runs_of(spark, sf_dir), 3, power="cents", step=36000.0, tolerance=36000.0)
    return rounded(found, "time_ms", "mw", decimals=3)


R15_SQL = f"""WITH {I.MEASUREMENTS}{RUNS}, st AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY series_id, run_id ORDER BY num) AS d FROM runs),
ok AS (SELECT *, (row_number() OVER (PARTITION BY series_id, run_id ORDER BY num) - 1) // 3 AS block FROM st WHERE d BETWEEN 0 AND 72000)
SELECT series_id, run_id::BIGINT AS run_id, block, round((block + 1) * 3 * 36000000.0, 3)::DOUBLE AS time_ms, round(avg(cents), 3) AS mw FROM ok GROUP BY series_id, run_id, block HAVING count(*) = 3"""


def r16_downsample_first(spark, sf_dir):
    return rounded(S.downsample_first(I.measurements(spark, sf_dir), 30, 7, power="cents"), "time_s", "mw", decimals=3)


R16_SQL = f"WITH {I.MEASUREMENTS} SELECT series_id, (num - 1) // 7 AS block, count(*) AS n, round(avg(time_s), 3) AS time_s, round(avg(cents), 3) AS mw FROM m WHERE num <= 30 GROUP BY series_id, (num - 1) // 7 HAVING count(*) = 7"

CURVE = """, bl AS (SELECT series_id, (num - 1) // 10 AS block, max_by(t, num) AS end_s, sum(cents) AS ma FROM (SELECT *, time_s - 1704067200 AS t FROM m) GROUP BY series_id, (num - 1) // 10),
us AS (SELECT *, (end_s - coalesce(lag(end_s) OVER (PARTITION BY series_id ORDER BY block), 0)) * ma / 10 / 3600 AS used FROM bl)"""


def r17_battery_curve(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).withColumn("time_s", F.col("time_s") - 1704067200)
    return rounded(S.battery_curve(rows, 1e8, 100.0, span=10, current="cents"), "end_s", "level", decimals=3)


R17_SQL = f"WITH {I.MEASUREMENTS}{CURVE} SELECT series_id, block, round(end_s, 3) AS end_s, round((1e8 - sum(used) OVER (PARTITION BY series_id ORDER BY block)) / 1e8 * 100, 3) AS level FROM us"


def r18_battery_curve_by_mean(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).withColumn("time_s", F.floor("time_s") - 1704067200)
    return rounded(S.battery_curve_by_mean(rows, 1500.0, "timestamp_seconds(36000)", span=10, current="cents"), "left_mah")


R18_SQL = f"""WITH {I.MEASUREMENTS}, bl AS (SELECT series_id, (num - 1) // 10 AS block, max(floor(time_s)) - 1704067200 AS end_s, avg(cents) AS ma FROM m GROUP BY series_id, (num - 1) // 10)
SELECT series_id, block, strftime(make_timestamp(((36000 + end_s) * 1000000)::BIGINT), '%H:%M:%S') AS clock,
       round(1500.0 - sum(ma / 3600) OVER (PARTITION BY series_id ORDER BY block), 6) AS left_mah FROM bl"""


def r19_label_by_schedule(spark, sf_dir):
    rows = I.measurements(spark, sf_dir)
    schedule = rows.where("series_id = 0").groupBy((F.floor("num") % 7).alias("k")).agg(F.min("num").alias("a")).select(
        F.concat(F.lit("slot"), F.col("k").cast("string")).alias("label"), (1704067200 + F.col("k") * 300000).cast("double").alias("start_offset_s"), (1704067200 + F.col("k") * 300000 + 100000).cast("double").alias("end_offset_s"))
    return S.label_by_schedule(rows, schedule, "base").groupBy("series_id", "label").agg(F.count(F.lit(1)).alias("n"))


R19_SQL = f"""WITH {I.MEASUREMENTS}, sc AS (SELECT DISTINCT 'slot' || (num % 7)::VARCHAR AS label, 1704067200 + num % 7 * 300000 AS a FROM m WHERE series_id = 0)
SELECT series_id, coalesce(label, 'base') AS label, count(*) AS n FROM m LEFT JOIN sc ON time_s > a AND time_s < a + 100000 GROUP BY ALL"""


def r20_mark_ends(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).select("series_id", "num", F.array("event_type").alias("events"))
    return S.mark_ends(rows).select("series_id", "num", F.array_join("events", " ").alias("events"))


R20_SQL = f"""WITH {I.MEASUREMENTS} SELECT series_id, num, event_type || CASE WHEN num = 1 THEN ' start' ELSE '' END || CASE WHEN num = max(num) OVER (PARTITION BY series_id) THEN ' end' ELSE '' END AS events FROM m"""


def intervals_of(spark, sf_dir):
    """One interval from the beginning of each day that has measurements."""
    days = I.measurements(spark, sf_dir).select(F.floor(F.col("time_s") / 86400).alias("interval_id")).distinct()
    return days.select("interval_id", (F.col("interval_id") * 86400).cast("double").alias("t0"), (F.col("interval_id") * 86400 + 400000).cast("double").alias("t1"))


DAYS = ", iv AS (SELECT DISTINCT floor(time_s / 86400)::BIGINT AS interval_id, floor(time_s / 86400) * 86400 AS t0, floor(time_s / 86400) * 86400 + 400000 AS t1 FROM m)"
DRAWN = """, dr AS (SELECT i AS interval_id, a + ('0x' || substr(md5('1:0:' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * (b - a) AS p, a + ('0x' || substr(md5('1:1:' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * (b - a) AS q
  FROM range(60) t(i), (SELECT min(time_s) AS a, max(time_s) AS b FROM m)), iv AS (SELECT interval_id, least(p, q) AS t0, greatest(p, q) AS t1 FROM dr)"""
SLOPES = """,
u AS (SELECT DISTINCT series_id FROM m),
e AS (SELECT u.series_id, interval_id, t0, t1, (SELECT max(time_s) FROM m WHERE m.series_id = u.series_id) AS fin FROM u, iv),
x AS (SELECT *, coalesce((SELECT min(time_s) FROM m WHERE m.series_id = e.series_id AND time_s >= t0), fin) AS x0, coalesce((SELECT min(time_s) FROM m WHERE m.series_id = e.series_id AND time_s >= t1), fin) AS x1 FROM e),
sl AS (SELECT x.series_id, interval_id, CASE WHEN x1 <> x0 THEN (a.cents - b.cents) / (x1 - x0) END AS slope FROM x JOIN m a ON a.series_id = x.series_id AND a.time_s = x0 JOIN m b ON b.series_id = x.series_id AND b.time_s = x1)"""


def r21_slopes_between(spark, sf_dir):
    return rounded(S.slopes_between(I.measurements(spark, sf_dir), intervals_of(spark, sf_dir), value="cents"), "slope")


R21_SQL = f"WITH {I.MEASUREMENTS}{DAYS}{SLOPES} SELECT series_id, interval_id, round(slope, 6) AS slope FROM sl"


def r22_slope_histogram(spark, sf_dir):
    m = I.measurements(spark, sf_dir)
    return S.slope_histogram(m, S.random_intervals(m, 60), value="cents", decimals=2)


R22_SQL = f"WITH {I.MEASUREMENTS}{DRAWN}{SLOPES} SELECT series_id, round(slope, 2) + 0.0 AS slope, count(*) AS n FROM sl GROUP BY ALL"


def r23_series_stats(spark, sf_dir):
    return rounded(S.series_stats(I.measurements(spark, sf_dir), "cents"), "mean", "stddev", "time_mean", "time_stddev", decimals=3)


R23_SQL = f"WITH {I.MEASUREMENTS} SELECT series_id, round(avg(cents), 3) AS mean, round(stddev_samp(cents), 3) AS stddev, round(avg(time_s), 3) AS time_mean, round(stddev_samp(time_s), 3) AS time_stddev FROM m GROUP BY series_id"

QUERIES = {
    "r1_detect_runs": r1_detect_runs, "r1_detect_runs_long_series": r1_detect_runs_long_series, "r2_detect_runs_with": r2_detect_runs_with, "r3_detect_runs_tuples": r3_detect_runs_tuples,
    "r1_wide_window": r1_wide_window, "r2_detect_runs_with_long_series": r2_detect_runs_with_long_series, "r6_bucket_with_long_series": r6_bucket_with_long_series,
    "r4_bucket_consecutive": r4_bucket_consecutive, "r4_bucket_long_series": r4_bucket_long_series, "r5_hour_buckets": r5_hour_buckets, "r6_bucket_with": r6_bucket_with, "r7_time_buckets": r7_time_buckets,
    "r8_run_energy": r8_run_energy, "r9_total_energy": r9_total_energy, "r10_find_gaps": r10_find_gaps, "r11_checkpoint_runs": r11_checkpoint_runs, "r12_checkpoint_runs_list": r12_checkpoint_runs_list,
    "r13_integrate_power": r13_integrate_power, "r14_downsample": r14_downsample, "r15_downsample_runs": r15_downsample_runs, "r16_downsample_first": r16_downsample_first, "r17_battery_curve": r17_battery_curve,
    "r18_battery_curve_by_mean": r18_battery_curve_by_mean, "r19_label_by_schedule": r19_label_by_schedule, "r20_mark_ends": r20_mark_ends, "r21_slopes_between": r21_slopes_between, "r22_slope_histogram": r22_slope_histogram, "r23_series_stats": r23_series_stats,
    "r10_gaps_long_series": r10_gaps_long_series, "r13_integrate_long_series": r13_integrate_long_series, "r14_downsample_long_series": r14_downsample_long_series, "r17_battery_curve_long_series": r17_battery_curve_long_series,
}

SQL = {
    "r1_detect_runs": R1_SQL, "r1_detect_runs_long_series": R1_LONG_SQL, "r2_detect_runs_with": R2_SQL, "r3_detect_runs_tuples": R3_SQL, "r1_wide_window": R1_WIDE_SQL, "r2_detect_runs_with_long_series": R1_LONG_SQL, "r6_bucket_with_long_series": R4_LONG_SQL, "r4_bucket_consecutive": R4_SQL, "r4_bucket_long_series": R4_LONG_SQL,
    "r5_hour_buckets": R5_SQL, "r6_bucket_with": R6_SQL, "r7_time_buckets": R7_SQL, "r8_run_energy": R8_SQL, "r9_total_energy": R9_SQL, "r10_find_gaps": R10_SQL, "r13_integrate_power": R13_SQL,
    "r14_downsample": R14_SQL, "r15_downsample_runs": R15_SQL, "r16_downsample_first": R16_SQL, "r17_battery_curve": R17_SQL, "r18_battery_curve_by_mean": R18_SQL, "r19_label_by_schedule": R19_SQL,
    "r20_mark_ends": R20_SQL, "r21_slopes_between": R21_SQL, "r22_slope_histogram": R22_SQL, "r23_series_stats": R23_SQL,
    "r11_checkpoint_runs": R11_SQL, "r12_checkpoint_runs_list": R12_SQL, **LONG_SQL,
}
