"""Registered queries of parsers, stores, reports and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ohmline.operators import fleet as C
from ohmline.operators import segments as G
from ohmline.operators import series as S
from ohmline.plans import standins as I
from ohmline.plans.fleet_queries import DAEMONS, compared
from ohmline.plans import fleet_sql as Q
from ohmline.plans.report import full_report, tall_report
from ohmline.plans.series_queries import CURVE, rounded
from ohmline.shared import read_table, shared_dir, ship
from ohmline.sources import readers, sinks
from ohmline.streaming import streams

ship(__name__)


def s2_short_measurements(spark, sf_dir):
    m = I.measurements(spark, sf_dir)
    line = F.concat_ws(",", F.col("num").cast("string"), F.floor("time_s").cast("string"), F.when(F.col("event_type") == "error", "x").otherwise(F.col("cents").cast("string")), F.lit("4"))
    parsed = readers.parse_measurements(m.select("series_id", line.alias("value")), series="series_id", on_bad="zero")
    return parsed.groupBy("series_id").agg(F.sum("time_s").alias("time_s"), F.sum("current_ma").alias("ma"), F.sum("voltage_v").alias("v"))


def battery_lines(spark, sf_dir):
    """Alternating level and date lines, a log for each user."""
    events = read_table(spark, sf_dir, "events")
    level = F.concat(F.lit("  level: "), (F.col("event_id") % 100).cast("string"))
    date = F.date_format("ts", "EEE MMM d HH:mm:ss 'UTC' yyyy")
    line = F.when(F.col("event_type").isin("click", "view"), level).otherwise(date)
    return events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), line.alias("value"))


def s4_battery_log(spark, sf_dir):
    return readers.parse_battery_log(battery_lines(spark, sf_dir)).select("file", "pos", F.unix_timestamp("ts").alias("epoch"), F.col("level").cast("long").alias("level"))


def s5_battery_log_of_day(spark, sf_dir):
    return readers.battery_log_of_day(battery_lines(spark, sf_dir), "Jan 12").select("file", "pos", "time", F.col("level").cast("long").alias("level"))


def s7_load_samples(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    item = F.create_map(
        F.lit("uuid"), F.col("user_id").cast("string"), F.lit("timestamp"), F.when(F.col("event_type") != "view", F.col("event_id").cast("string")),
        F.lit("batteryLevel"), (F.col("event_id") % 101 / 100.0).cast("string"), F.lit("triggeredBy"), F.upper("event_type"), F.lit("extra"), F.col("props"),
    )
    items = events.select(F.map_filter(item, lambda _, v: v.isNotNull()).alias("attributes"), F.array(F.concat(F.col("event_id").cast("string"), F.lit("; Mail ")), F.lit("9")).alias("process_list"))
    return readers.load_samples(items).select("uuid", F.col("time").cast("long").alias("time"), F.round("level", 2).alias("level"), "event", "state", F.array_join("apps", ",").alias("apps"), F.array_join(F.map_keys("features"), ",").alias("features"))


def s9_append(spark, sf_dir):
    regs = I.registrations(spark, sf_dir)
    return readers.append_accumulated(regs.where("os = 'v1'"), regs.where("os <> 'v1'")).groupBy("os").agg(F.count(F.lit(1)).alias("n"))


def s11_partitioned_source(spark, sf_dir):
    """Pages of 100 orders, each whole in one partition."""
    paged = readers.pages(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").withColumn("part", F.spark_partition_id())
    return paged.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count_distinct("part").alias("parts"))


def s13_cache_and_reload(spark, sf_dir):
    path = f"{shared_dir(spark)}/ohmline/saved-{uuid.uuid4().hex}"
    regs = I.registrations(spark, sf_dir)
    readers.save_replacing(regs.where("os = 'v1'"), path)
    readers.save_replacing(regs, path)
    return readers.cached(spark.read.parquet(path)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def s14_decimal_comma(spark, sf_dir):
    m = I.measurements(spark, sf_dir)
    comma = lambda c, d: F.concat_ws(",", F.floor(c / d).cast("string"), F.lpad((c % d).cast("string"), 2, "0"))
    line = F.concat_ws(",", comma(F.col("num") * 100 + 25, 100), comma(F.col("cents"), 100), F.lit("4,00"))
    fixed = readers.fix_decimal_comma(m.select("series_id", F.col("num").alias("pos"), line.alias("value")), series="series_id")
    return rounded(fixed, "time_s", "current_ma", decimals=2).select("series_id", "num", "time_s", "current_ma", "voltage_v")


def s17_decode_distribution(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    entry = F.concat((F.col("event_id") % 100).cast("string"), F.lit(";"), (F.col("event_id") % 7 / 8.0).cast("string"))
    return readers.decode_distribution(events.select("event_id", F.array(entry).alias("entries"), F.lit(0.5).alias("xmax"))).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def c17_full_report(spark, sf_dir):
    """All parts of the report in one tall table."""
    report = full_report(I.raw_samples(spark, sf_dir), I.registrations(spark, sf_dir), DAEMONS)
    report["scores"] = C.j_scores(report["users"].withColumn("distance", F.round("distance", 5)))
    return tall_report(report).withColumns({"value": F.round("value", 5), "value_neg": F.round("value_neg", 5), "distance": F.round("distance", 5)})


def k2_dry_run(spark, sf_dir):
    """What would be written for hogs, bugs and operating systems."""
    report = full_report(I.raw_samples(spark, sf_dir), I.registrations(spark, sf_dir), DAEMONS)
    parts = [C.labelled(report[part], nature, keys) for part, nature, keys in (("hogs", "hog", ["app"]), ("bugs", "bug", ["app", "uuid"]), ("os", "os", ["os"]))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return compared(sinks.write_results(rows, "unused", dry=True)).select("nature", "key1", "key2", "ev", "ev_neg", "distance", "users_with")


def k8_text_lines(spark, sf_dir):
    path = f"{shared_dir(spark)}/ohmline/text-{uuid.uuid4().hex}"
    sinks.write_text(I.logs(spark, sf_dir).groupBy("date", "node").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.text(path)


def k7_dump(spark, sf_dir):
    path = f"{shared_dir(spark)}/ohmline/dump-{uuid.uuid4().hex}"
    sinks.dump_json(I.registrations(spark, sf_dir).select("uuid", "os", "model"), path)
    return spark.read.schema("uuid string, os string, model string").json(path)


def k10_correlations(spark, sf_dir):
    report = full_report(I.raw_samples(spark, sf_dir), I.registrations(spark, sf_dir), DAEMONS)
    ordered = sinks.ordered_correlations(rounded(report["correlations"], "r", decimals=5))
    place = F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "kind", "value"))
    return ordered.select("kind", "value", "r", place.cast("long").alias("place"))


def k11_curve_lines(spark, sf_dir):
    rows = I.measurements(spark, sf_dir).withColumn("time_s", F.floor("time_s").cast("double") - 1704067200)
    curve = S.battery_curve(rows, 1e8, 100.0, span=10, current="cents")
    return rounded(sinks.curve_lines(curve, "timestamp_seconds(1704067200)", pattern="yyyy-MM-dd HH:mm:ss"), "level", decimals=3)


def run_stream(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def st1_ingest(spark, sf_dir):
    """The events table as a stream of files, ingested twice; the second time finds nothing new."""
    base = f"{shared_dir(spark)}/ohmline/stream-{uuid.uuid4().hex}"
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    events.write.parquet(f"{base}/in")
    for _ in range(2):
        run_stream(streams.ingest(spark, f"{base}/in", events.schema, f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def to_table(spark, stream, mode="append"):
    """A stream of finite files run to its end into a table in the shared folder."""
    base = f"{shared_dir(spark)}/ohmline/stream-{uuid.uuid4().hex}"
    run_stream(stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{base}/out"))
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed(spark, df):
    path = f"{shared_dir(spark)}/ohmline/stream-{uuid.uuid4().hex}/in"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def st2_node_hours(spark, sf_dir):
    """Windows that the watermark has closed: all but those of the last two hours."""
    events = read_table(spark, sf_dir, "events").select(F.timestamp_micros(F.expr(I.MICROS)).alias("ts"), F.col("user_id").alias("node"))
    found = to_table(spark, streams.node_hour_counts(streamed(spark, events)))
    return found.select(F.unix_timestamp("start").alias("start"), "node", "n")


def st3_stream_buckets(spark, sf_dir):
    m = I.measurements(spark, sf_dir).select("series_id", "num", "event_type")
    found = to_table(spark, streams.stream_buckets(streamed(spark, m), lambda row: row.event_type))
    return found.groupBy("series_id").agg(F.count_distinct("bucket_id").alias("buckets"), F.count(F.lit(1)).alias("n_rows"))


def st3_stream_runs(spark, sf_dir):
    m = I.measurements(spark, sf_dir).select("series_id", "num", "cents")
    found = to_table(spark, streams.stream_runs(streamed(spark, m), 6000, 5, lambda row: row.cents))
    return found.groupBy("series_id", "run_id").agg(F.min("num").alias("first_num"), F.max("num").alias("last_num"), F.count(F.lit(1)).alias("n"))


def st3_stream_user_detectors(spark, sf_dir):
    """Runs of rows dearer than their series' dearest so far: a detector of a user's own, on the stream as on the table."""
    m = I.measurements(spark, sf_dir).select("series_id", "num", "cents")
    found = to_table(spark, streams.stream_runs_with(streamed(spark, m), RisingDetector))
    again = G.detect_runs_with(m, RisingDetector)
    of = lambda rows, side: rows.select("series_id", "run_id", "num", F.lit(side).alias("side"))
    both = of(found, 1).unionByName(of(again, 2)).groupBy("series_id", "run_id", "num").agg(F.sum("side").alias("sides"))
    return both.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("run_id").alias("runs"), F.min("sides").alias("sides"))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def st3_stream_late_rows(spark, sf_dir):
    """Buckets of a stream that comes in any order: its rows wait for the watermark, so those of the last day are still out."""
    rows = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), F.col("event_id").alias("num"), F.timestamp_micros(F.expr(I.MICROS)).alias("ts"), "event_type")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        mixed = streamed(spark, rows.repartition(8, F.xxhash64("num")).sortWithinPartitions(F.xxhash64("num")))
        found = to_table(spark, streams.stream_buckets(mixed, lambda row: row.event_type, time="ts", late="1 day", states=1024))
    finally:
        spark.conf.set(STATE_STORE, before)
    return found.groupBy("series_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))


class RisingDetector:
    """In a run while a row has more cents than the row before; the lead-in is that row."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.rows = []

    def update(self, row):
        self.rows = [*self.rows[-1:], row]

    def ready(self):
        return len(self.rows) == 2

    def in_run(self):
        return self.rows[1].cents > self.rows[0].cents

    def lead_in(self):
        return self.rows[:1]


def capture_of(values) -> bytes:
    """A binary capture of one main channel, with the given counts."""
    head = bytearray(1024)
    at = 0
    for field in readers.HEADER_FIELDS:
        at += 1 if field == "s" else field
    places = {readers.STATUS_OFFSET_FIELD: 272, readers.SAMPLE_OFFSET_FIELD: 1024, readers.MASK_FIELD: 0x1000}
    begin = 0
    for i, field in enumerate(readers.HEADER_FIELDS):
        size = 1 if field == "s" else field
        head[begin : begin + size] = places.get(i, 0).to_bytes(size, "little")
        begin += size
    head[272 + readers.STATUS_VOUT], head[272 + readers.STATUS_RATE], head[272 + readers.STATUS_REVISION] = 200, 5, 4
    return bytes(head) + b"".join(int(v).to_bytes(2, "little") + (32000).to_bytes(2, "little") for v in values)


def s15_power_captures(spark, sf_dir):
    """A capture of each user's amounts, encoded here and decoded by the reader: even counts up to 32 mA, odd ones coarse."""
    counts = I.measurements(spark, sf_dir).select(F.col("series_id").cast("string").alias("name"), "num", (F.col("cents") % 30000).alias("count"))
    of_user = counts.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("num", "count"))), lambda x: x["count"]).alias("counts"))

    def encode(batches):
        for batch in batches:
            batch["content"] = [capture_of(x) for x in batch["counts"]]
            yield batch[["name", "content"]]

    rows = readers.decode_captures(of_user.mapInPandas(encode, "name string, content binary"))
    return rounded(rows.select("series_id", "num", "time_s", "main_ma", "main_v", "missing"), "time_s", "main_ma", "main_v")


QUERIES = {f.__name__: f for f in (s2_short_measurements, s4_battery_log, s5_battery_log_of_day, s7_load_samples, s9_append, s11_partitioned_source, s13_cache_and_reload, s14_decimal_comma, s15_power_captures, s17_decode_distribution, c17_full_report, k2_dry_run, k7_dump, k8_text_lines, k10_correlations, k11_curve_lines, st1_ingest, st2_node_hours, st3_stream_buckets, st3_stream_runs, st3_stream_user_detectors, st3_stream_late_rows)}

BATTERY = """b AS (SELECT user_id AS file, event_id AS pos, ts, event_type IN ('click', 'view') AS is_level, event_id % 100 AS lv FROM events),
f AS (SELECT *, last_value(CASE WHEN is_level THEN lv END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS level,
             last_value(CASE WHEN NOT is_level AND strftime(ts, '%b %-d') = 'Jan 12' THEN strftime(ts, '%H:%M:%S') END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS clock FROM b)"""
RUN_HEADS = """, act AS (SELECT *, count(*) OVER w5 = 5 AND sum(cents) OVER w5 >= 30000 AS active FROM m WINDOW w5 AS (PARTITION BY series_id ORDER BY num ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
ris AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY series_id ORDER BY num), false) AS rises FROM act), ids AS (SELECT *, sum(rises::INT) OVER (PARTITION BY series_id ORDER BY num) AS rid FROM ris)"""

C17_SQL = f"""WITH {Q.STORED}, vo AS (SELECT os AS k, 'os_variance' AS part, uuid, sum(mass) AS m, sum(mass * mean) AS s, count(*) AS n FROM pt GROUP BY ALL HAVING sum(mass) > 0 UNION ALL SELECT model, 'model_variance', uuid, sum(mass), sum(mass * mean), count(*) FROM pt GROUP BY ALL HAVING sum(mass) > 0),
co AS ({Q.SQL['c10_correlations']}), e2 AS (SELECT * FROM ex WHERE app IN (SELECT app FROM hg)), hc AS ({Q.indicator('e2', 'os', 'app')} UNION ALL {Q.indicator('e2', 'model', 'app')}),
us_ AS ({Q.SQL['c13_app_usage'].replace('round(', '(').replace(', 6)', ')')}), dd AS (SELECT uuid, round({Q.DIST}, 5) AS distance FROM pf),
tall AS (
  SELECT 'os' AS part, key AS key1, NULL::VARCHAR AS key2, (SELECT count(*) FROM pt WHERE os IS NOT DISTINCT FROM key) AS n, ev AS value, ev_neg AS value_neg, {Q.DIST} AS distance FROM ({Q.EVS.format(key='os')}) WHERE ev IS NOT NULL AND ev_neg IS NOT NULL
  UNION ALL SELECT 'model', key, NULL, (SELECT count(*) FROM pt WHERE model IS NOT DISTINCT FROM key), ev, ev_neg, {Q.DIST} FROM ({Q.EVS.format(key='model')}) WHERE ev IS NOT NULL AND ev_neg IS NOT NULL
  UNION ALL SELECT 'users', uuid, NULL, n_rates, ev, ev_neg, {Q.DIST} FROM pf WHERE ev_neg IS NOT NULL
  UNION ALL SELECT 'similar', uuid, NULL, (SELECT count(*) FROM sm WHERE sm.uuid = cp.uuid AND sim), ev, ev_neg, {Q.DIST} FROM cp WHERE ev IS NOT NULL AND ev_neg IS NOT NULL
  UNION ALL SELECT 'hogs', app, NULL, users_with, ev, ev_neg, distance FROM hg
  UNION ALL SELECT 'bugs', app, uuid, n, ev, ev_neg, distance FROM bb
  UNION ALL SELECT 'skipped', app, CASE WHEN users_with < 5 AND users_without < 5 THEN 'both' WHEN users_with < 5 THEN 'with' ELSE 'without' END, users_with, NULL, NULL, NULL FROM au WHERE NOT (users_with >= 5 AND users_without >= 5)
  UNION ALL SELECT 'scores', uuid, NULL, NULL, CASE WHEN distance = 0 THEN 0 ELSE floor((rank() OVER (ORDER BY distance DESC) - 1) / (count(*) OVER ())::DOUBLE * 100 + 0.5) / 100 END, NULL, NULL FROM dd WHERE distance IS NOT NULL
  UNION ALL SELECT 'correlations', kind, value, NULL, r, NULL, NULL FROM co
  UNION ALL SELECT 'hog_correlations', app, value, NULL, r, NULL, NULL FROM hc
  UNION ALL SELECT part, k, NULL, sum(n), sum(s) / sum(m), var_pop(s / m) * count(*), NULL FROM vo GROUP BY part, k
  UNION ALL SELECT 'usage', uuid, app, NULL, rate_share, time_share, NULL FROM us_)
SELECT part, key1, key2, n::BIGINT AS n, round(value, 5) AS value, round(value_neg, 5) AS value_neg, round(distance, 5) AS distance FROM tall"""

SQL = {
    "s2_short_measurements": f"WITH {I.MEASUREMENTS} SELECT series_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE floor(time_s) END) AS time_s, sum(CASE WHEN event_type = 'error' THEN 0 ELSE cents END)::DOUBLE AS ma, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 4 END)::DOUBLE AS v FROM m GROUP BY series_id",
    "s4_battery_log": f"WITH {BATTERY} SELECT file, pos, epoch_us(ts) // 1000000 AS epoch, coalesce(level, 0) AS level FROM f WHERE NOT is_level",
    "s5_battery_log_of_day": f"WITH {BATTERY} SELECT file, pos, clock AS time, lv AS level FROM f WHERE is_level AND clock IS NOT NULL",
    "s7_load_samples": "SELECT user_id::VARCHAR AS uuid, CASE WHEN event_type <> 'view' THEN event_id ELSE 0 END AS time, round((event_id % 101) / 100, 2) AS level, event_type AS event, '' AS state, 'Mail,' AS apps, 'extra' AS features FROM events",
    "s9_append": f"WITH {I.REGS} SELECT os, count(*) AS n FROM g GROUP BY os",
    "s11_partitioned_source": "SELECT page, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, 1::BIGINT AS parts FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders) GROUP BY page",
    "s13_cache_and_reload": f"WITH {I.REGS} SELECT model, count(*) AS n FROM g GROUP BY model",
    "s14_decimal_comma": f"WITH {I.MEASUREMENTS} SELECT series_id, num - 1 AS num, round(num - 1, 2)::DOUBLE AS time_s, round(cents / 100, 2) AS current_ma, 4.0::DOUBLE AS voltage_v FROM m",
    "s17_decode_distribution": "SELECT event_id, round((event_id % 100) / 100 * 0.5, 6) AS x, round((event_id % 7) / 8, 6) AS y FROM events",
    "c17_full_report": C17_SQL,
    "k2_dry_run": f"""WITH {Q.BUGS}, o AS ({Q.EVS.format(key='os')}), z AS (
  SELECT 'hog' AS nature, app AS key1, NULL::VARCHAR AS key2, ev, ev_neg, users_with FROM hg UNION ALL SELECT 'bug', app, uuid, ev, ev_neg, NULL FROM bb UNION ALL SELECT 'os', key, NULL, ev, ev_neg, NULL FROM o WHERE ev IS NOT NULL AND ev_neg IS NOT NULL)
SELECT nature, key1, key2, {Q.CMP_OUT}, users_with FROM z""",
    "k7_dump": f"WITH {I.REGS} SELECT uuid, os, model FROM g",
    "k8_text_lines": f"WITH {I.LOGS} SELECT concat_ws(', ', date, node::VARCHAR, count(*)::VARCHAR) AS value FROM l GROUP BY date, node",
    "k10_correlations": f"SELECT *, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, kind, value) AS place FROM ({Q.SQL['c10_correlations']})",
    "k11_curve_lines": f"WITH {I.MEASUREMENTS.replace('epoch_us(ts) / 1e6', 'floor(epoch_us(ts) / 1e6)')}{CURVE} SELECT series_id, strftime(make_timestamp(((1704067200 + end_s) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS date, round((1e8 - sum(used) OVER (PARTITION BY series_id ORDER BY block)) / 1e8 * 100, 3) AS level FROM us",
    "st1_ingest": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "st2_node_hours": "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS start, user_id AS node, count(*) AS n FROM events GROUP BY ALL HAVING epoch_us(date_trunc('hour', any_value(ts))) + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 3600000000",
    "st3_stream_buckets": f"WITH {I.MEASUREMENTS}, t AS (SELECT *, num > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY series_id ORDER BY num) AS turn FROM m) SELECT series_id, 1 + sum(turn::INT)::BIGINT AS buckets, count(*) AS n_rows FROM t GROUP BY series_id",
    "st3_stream_runs": f"WITH {I.MEASUREMENTS}{RUN_HEADS} SELECT series_id, rid::BIGINT AS run_id, min(num) - 4 AS first_num, max(num) AS last_num, max(num) - min(num) + 5 AS n FROM ids WHERE active GROUP BY series_id, rid",
    "st3_stream_late_rows": f"""WITH {I.MEASUREMENTS}, t AS (SELECT *, num > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY series_id ORDER BY num) AS turn FROM m),
b AS (SELECT *, sum(turn::INT) OVER (PARTITION BY series_id ORDER BY num) AS bucket_id FROM t WHERE epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 86400000) * 1000 FROM events))
SELECT series_id, bucket_id::BIGINT AS bucket_id, count(*) AS n, min(event_id) AS first_num, max(event_id) AS last_num FROM b GROUP BY series_id, bucket_id""",
    "st3_stream_user_detectors": f"""WITH {I.MEASUREMENTS}, u AS (SELECT *, coalesce(cents > lag(cents) OVER w, false) AS up, lead(cents) OVER w > cents AS next_up FROM m WINDOW w AS (PARTITION BY series_id ORDER BY num)),
x AS (SELECT *, up AND NOT coalesce(lag(up) OVER (PARTITION BY series_id ORDER BY num), false) AS rises FROM u)
SELECT series_id, (sum(up::INT) + sum(rises::INT))::BIGINT AS n_rows, sum(rises::INT)::BIGINT AS runs, 3::BIGINT AS sides FROM x GROUP BY series_id HAVING sum(rises::INT) > 0""",
    "s15_power_captures": f"WITH {I.MEASUREMENTS}, k AS (SELECT series_id, num, cents % 30000 AS c FROM m) SELECT series_id::VARCHAR AS series_id, num - 1 AS num, round((num - 1) / 5000.0::DOUBLE, 6) AS time_s, round(CASE WHEN c % 2 = 1 THEN (c - 1) / 1000.0::DOUBLE * 250 ELSE c / 1000.0::DOUBLE END, 6) AS main_ma, 4.0::DOUBLE AS main_v, false AS missing FROM k",
}
