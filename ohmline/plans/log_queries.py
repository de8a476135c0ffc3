"""Registered queries over logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ohmline.operators import logs as L
from ohmline.plans import standins as I
from ohmline.sources import readers
from ohmline.shared import read_table

DAY = ("date", "node")
COUNTS = "b AS (SELECT date, hour, node, count(*) AS n FROM l GROUP BY ALL)"


def buckets(spark, sf_dir):
    return L.group_by_node_hour(I.logs(spark, sf_dir))


def days(spark, sf_dir):
    return L.group_by_node_hour(I.logs(spark, sf_dir), key=DAY)


def l1_node_hours(spark, sf_dir):
    return buckets(spark, sf_dir)


def l1_node_hour_lines(spark, sf_dir):
    found = L.group_by_node_hour(I.logs(spark, sf_dir), line="rest")
    return found.select("date", "hour", "node", "n", F.array_join("lines", "|").alias("lines"))


def l2_bucket_sizes(spark, sf_dir):
    return L.bucket_sizes(buckets(spark, sf_dir))


def l3_largest_buckets(spark, sf_dir):
    return L.largest_buckets(days(spark, sf_dir), 10)


def l4_abnormally_large(spark, sf_dir):
    lines = I.logs(spark, sf_dir)
    large = L.abnormally_large(L.group_by_node_hour(lines, key=DAY), 6)
    return L.lines_of(lines, large, DAY).select("date", "node", "pos")


def l5_grep(spark, sf_dir):
    return L.grep(I.logs(spark, sf_dir), '"k": 1[0-9]\\}')


def l6_messages_within(spark, sf_dir):
    return L.messages_within(I.logs(spark, sf_dir), "Jan", (3, 9), (5, 17)).select("pos", "day", "hour")


def l7_messages_from(spark, sf_dir):
    return L.messages_from(I.logs(spark, sf_dir), 7).select("pos", "tag")


def l8_tagged_alerts(spark, sf_dir):
    return L.tagged_alerts(I.logs(spark, sf_dir)).select("pos", "tag")


RULES = {"nineties": '"k": 9[0-9]\\}', "sevens": "7\\}", "tens": '"k": 1[0-9]\\}'}


def l9_detect_alerts(spark, sf_dir):
    return L.detect_alerts(I.logs(spark, sf_dir), RULES, key=DAY)


def l10_contains(spark, sf_dir):
    return L.contains_filter(read_table(spark, sf_dir, "documents"), "license", text="text")


def l11_first_match(spark, sf_dir):
    return L.first_match_per_bucket(I.logs(spark, sf_dir), F.col("rest").rlike("[05]\\}"), key=DAY)


def l12_active_hours(spark, sf_dir):
    return L.active_hours_per_node(I.logs(spark, sf_dir), 20)


def l13_timing_summary(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    line = F.concat(F.lit("Time lib."), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" from caller"), (F.col("event_id") % 3).cast("string"))).otherwise(""), F.lit(": "), F.round(F.col("value") * 100).cast("long").cast("string"))
    return L.timing_summary(events.select(line.alias("value")), prefixes=["lib."]).select("name", F.round("total_ms", 3).alias("total_ms"), F.round("mean_ms", 3).alias("mean_ms"))


def l14_section_filter(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit(" app fractions:"))).when(
        F.col("event_type") == "error", F.lit("no numbers here")
    ).otherwise(F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 2).cast("string"), F.lit(" "), (F.col("event_id") % 3).cast("string")))
    lines = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("pos"), line.alias("value"))
    return L.section_filter(lines).select("file", "pos", "uuid", "value")


def l15_record_sizes(spark, sf_dir):
    samples = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("time"), (F.length("props") % 5).alias("k"), F.length("props").cast("long").alias("packed"))
    return L.record_sizes(samples, features="k", packed="packed").select("time", F.round("kilobytes", 6).alias("kilobytes"), "packed")


def s3_node_logs(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.when(F.col("event_type") == "view", "-").otherwise(F.col("event_type")), F.col("event_id").cast("string"), F.date_format("ts", "yyyy.MM.dd"), F.concat(F.lit("n"), F.col("user_id").cast("string")), F.date_format("ts", "MMM"), F.dayofmonth("ts").cast("string"), F.date_format("ts", "HH:mm:ss"), F.col("props"))
    return readers.parse_node_logs(events.select(line.alias("value"))).select("tag", "epoch", "date", "node", "month", "day", "hour", "rest")


QUERIES = {
    "l1_node_hours": l1_node_hours, "l1_node_hour_lines": l1_node_hour_lines, "l2_bucket_sizes": l2_bucket_sizes, "l3_largest_buckets": l3_largest_buckets, "l4_abnormally_large": l4_abnormally_large, "l5_grep": l5_grep,
    "l6_messages_within": l6_messages_within, "l7_messages_from": l7_messages_from, "l8_tagged_alerts": l8_tagged_alerts, "l9_detect_alerts": l9_detect_alerts, "l10_contains": l10_contains, "l11_first_match": l11_first_match,
    "l12_active_hours": l12_active_hours, "l13_timing_summary": l13_timing_summary, "l14_section_filter": l14_section_filter, "l15_record_sizes": l15_record_sizes, "s3_node_logs": s3_node_logs,
}

SQL = {
    "l1_node_hours": f"WITH {I.LOGS}, {COUNTS} SELECT * FROM b",
    "l1_node_hour_lines": f"WITH {I.LOGS} SELECT date, hour, node, count(*) AS n, string_agg(rest, '|' ORDER BY rest) AS lines FROM l GROUP BY ALL",
    "l2_bucket_sizes": f"WITH {I.LOGS}, {COUNTS} SELECT sum(n)::BIGINT AS total, count(*) AS buckets, max(n) AS largest FROM b",
    "l3_largest_buckets": f"WITH {I.LOGS}, d AS (SELECT date, node, count(*) AS n FROM l GROUP BY ALL) SELECT date, node, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS k FROM d) WHERE k <= 10",
    "l4_abnormally_large": f"WITH {I.LOGS}, d AS (SELECT date, node FROM l GROUP BY ALL HAVING count(*) >= 6) SELECT date, node, pos FROM l SEMI JOIN d USING (date, node)",
    "l5_grep": f"""WITH {I.LOGS} SELECT DISTINCT date, hour, node FROM l WHERE regexp_matches(rest, '"k": 1[0-9]\\}}')""",
    "l6_messages_within": f"WITH {I.LOGS} SELECT pos, day, hour FROM l WHERE month = 'Jan' AND day > 3 AND day <= 9 AND hour > 5 AND hour <= 17",
    "l7_messages_from": f"WITH {I.LOGS} SELECT pos, tag FROM l WHERE node = 7",
    "l8_tagged_alerts": f"WITH {I.LOGS} SELECT pos, tag FROM l WHERE tag <> '-'",
    "l9_detect_alerts": f"""WITH {I.LOGS}, h AS (SELECT date, node, unnest(list_filter([CASE WHEN regexp_matches(rest, '"k": 9[0-9]\\}}') THEN 'nineties' END, CASE WHEN regexp_matches(rest, '7\\}}') THEN 'sevens' END, CASE WHEN regexp_matches(rest, '"k": 1[0-9]\\}}') THEN 'tens' END], lambda x: x IS NOT NULL)) AS rule FROM l)
SELECT date, node, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM h GROUP BY ALL""",
    "l10_contains": "SELECT count(*) AS n, coalesce(sum(contains(upper(text), 'LICENSE')::BIGINT), 0)::BIGINT AS hits FROM documents",
    "l11_first_match": f"WITH {I.LOGS} SELECT date, node, min(pos) AS pos, arg_min(rest, pos) AS rest FROM l WHERE regexp_matches(rest, '[05]\\}}') GROUP BY ALL",
    "l12_active_hours": f"WITH {I.LOGS} SELECT node, count(DISTINCT (date, hour)) AS hours FROM l GROUP BY node HAVING count(DISTINCT (date, hour)) > 20",
    "l13_timing_summary": "SELECT event_type || CASE WHEN event_id % 2 = 0 THEN ' caller' || (event_id % 3)::VARCHAR ELSE '' END AS name, round(sum(round(value * 100)), 3) AS total_ms, round(avg(round(value * 100)), 3) AS mean_ms FROM events GROUP BY 1",
    "l14_section_filter": """WITH x AS (SELECT user_id AS file, event_id AS pos, event_type, last_value(CASE WHEN event_type = 'signup' THEN 'u' || event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS uuid FROM events)
SELECT file, pos, uuid, event_type || ' ' || (pos % 2)::VARCHAR || ' ' || (pos % 3)::VARCHAR AS value FROM x WHERE uuid IS NOT NULL AND event_type NOT IN ('signup', 'error') AND NOT (pos % 2 = 0 AND pos % 3 = 0)""",
    "l15_record_sizes": "SELECT event_id AS time, round((20 + 36 + (length(props) % 5) * 23 + 40 + 4 + 10 + 50) / 1000, 6) AS kilobytes, length(props) AS packed FROM events",
    "s3_node_logs": """SELECT CASE WHEN event_type = 'view' THEN '-' ELSE event_type END AS tag, event_id AS epoch, strftime(ts, '%Y.%m.%d') AS date, 'n' || user_id::VARCHAR AS node, strftime(ts, '%b') AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, props AS rest FROM events""",
}
