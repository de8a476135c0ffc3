"""Detection on a stream whose rows come late and shuffled, against the batch form."""

import random

import pytest

from ohmline.operators import segments as G
from ohmline.streaming import streams

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def run(spark, folder, batches, schema, make):
    """What the query has written after each batch, in batches of files of their own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = make(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


def test_late_and_shuffled_rows(rocks, tmp_path):
    spark, rng = rocks, random.Random(6)
    schema = "series_id string, num long, ts timestamp, p double"
    table = spark.range(120).selectExpr("if(id % 3 = 0, 'a', 'b') AS series_id", "id AS num", "timestamp_seconds(1700000000 + 60 * id) AS ts", "cast(id * 7919 % 13 AS double) AS p").collect()
    order = sorted(table, key=lambda r: r["num"] + rng.randrange(8))  # no row is more than eight minutes behind another
    batches = [[tuple(r) for r in order[i : i + 20]] for i in range(0, 120, 20)]
    batches.append([("z", 1000, table[-1]["ts"].replace(year=2030), 0.0)])  # a row of the future lets the others go
    make = lambda rows: streams.stream_runs(rows, 5, 4, lambda r: r.p, time="ts", late="10 minutes")
    found = sorted((r[0], r[1], r[4]) for r in run(spark, tmp_path, batches, schema, make))
    want = sorted((r["series_id"], r["num"], r["run_id"]) for r in G.detect_runs(spark.createDataFrame(table), 5, 4, power="p").collect())
    assert found == want and len(found) > 40


def test_rows_behind_the_watermark_are_dropped_and_series_expire(rocks, tmp_path):
    spark = rocks
    schema = "series_id string, num long, ts timestamp, k string"
    at = lambda minute: spark.sql(f"SELECT timestamp_seconds(1700000000 + 60 * {minute})").first()[0]
    batches = [
        [("s", 2, at(2), "a"), ("s", 1, at(1), "a"), ("s", 3, at(3), "b")],
        [("s", 9, at(9), "b"), ("o", 30, at(30), "x")],  # the watermark goes to 25
        [("s", 8, at(8), "late")],
        [("o", 300, at(300), "x")],  # more than an hour without rows: s is forgotten
        [("s", 301, at(301), "b"), ("s", 302, at(302), "c"), ("o", 400, at(400), "x")],
        [("o", 900, at(900), "x")],
    ]
    make = lambda rows: streams.stream_buckets(rows, lambda r: r.k, time="ts", late="5 minutes", expire_s=3600)
    found = run(spark, tmp_path, batches, schema, make)
    assert sorted((r[1], r[4]) for r in found if r[0] == "s") == [(1, 0), (2, 0), (3, 1), (9, 1), (301, 0), (302, 1)]
