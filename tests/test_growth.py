"""Steps whose work must not grow faster than their input: what they shuffle, pair and call."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ohmline.functions import distributions as D
from ohmline.operators import fleet as C
from ohmline.operators import segments, stored
from ohmline.plans import standins
from ohmline.streaming import streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"u{u}", ["d1", f"d2{i}", *[f"a{k}" for k in range(u % 3 + 2)][: i % 4 + 1]], 1, 0.01 * i) for u in range(6) for i in range(12)]
    return spark.createDataFrame(rows, "uuid string, apps array<string>, mass int, mean double").selectExpr("uuid", "'v1' AS os", "'m' AS model", "0D AS time1", "1D AS time2", "apps", "mass", "mean")


def test_row_sets_are_paired_without_daemons(points, monkeypatch):
    seen, pairs = [], C.similar_pairs
    monkeypatch.setattr(C, "similar_pairs", lambda sets, rows: seen.extend(tuple(r["a"]) for r in rows.collect()) or pairs(sets, rows))
    found = {r["uuid"]: r["n_similar"] for r in C.similar_users(points, ["d1", "d2*"]).collect()}
    assert sorted(seen) == [("a0",), ("a0", "a1"), ("a0", "a1", "a2"), ("a0", "a1", "a2", "a3")]  # 48 sets with their daemons
    rows = [set(r["apps"]) for r in points.collect()]
    assert found["u2"] == sum(len(r & {"a0", "a1", "a2", "a3"}) >= 2 for r in rows) and found["u1"] == sum(len(r & {"a0", "a1", "a2"}) >= 2 for r in rows)


def test_rates_are_not_shuffled_to_their_buckets(spark):
    rates = spark.createDataFrame([(1, 0.01, None, None), (2, 0.03, None, None), (3, 0.015, 0.0, 0.03), (4, 0.021, 0.02, 0.022)], "rate_id long, rate double, rate_lo double, rate_hi double")
    prior = D.a_priori(rates)
    known = D.rate_points(rates, prior).withColumn("xmax", F.lit(0.03)).collect()
    rows = spark.createDataFrame(known, "rate_id long, rate double, rate_lo double, rate_hi double, slice long, below long, mass int, mean double, xmax double")
    masses = D.bucket_masses(rows, prior, 20)
    plan = plan_of(masses)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "Union" not in plan
    assert {(r["rate_id"], round(r["mass"], 9)) for r in masses.collect()} == {(1, 1.0), (2, 1.0), (3, 1.0)}  # 4 holds no value


def test_points_carry_what_comparisons_use(spark):
    points, prior = standins.points(spark, "/root/testdata/sf0.001")
    assert not {"features", "events", "level1", "level2"} & set(points.columns)
    assert "HashAggregate" not in plan_of(prior)  # written, not made again by each reader
    whole = D.a_priori(standins.rates(spark, "/root/testdata/sf0.001"))
    assert sorted(map(tuple, prior.collect())) == sorted(map(tuple, whole.collect()))


def test_filled_histograms(spark):
    table = spark.createDataFrame([(1, [(0, 2.0), (3, 1.0)]), (2, [(99, 4.0)]), (3, None)], "id int, h array<struct<bucket:int,mass:double>>")
    rows = table.select("id", stored.filled(F.col("h")).alias("d"), stored.shares(F.col("h")).alias("s"))
    found = {r["id"]: r for r in rows.collect()}
    assert all(len(r["d"]) == stored.BUCKETS for r in found.values())
    assert [{i: x for i, x in enumerate(found[k]["d"]) if x} for k in (1, 2, 3)] == [{0: 2.0, 3: 1.0}, {99: 4.0}, {}]
    assert found[1]["s"] == [(0, 2 / 3), (3, 1 / 3)] and found[3]["s"] is None


def test_rows_of_a_stream_wait_without_calls_for_each_series(spark, tmp_path):
    rows = spark.readStream.schema("series_id long, num long, ts timestamp, k string").parquet(str(tmp_path))
    plan = streams.stream_buckets(rows, lambda r: r.k, time="ts", late="1 day")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "FlatMapGroupsInPandasWithState" in plan


def test_waiting_rows_leave_in_their_order_and_a_silent_series_begins_anew():
    class State:
        exists, watermark = False, 0
        def __getattr__(self, _): return lambda *x: None
        def getCurrentWatermarkMs(self): return self.watermark
        def update(self, value): self.get, self.exists = value, True
        def remove(self): self.exists = False
        def setTimeoutTimestamp(self, ms): self.timeout = ms

    class Count:
        def reset(self): self.n = 0

    def step(held, row):
        held.detector.n += 1
        yield (row.num,), held.detector.n

    fold, state = streams.in_order(Count, step, ["num"], ["num", "n"], "num", 10_000_000), State()
    call = lambda *rows: [tuple(r) for f in fold((), iter([pd.DataFrame(rows, columns=["num", "__at"])]), state) for r in f.itertuples(index=False)]
    assert call((3, 3_000_500), (1, 1_000_000), (2, 1_000_000)) == [] and state.timeout == 999
    state.watermark = 1000
    assert call() == [(1, 1), (2, 2)] and state.timeout == 3000  # called when the watermark is beyond 3000
    state.watermark = 3001
    assert call() == [(3, 3)] and state.timeout == 13000
    state.watermark = 14000
    assert call((9, 13_900_000)) == [(9, 1)]
    state.watermark = 24000
    assert call() == [] and not state.exists
    fold, state = streams.in_order(Count, step, ["num"], ["num", "n"], "num", None, ["num"]), State()
    assert call((5, 2_000_000), (6, 1_000_000), (5, 3_000_000)) == []
    state.watermark = 2000
    assert sorted(call()) == [(5, 1), (6, 1)] and state.timeout == 2999  # series of one state, each with its own count


def test_states_of_series_hold_no_classes_or_functions():
    make = lambda: segments.MovingAverageDetector(5.0, 3, lambda_of_p)
    saved, held = streams.Saved(make, ["p"]), segments.Held(make())
    rows = [segments.Row(["p"], (float(x),)) for x in (1, 7, 9)]
    list(segments.run_step(held, rows[0]))
    body = saved.dumps((held, [(1, 2, (3.0,))], 4))
    assert len(body) < 1000
    again = streams.Saved(make, ["p"]).loads(body)
    assert type(again[0]) is segments.Held and again[0].detector.__dict__.keys() == held.detector.__dict__.keys() and again[1:] == ([(1, 2, (3.0,))], 4)
    of = lambda state: [(row.p, n) for r in rows[1:] for row, n in segments.run_step(state, r)]
    assert of(again[0]) == of(held) != []


def lambda_of_p(row):
    return row.p
