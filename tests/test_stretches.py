"""Operators that look along a long file or series, for any size of the stretches that tasks work on."""

import random

import pytest
from pyspark.sql import functions as F

from ohmline.operators import logs as L
from ohmline.operators import segments as G
from ohmline.operators import series as S
from ohmline.sources import readers


@pytest.mark.parametrize("stretch", [1, 7, 64, 10_000])
def test_latest_values_by_stretch(spark, stretch):
    rng = random.Random(stretch)
    rows = [(f, 5 * i + rng.randrange(5), rng.choice((None, None, None, None, "x", "y", "z")), rng.choice((None, None, 3))) for f in ("a", None) for i in range(150)]
    rows += [("only", 3, None, 1), ("none", 9, None, None)]
    df = spark.createDataFrame(rows, "file string, pos long, word string, n long")
    found = {(r["file"], r["pos"]): (r["word"], r["latest"]) for r in G.with_latest(df, ["file"], "pos", stretch, word=F.col("word"), latest=F.col("n") + 1).collect()}
    assert len(found) == len(rows)
    word, n = {}, {}
    for f, pos, w, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        word[f], n[f] = word.get(f) if w is None else w, n.get(f) if x is None else x + 1
        assert found[f, pos] == (word[f], n[f])


def test_one_long_file_takes_many_tasks(spark, tmp_path):
    lines = []
    for i in range(60_000):
        lines.append(f"level: {i % 100}" if i % 7 == 0 else f"Mon Jan {1 + i % 28} 10:{i % 60:02d}:00 UTC 2024")
    (tmp_path / "log").write_text("\n".join(lines))
    read = readers.text_lines(spark, str(tmp_path))
    one, many = (sorted(map(tuple, readers.parse_battery_log(read, stretch=s).select("pos", "ts", "level").collect())) for s in (None, 100_000))
    assert one == many and len(one) == sum(i % 7 > 0 for i in range(60_000))
    one, many = (sorted(map(tuple, readers.battery_log_of_day(read, "Jan 20", stretch=s).select("pos", "time", "level").collect())) for s in (None, 100_000))
    assert one == many and len(one) > 8000
    text = "concat('u', pos, ' app fractions: ')"
    marked = read.withColumn("value", F.when(F.col("pos") % 11 == 0, F.expr(text)).otherwise(F.concat(F.lit("x 1 "), (F.col("pos") % 2).cast("string"))))
    one, many = (sorted(map(tuple, L.section_filter(marked, stretch=s).select("pos", "uuid").collect())) for s in (None, 50_000))
    assert one == many and len(one) > 50_000


def test_long_schedules_meet_by_bin(spark):
    rng = random.Random(1)
    edges = sorted(rng.sample(range(100_000), 4000))
    schedule = [(f"l{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(edges[::2], edges[1::2]))] + [("empty", 5.0, 5.0), ("back", 9.0, 3.0), ("far", 1e9, 1e9 + 5)]
    rows = [(i, rng.choice((rng.uniform(-10, 100_010), float(rng.choice(edges))))) for i in range(3000)] + [(3000, None), (3001, 1e9 + 1), (3002, -1e12), (3003, 1e12)]
    df, slots = spark.createDataFrame(rows, "n long, time_s double"), spark.createDataFrame(schedule, "label string, start_offset_s double, end_offset_s double")
    labelled = S.label_by_schedule(df, slots, "base")
    assert labelled.columns == ["n", "time_s", "label"]
    found = {r["n"]: r["label"] for r in labelled.collect()}
    for n, t in rows:
        assert found[n] == next((name for name, a, b in schedule if t is not None and a < t < b), "base")
    assert "NestedLoop" not in labelled._jdf.queryExecution().toString()
    assert {r["label"] for r in S.label_by_schedule(df, slots.limit(0), "base").collect()} == {"base"}


@pytest.mark.parametrize("points_a_range", [1, 5, 40, 10_000])
def test_slopes_by_ranges_of_time(spark, points_a_range):
    rng = random.Random(3)
    points = [(s, float(t), rng.uniform(0, 9)) for s, n in (("a", 90), (None, 30), ("one", 1)) for t in rng.sample(range(1000), n)]
    intervals = [(i, *sorted((rng.uniform(-50, 1050), float(rng.randrange(1000))))) for i in range(40)]
    df = spark.createDataFrame([*points, ("a", None, 1.0)], "series_id string, time_s double, value double")
    found = {(r["series_id"], r["interval_id"]): r["slope"] for r in S.slopes_between(df, spark.createDataFrame(intervals, "interval_id long, t0 double, t1 double"), range_points=points_a_range).collect()}
    assert len(found) == 120
    for s in ("a", None, "one"):
        own = sorted((t, v) for name, t, v in points if name == s)
        for i, t0, t1 in intervals:
            p, q = (next((x for x in own if x[0] >= t), own[-1]) for t in (t0, t1))
            assert found[s, i] == (None if p[0] == q[0] else pytest.approx((p[1] - q[1]) / (q[0] - p[0])))
