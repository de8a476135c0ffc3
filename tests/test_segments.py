import pytest
from pyspark.sql import functions as F

from ohmline.operators import segments as G
from ohmline.operators import series as S
from ohmline.shared import ship

ship(__name__)
TOY = [0] * 5 + [2] * 5 + [0] * 5 + [2] * 10 + [0, 2, 0, 0, 0]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(TOY)], "series_id string, num long, p double")


@pytest.mark.parametrize("parts", [1, 2, 4, 7])
@pytest.mark.parametrize("chunk", [None, 2, 3, 7, 100])
def test_runs_do_not_depend_on_partitions_or_chunks(toy, parts, chunk):
    found = G.detect_runs(toy.repartition(parts), 1, 2, power="p", chunk_rows=chunk)
    rows = found.groupBy("run_id").agg(F.sort_array(F.collect_list("num")).alias("n")).orderBy("run_id").collect()
    assert [r["n"] for r in rows] == [list(range(4, 11)), list(range(14, 28))]


def test_user_detectors_agree(toy):
    found = G.detect_runs_with(toy, lambda: G.MovingAverageDetector(1, 2, lambda r: r.p))
    assert sorted((r["run_id"], r["num"]) for r in found.collect()) == [(1, n) for n in range(4, 11)] + [(2, n) for n in range(14, 28)]


class Toggle:
    """In a run from an odd number of large rows up to the next: it never forgets, so no guess about a chunk is safe."""

    def reset(self):
        self.large = 0
        self.rows = []

    def update(self, row):
        self.large += row.p >= 8
        self.rows = [*self.rows[-2:], row]

    def ready(self):
        return True

    def in_run(self):
        return self.large % 2 == 1

    def lead_in(self):
        return self.rows[:-1]


class Hysteresis:
    """In a run from a row above 8 until a row below 2; what is between depends on rows any way back."""

    def reset(self):
        self.on = False

    def update(self, row):
        self.on = row.p > 8 or (self.on and row.p >= 2)

    def ready(self):
        return True

    def in_run(self):
        return self.on

    def lead_in(self):
        return []


@pytest.mark.parametrize("make", [lambda: G.MovingAverageDetector(5, 4, lambda r: r.p), Toggle, Hysteresis])
def test_chunks_change_nothing_for_user_detectors(spark, make):
    import random

    rng = random.Random(7)
    rows = [(name, n * step, float(rng.choice((1, 3, 4, 5, 6, 7, 9)))) for name, count, step in ((None, 90, 1), ("s", 200, 3), ("t", 1, 1)) for n in range(count)]
    df = spark.createDataFrame(rows, "series_id string, num long, p double").repartition(3)
    found = lambda **options: sorted(map(str, map(tuple, G.detect_runs_with(df, make, **options).select("series_id", "run_id", "num").collect())))
    whole = found()
    assert len(whole) > 50
    for options in ({"chunk_rows": 16, "halo": 4}, {"chunk_rows": 50, "halo": 0}, {"chunk_rows": 40, "halo": 9, "rounds": 1}, {"chunk_rows": 1000}):
        assert found(**options) == whole, options


def test_buckets_of_user_detectors_by_chunk(spark):
    rows = [(i % 2, i, "ab"[i // 7 % 3 == 1]) for i in range(300)]
    df = spark.createDataFrame(rows, "series_id long, num long, k string")
    make = lambda: G.KeyChangeDetector(lambda r: r.k)
    whole = sorted(map(tuple, G.bucket_with(df, make).collect()))
    assert sorted(map(tuple, G.bucket_consecutive(df, ["k"]).select("series_id", "num", "k", "bucket_id").collect())) == whole
    for chunk, halo in ((8, 0), (8, 1), (64, 8)):
        assert sorted(map(tuple, G.bucket_with(df, make, chunk_rows=chunk, halo=halo).collect())) == whole


def test_a_wide_window_takes_no_more_work(spark):
    import time

    df = spark.range(200_000).select(F.lit("a").alias("series_id"), F.col("id").alias("num"), (F.col("id") * 7919 % 1000).cast("double").alias("p"))
    took = {}
    for window in (2500, 5, 2500, 5):
        began = time.time()
        G.with_last_sum(df.withColumn("__pos", F.col("num") + 1), ["series_id"], "__pos", "p", window).write.format("noop").mode("overwrite").save()
        took[window] = time.time() - began
    assert took[2500] < 1.5 * took[5] + 0.5


def test_chunk_must_hold_its_halo(toy):
    with pytest.raises(ValueError):
        G.detect_runs(toy, 1, 5, power="p", chunk_rows=3)


def test_run_energy_skips_gaps(spark):
    rows = [(1, 0.0002 * i + (0.0002 if i >= 3 else 0)) for i in range(5)]
    df = spark.createDataFrame([("a", 1, i, t, 100.0, 4.0) for i, (_, t) in enumerate(rows)], "series_id string, run_id long, num long, time_s double, current_ma double, voltage_v double")
    r = G.run_energy(df).first()
    assert r["duration_s"] == pytest.approx(0.0006) and r["watt_hours"] == pytest.approx(3 * 0.0002 * 400 / 1000 / 3600)


@pytest.mark.parametrize("chunk", [None, 1, 2, 5])
def test_buckets_keep_single_rows(spark, chunk):
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate("aabbba")] + [("t", 0, None), ("t", 1, None), ("t", 2, "x")], "series_id string, num long, k string")
    found = G.bucket_consecutive(df, ["k"], chunk_rows=chunk).groupBy("series_id", "bucket_id").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == [("s", 0, 2), ("s", 1, 3), ("s", 2, 1), ("t", 0, 2), ("t", 1, 1)]


def test_bucket_with_user_detector(spark):
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate("aabbba")], "series_id string, num long, k string")
    found = G.bucket_with(df, lambda: G.KeyChangeDetector(lambda r: r.k)).groupBy("bucket_id").count().orderBy("bucket_id").collect()
    assert [tuple(r) for r in found] == [(0, 2), (1, 3), (2, 1)]


def brute_checkpoints(rows, idle, least, interval, shortest):
    """Plain fold over the checkpoints: (start, end, work) of runs and the tail."""
    slots = {}
    last_t = last_p = None
    for t, p in rows:
        s = slots.setdefault(int(t // interval), [[], 0.0, t, t])
        if last_t is not None:
            s[1] += (t - last_t) * last_p
        s[0].append(p)
        s[3] = t
        last_t, last_p = t, p
    order = sorted(slots)
    began, work, out = 0.0, 0.0, []
    for k, n in zip(order, [*order[1:], None]):
        powers, done, _, end = slots[k]
        work += done
        if n is None or sum(powers) / len(powers) >= idle or slots[n][2] <= began:
            continue
        stop = slots[n][2]
        if stop > began + shortest:
            if stop > began + least:
                out.append((began, stop, round(work, 6), False))
                began, work = stop, 0.0
        else:
            began, work = stop, 0.0
    out.append((began, slots[order[-1]][3], round(work, 6), True))
    return out


def test_checkpoint_runs(spark):
    import random

    rng = random.Random(3)
    rows = [(i * 0.1, rng.choice([10.0, 10.0, 300.0])) for i in range(600)]
    df = spark.createDataFrame([("a", i, t, p) for i, (t, p) in enumerate(rows)], "series_id string, num long, time_s double, p double")
    found = S.detect_runs_by_checkpoint(df, 120.0, 5.0, power="p").collect()
    mine = sorted((r["start_s"], r["end_s"], round(r["watt_hours"] * 3.6e6, 6), r["is_tail"]) for r in found)
    want = sorted((a, b, round(w, 6), t) for a, b, w, t in brute_checkpoints(rows, 120.0, 5.0, 0.5, 2.0))
    assert [(a, b, t) for a, b, _, t in mine] == [(a, b, t) for a, b, _, t in want]
    assert [w for *_, w, _ in mine] == pytest.approx([w for *_, w, _ in want])


def test_bad_rows_and_empty_input(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 5.0), ("a", None, 5.0)], "series_id string, num long, p double")
    assert G.detect_runs(df, 1, 1, power="p", chunk_rows=4).count() == 1
    assert G.detect_runs(df.limit(0), 1, 2, power="p").count() == 0
    assert S.downsample_by_count(df.withColumn("time_s", F.lit(0.0)).limit(0), 5, power="p").count() == 0


def test_odd_spans_count_as_2500(spark):
    df = spark.range(3000).select(F.lit("a").alias("series_id"), F.col("id").alias("num"), F.col("id").cast("double").alias("time_s"), F.lit(1.0).alias("p"))
    assert sorted(r["n"] for r in S.downsample_by_count(df, 9000, power="p").collect()) == [500, 2500]


def dense_and_holed(spark, every):
    import random

    rng = random.Random(every)
    rows = [("s", i, 0.5 * i, None if every and i % every == 0 else float(rng.choice([1, 5, 9])), rng.choice("ab")) for i in range(60)]
    rows += [(None, 3 * i, 0.5 * i, float(rng.choice([1, 5, 9])), rng.choice("ab")) for i in range(25)]  # a null series, with holes in its order
    return spark.createDataFrame(rows, "series_id string, num long, time_s double, p double, k string")


@pytest.mark.parametrize("every", [0, 2, 5, 7])
def test_chunks_change_nothing(spark, every):
    """Runs, buckets and the series operators, for chunk sizes from the halo on, with null powers in any pattern."""
    df = dense_and_holed(spark, every)
    known = df.where("p is not null")
    forms = {
        "runs": lambda c: G.detect_runs(df, 5, 3, power="p", chunk_rows=c).select("series_id", "run_id", "num"),
        "buckets": lambda c: G.bucket_consecutive(dense_and_holed(spark, every), ["k"], chunk_rows=c).select("series_id", "bucket_id", "num"),
        "gaps": lambda c: S.find_gaps(known, step=0.5, tolerance=0.1, chunk_rows=c),
        "integral": lambda c: S.integrate_power(known, power="p", ends="k = 'a'", chunk_rows=c),
        "blocks": lambda c: S.downsample_by_count(known, 4, power="p", chunk_rows=c),
        "curve": lambda c: S.battery_curve(known, 100.0, 1.0, span=5, current="p", chunk_rows=c),
        "means": lambda c: S.battery_curve_by_mean(known, 100.0, "timestamp'2024-01-01 00:00:00'", span=5, current="p", chunk_rows=c),
        "marks": lambda c: S.idle_marks(known, 4.0, power="p", interval=2.0, chunk_rows=c),
        "energy": lambda c: G.run_energy(G.detect_runs(known, 5, 3, power="p"), power="p", step=0.5, tolerance=0.1, chunk_rows=c),
    }
    plain = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows.collect())
    for name, form in forms.items():
        whole = plain(form(None))
        for chunk in (3, 8, 100) if every else (4,):
            assert plain(form(chunk)) == whole, (name, chunk)


def test_slopes_of_one_long_series_take_linear_time(spark):
    import time

    n = 120_000
    points = spark.range(n).select(F.lit("a").alias("series_id"), F.col("id").cast("double").alias("time_s"), (F.col("id") % 7).cast("double").alias("value"))
    intervals = spark.range(200).select(F.col("id").alias("interval_id"), (F.col("id") * 500.0 + 0.5).alias("t0"), (F.col("id") * 700.0 + 3.5).alias("t1"))
    began = time.time()
    found = {r["interval_id"]: r["slope"] for r in S.slopes_between(points, intervals).collect()}
    assert time.time() - began < 60
    for i, slope in found.items():
        a, b = min(i * 500 + 1, n - 1), min(i * 700 + 4, n - 1)
        assert slope == (None if a == b else pytest.approx((a % 7 - b % 7) / (b - a)))


def test_random_intervals_lie_in_the_span(spark):
    points = spark.createDataFrame([(float(t),) for t in (5, 9, 25)], "time_s double")
    rows = S.random_intervals(points, 50).collect()
    assert len(rows) == 50 and all(5 <= r["t0"] <= r["t1"] <= 25 for r in rows) and len({r["t0"] for r in rows}) == 50
    assert rows == S.random_intervals(points, 50).collect()
