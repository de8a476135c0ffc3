import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmline.operators import rates as R
from ohmline.sources import readers, sinks


def text(s):
    return bytes([len(s)]) + s.encode()


def capture(samples, mask=0x1000 | 0x4000, revision=4, leds=0, rate=5):
    header = struct.pack("<i", 212) + text("x" * 20) + struct.pack("<iq", 1, 2) + text("serial") + struct.pack("<iifif", 0, 0, 4.0, 5000, 5000.0) + struct.pack("<iii", 0, 0, 0)
    header += text("setting") + text("v1") + struct.pack("<iiq", 0, 0, len(samples)) + struct.pack("<HHHHHHHH", 272, 60, 1024, 6, 0, 0, 0, mask)
    status = bytearray(60)
    status[20], status[24], status[28], status[44] = 170, leds, rate, revision
    status[40:42], status[42:44] = struct.pack("<H", 8000), struct.pack("<H", 16000)
    content = bytearray(1024)
    content[: len(header)], content[272:332] = header, status
    return bytes(content) + b"".join(struct.pack("<HHH", *(v & 0xFFFF for v in s)) for s in samples) + b"\x01"


def test_power_captures(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(capture([(1000, -2000, 32000), (1001, 4, 32003), (0x8001, 0, 32000), (2, 2, 0xFFFF)]))
    (tmp_path / "two.bin").write_bytes(capture([(10, 20, 16000)], revision=1, leds=8))
    rows = readers.read_power_captures(spark, str(tmp_path)).orderBy("series_id", "num").collect()
    assert [r["num"] for r in rows] == [0, 1, 2, 3, 0] and [r["time_s"] for r in rows[:4]] == [i / 5000 for i in range(4)]
    a, b, c, d, e = rows
    assert (a["main_ma"], a["aux_ma"], a["usb_ma"]) == (1.0, -2.0, 0.0) and a["main_v"] == pytest.approx(4.0) and a["aux_v"] == pytest.approx(2.0)
    assert b["main_ma"] == 250.0 and b["marker0"] and b["marker1"] and b["main_v"] == pytest.approx(4.0)
    assert c["missing"] and d["missing"] and c["main_ma"] == 0.0 and d["main_v"] == pytest.approx(3.7)
    assert e["aux_v"] == pytest.approx(1.0) and e["main_v"] == pytest.approx(3.7) and e["usb_v"] == pytest.approx(0.5)


def test_captures_by_range(spark, tmp_path):
    import random

    rng = random.Random(8)
    samples = [(rng.randrange(65536), rng.randrange(65536), rng.randrange(65536)) for _ in range(1000)]
    (tmp_path / "a.bin").write_bytes(capture(samples))
    (tmp_path / "b.bin").write_bytes(capture(samples[:7], mask=0x1000 | 0x2000 | 0x4000))  # eight bytes a sample: five whole ones
    (tmp_path / "c.bin").write_bytes(capture([]))
    whole = readers.decode_captures(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    want = sorted(map(tuple, whole.collect()))
    for n in (1, 7, 250, 1000, 5000):
        found = readers.read_power_captures(spark, str(tmp_path), samples=n)
        assert sorted(map(tuple, found.collect())) == want
    assert len(want) == 1005


def test_a_capture_beyond_two_gigabytes(spark, tmp_path):
    content = capture([])[:1024]
    with (tmp_path / "large.bin").open("wb") as file:  # zeros are not stored
        file.write(content)
        file.truncate(1024 + 6 * 520_000_000 + 3)
    ranges = readers.capture_ranges(spark, str(tmp_path))
    assert ranges.count() == 1 + (1024 + 6 * 520_000_000 + 3) // 4 // readers.CAPTURE_RANGE
    some = ranges.where("first in (0, 515000000, 520000000, 525000000)")
    found = readers.read_capture_ranges(some).groupBy(F.floor(F.col("num") / 5_000_000).alias("k")).agg(F.min("num").alias("a"), F.max("num").alias("b"), F.count("*").alias("n")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in found] == [(0, 4_999_999, 5_000_000), (515_000_000, 519_999_999, 5_000_000)]
    assert readers.read_capture_ranges(ranges).rdd.getNumPartitions() >= 32


def test_measurement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("num;time;mA;V\n1;0.0002;100;4\n2;x;100;4\n3;0.0006;100\n")
    rows = readers.read_measurements(spark, str(tmp_path), separator=";").collect()
    assert sorted((r["num"] or 0, r["bad"]) for r in rows) == [(0, True), (1, False), (2, True), (3, True)]
    zero = readers.read_short_measurements(spark, str(tmp_path), separator=";").agg(F.sum("current_ma")).first()[0]
    assert zero == 100.0


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "log").write_text("level: 99\nMon Jan 1 10:00:00 UTC 2024\nlevel: 98\nTue Jan 2 10:00:00 UTC 2024\nWed Jan 3 10:00:00 UTC 2024\n")
    log = readers.parse_battery_log(readers.text_lines(spark, str(tmp_path)))
    assert [r["level"] for r in log.orderBy("pos").collect()] == [99, 98, 98]
    assert readers.battery_start(log).first()["start_level"] == 99


def test_saving_replaces_and_results_keep_other_natures(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        readers.save_replacing(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    hog = spark.createDataFrame([("hog", "a", 0.5)], "nature string, key1 string, distance double")
    bug = spark.createDataFrame([("bug", "b", 0.5)], "nature string, key1 string, distance double")
    for rows in (hog, bug, hog.withColumn("key1", F.lit("c"))):
        sinks.write_results(rows, f"{path}-results")
    assert sorted((r["nature"], r["key1"]) for r in spark.read.parquet(f"{path}-results").collect()) == [("bug", "b"), ("hog", "c")]


def test_expired_results(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "nature string, key1 string, key2 string")
    old = rows(("hog", "a", None), ("hog", "gone", None), ("bug", "a", "u"), ("bug", "b", "u"), ("bug", "s", "u"), ("os", "v1", None))
    new = rows(("hog", "a", None), ("bug", "a", "u"), ("bug", "b", "u"), ("bug", "s", "u"), ("os", "v1", None))
    kept = sinks.expire_results(old, new, spark.createDataFrame([("s",)], "app string"))
    assert sorted((r["nature"], r["key1"]) for r in kept.collect()) == [("bug", "b"), ("hog", "a"), ("os", "v1")]


def test_untyped_numbers_and_freshness(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("1,5",), ("x",)], "t string")
    whole, real = readers.numbers(F.col("t"))
    assert [tuple(r) for r in df.select(whole, real).collect()] == [(12, None), (None, 1.5), (None, 1.5), (None, None)]
    assert readers.is_stale(0, 7201) and not readers.is_stale(0, 7200)


def test_features_merge_by_key(spark):
    df = spark.createDataFrame([({"a": ["1", "2"], "b": ["x"]}, {"a": ["2", "3"], "c": ["y"]})], "l map<string,array<string>>, r map<string,array<string>>")
    assert df.select(R.merged_features(F.col("l"), F.col("r"))).first()[0] == {"a": ["1", "2", "3"], "b": ["x"], "c": ["y"]}


def test_charging_and_zero_pairs_are_told_apart(spark):
    rows = [("u", float(t), lv, "batterylevelchanged", st, ["m"], "o", "m") for t, lv, st in [(0, 0.9, "unplugged"), (100, 0.8, "unplugged"), (200, 0.8, "unplugged"), (300, 0.7, "charging"), (400, 0.9, "unplugged"), (10**6, 0.8, "unplugged"), (2 * 10**6, 0.9, "unplugged"), (3 * 10**6, 0.0, "unplugged"), (4 * 10**6, 0.0, "unplugged")]]
    s = spark.createDataFrame(rows, "uuid string, time double, level double, event string, state string, apps array<string>, os string, model string")
    found = [r["reject_reason"] for r in R.classified_pairs(s).orderBy("time2").collect()]
    assert found == ["abandoned", "zero drain", "charging", "charging", None, "negative drain", None, "all zero"]


def test_asof_of_one_large_device_takes_linear_time(spark):
    import time

    n = 80_000
    samples = spark.range(n).select(F.lit("u").alias("uuid"), F.col("id").cast("double").alias("time"))
    regs = spark.range(40).select(F.lit("u").alias("uuid"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("os"), F.lit("m").alias("model"), (F.col("id") * 1000.0 + 5000).alias("time"))
    R.asof_os_model(samples.limit(10), regs).count()
    began = time.time()
    rows = R.asof_os_model(samples, regs).collect()
    assert time.time() - began < 20
    assert len(rows) == n and all(r["os"] == f"v{max(0, min(39, int(r['time'] - 5000) // 1000))}" for r in rows)


def test_asof_against_brute_force(spark):
    import random

    rng = random.Random(2)
    regs = [(rng.choice("abc"), f"v{i}", f"m{i}", float(rng.randrange(20))) for i in range(12)]
    samples = [(rng.choice("abcd"), float(rng.randrange(25)), i) for i in range(80)]
    found = R.asof_os_model(spark.createDataFrame(samples, "uuid string, time double, n int"), spark.createDataFrame(regs, "uuid string, os string, model string, time double"))
    for r in found.collect():
        mine = sorted((t, o, m) for u, o, m, t in regs if u == r["uuid"])
        upto = [x for x in mine if x[0] <= r["time"]]
        want = upto[-1] if upto else mine[0] if mine else (None, None, None)
        assert (r["os"], r["model"]) == want[1:]


def test_lines_of_a_file_read_in_blocks_keep_their_order(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("\r\n".join(["one", "", "two"]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = readers.text_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [r["value"] for r in sorted((r for r in rows if r["file"].endswith(name)), key=lambda r: r["pos"])]
    assert of("a.log") == lines and of("b.log") == ["one", "two"]
    assert len({r["pos"] for r in rows if r["file"].endswith("a.log")}) == len(lines)


@pytest.mark.parametrize("broken", ["rows", "before the manifest", "manifest", "rename"])
def test_a_load_that_breaks_off_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, broken):
    kept, mark = f"{tmp_path}/t", f"{tmp_path}/mark"
    rows = lambda *t: spark.createDataFrame([(float(x),) for x in t], "time double")
    load = lambda df: sorted(r["time"] for r in readers.load_incrementally(df, kept, mark).collect())
    assert load(rows(1, 2)) == [1, 2]

    def fail(*args, **options):
        raise OSError("broken off")

    with monkeypatch.context() as patched:
        if broken == "rows":
            bad = rows(1, 2, 3).withColumn("time", F.when(F.col("time") < 3, F.col("time")).otherwise(F.raise_error("broken off").cast("double")))
        else:
            bad = rows(1, 2, 3)
            if broken == "before the manifest":
                patched.setattr(readers, "commit_manifest", fail)
            elif broken == "manifest":
                patched.setattr(readers.uuid, "uuid4", iter([readers.uuid.UUID(int=1)]).__next__)
            else:
                own = readers.filesystem
                patched.setattr(readers, "filesystem", lambda s, p: fail() if p.endswith("/2") else own(s, p))
        with pytest.raises(Exception):
            load(bad)
    assert readers.saved_watermark(spark, mark) == 2 and sorted(r["time"] for r in readers.read_kept(spark, kept, mark, "time double").collect()) == [1, 2]
    assert load(rows(1, 2, 3, 4)) == [1, 2, 3, 4] and load(rows(1, 2, 3, 4)) == [1, 2, 3, 4] and load(rows(4, 5)) == [1, 2, 3, 4, 5]
    readers.clean_kept(spark, kept, mark, keep=1)
    assert load(rows(5, 6)) == [1, 2, 3, 4, 5, 6] and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 4


def test_rows_that_come_while_a_load_runs_are_not_skipped(spark, tmp_path, monkeypatch):
    source, kept, mark = f"{tmp_path}/s", f"{tmp_path}/t", f"{tmp_path}/mark"
    put = lambda *t: spark.createDataFrame([(float(x),) for x in t], "time double").write.mode("append").parquet(source)
    put(1, 2)
    own = readers.commit_manifest
    monkeypatch.setattr(readers, "commit_manifest", lambda *a: (put(3), own(*a)))
    first = readers.load_incrementally(spark.read.schema("time double").parquet(source), kept, mark)
    assert sorted(r["time"] for r in first.collect()) == [1, 2] and readers.saved_watermark(spark, mark) == 2
    monkeypatch.undo()
    again = readers.load_incrementally(spark.read.schema("time double").parquet(source), kept, mark)
    assert sorted(r["time"] for r in again.collect()) == [1, 2, 3]


def test_loading_all_or_nothing(spark, tmp_path):
    rows = lambda *t: spark.createDataFrame([(float(x),) for x in t], "time double")
    load = lambda df: sorted(r["time"] for r in readers.load_incrementally(df, f"{tmp_path}/t", f"{tmp_path}/mark", merge=False).collect())
    assert load(rows(1, 2)) == [1, 2] and load(rows(0, 1, 2)) == [1, 2] and load(rows(0, 3)) == [0, 3]
    assert readers.saved_watermark(spark, f"{tmp_path}/mark") == 3 and readers.saved_watermark(spark, f"{tmp_path}/none") is None


def test_runs_on_a_stream_reach_back_over_batches(spark, tmp_path):
    from ohmline.operators import segments as G
    from ohmline.streaming import streams

    table = spark.createDataFrame([("s", i, float(p)) for i, p in enumerate([0, 0, 9, 9, 9, 0, 0, 0, 9, 9])], "series_id string, num long, p double")
    out = []
    for a, b in ((0, 3), (3, 5), (5, 10)):
        table.where(f"num >= {a} and num < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = streams.stream_runs(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), 5, 3, lambda r: r.p).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    out = sorted((r["run_id"], r["num"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((r["run_id"], r["num"]) for r in G.detect_runs(table, 5, 3, power="p").collect())
    assert out == want and len({r for r, _ in out}) == 2
