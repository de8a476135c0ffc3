"""Readers, parsers and generators. Files are read by Spark with a fixed schema; bad fields become null."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmline.operators.segments import positioned, with_latest
from ohmline.shared import cut, ship

ship(__name__)

#: Attribute names of a sample that are columns of their own.
KNOWN_ATTRIBUTES = ("uuid", "timestamp", "batteryLevel", "triggeredBy", "batteryState", "processList")
DATE_FORMAT = "EEE MMM dd HH:mm:ss zzz yyyy"
MONTH_SECONDS = 31 * 24 * 3600


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value) of the lines of text files; ``pos`` rises within a file.

    A large file is read in blocks. A line's place is where its block begins plus its number in the task that reads it,
    which is less than the bytes of a block, so the places of a block's lines come before those of the next block.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + in_task).alias("pos"), "value")
    return lines.where("value <> ''")


def measurement_columns(fields: Column, on_bad: str = "null") -> list[Column]:
    value = lambda i, kind: F.get(fields, F.lit(i)).try_cast(kind)
    columns = {"num": value(0, "long"), "time_s": value(1, "double"), "current_ma": value(2, "double"), "voltage_v": value(3, "double")}
    bad = F.lit(False)
    for c in columns.values():
        bad = bad | c.isNull()
    filled = [(F.when(bad, F.lit(0)).otherwise(c) if on_bad == "zero" else c).alias(n) for n, c in columns.items()]
    return [*filled, bad.alias("bad")]


def parse_measurements(lines: DataFrame, *, separator: str = ",", text: str = "value", on_bad: str = "null", series: str | Column = "file") -> DataFrame:
    """(series_id, num, time_s, current_ma, voltage_v, bad) of lines of four numbers."""
    name = F.col(series) if isinstance(series, str) else series
    return lines.select(name.alias("series_id"), *measurement_columns(F.split(text, f"\\Q{separator}\\E"), on_bad))


def read_measurements(spark: SparkSession, path: str, *, separator: str = ",", on_bad: str = "null") -> DataFrame:
    """Measurements of comma-separated files, a series for each file; headers and bad lines are flagged or zeroed."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_measurements(lines, separator=separator, on_bad=on_bad)


def read_short_measurements(spark: SparkSession, path: str, **options) -> DataFrame:
    """(series_id, time_s, current_ma, voltage_v): the form without numbers; bad rows become zeros."""
    return read_measurements(spark, path, on_bad="zero", **options).select("series_id", "time_s", "current_ma", "voltage_v")


def parse_node_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """tag, epoch, date, node, month, day, time, hour, rest of space-separated log lines."""
    part = F.split(text, " ", 8)
    at = lambda i: F.get(part, F.lit(i))
    keep = [c for c in lines.columns if c != text]
    return lines.select(
        *keep,
        at(0).alias("tag"),
        at(1).try_cast("long").alias("epoch"),
        at(2).alias("date"),
        at(3).alias("node"),
        at(4).alias("month"),
        at(5).try_cast("int").alias("day"),
        at(6).alias("time"),
        F.substring_index(at(6), ":", 1).try_cast("int").alias("hour"),
        at(7).alias("rest"),
    )


def read_node_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_node_logs(spark.read.text(path))


#: Units of a line's place in its file, bytes or lines, that a task fills forward at a time.
STRETCH = 16_000_000


def parse_battery_log(lines: DataFrame, *, text: str = "value", order: str = "pos", file: str = "file", stretch: int | None = STRETCH) -> DataFrame:
    """(file, pos, ts, level) of each date line, with the latest level line before it (0 if there is none).

    A file is worked on in stretches of its places, so that a long one takes many tasks.
    """
    level = F.regexp_extract(text, r"level:\s*(\d+)", 1).try_cast("int")
    stamp = F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^\w{3} ", ""), F.lit("MMM d HH:mm:ss zzz yyyy"))
    seen = with_latest(lines.withColumn("ts", F.when(level.isNull(), stamp)), [file], order, stretch, level=level)
    return seen.where("ts is not null").select(file, order, "ts", F.coalesce("level", F.lit(0)).alias("level"))


def battery_start(log: DataFrame, file: str = "file", order: str = "pos") -> DataFrame:
    """(file, start_ts, start_level) of a battery log."""
    return log.groupBy(file).agg(F.min_by("ts", order).alias("start_ts"), F.min_by("level", order).alias("start_level"))


def battery_log_of_day(lines: DataFrame, day: str, *, text: str = "value", order: str = "pos", file: str = "file", stretch: int | None = STRETCH) -> DataFrame:
    """(file, pos, time, level) of level lines from the first line that names the day on, with the time of the last such line."""
    dated = F.col(text).contains(day)
    clock = F.when(dated, F.element_at(F.split(text, r"\s+"), 4))
    level = F.regexp_extract(text, r"level:\s*(\d+)", 1).try_cast("int")
    seen = with_latest(lines.withColumn("level", level), [file], order, stretch, time=clock)
    return seen.where("time is not null and level is not null").select(file, order, "time", "level")


def parse_fleet_text(lines: DataFrame, text: str = "value") -> DataFrame:
    """Samples of lines ``date, uid, level %, events, app, ...``."""
    part = F.split(text, ",[ ]*")
    at = lambda i: F.get(part, F.lit(i))
    events = F.split(at(3), " ")
    apps = F.transform(F.slice(part, 5, F.greatest(F.size(part) - 4, F.lit(0))), lambda a: F.trim(a))
    stamp = F.try_to_timestamp(F.regexp_replace(at(0), r"^\w{3} ", ""), F.lit("MMM d HH:mm:ss zzz yyyy"))
    return lines.where(F.size(part) >= 4).select(
        at(1).alias("uuid"),
        F.unix_timestamp(stamp).cast("double").alias("time"),
        (at(2).try_cast("double") / 100).alias("level"),
        F.get(events, F.lit(0)).alias("event"),
        F.when(F.array_contains(events, "pluggedin"), "charging").otherwise("unplugged").alias("state"),
        apps.alias("apps"),
    )


def app_names(processes: Column) -> Column:
    """Names of process entries ``pid;name``; an entry without a name gives the empty string."""
    return F.transform(processes, lambda x: F.coalesce(F.trim(F.get(F.split(x, ";"), F.lit(1))), F.lit("")))


def load_samples(items: DataFrame) -> DataFrame:
    """Samples of raw items: missing texts become empty, the time 0; map entries that are no known attribute are features."""
    features = F.map_filter("attributes", lambda k, _: ~k.isin(*KNOWN_ATTRIBUTES))
    get = lambda name: F.try_element_at(F.col("attributes"), F.lit(name))
    text = lambda name: F.coalesce(get(name), F.lit(""))
    return items.select(
        text("uuid").alias("uuid"),
        F.coalesce(get("timestamp").try_cast("double"), F.lit(0.0)).alias("time"),
        get("batteryLevel").try_cast("double").alias("level"),
        F.lower(text("triggeredBy")).alias("event"),
        F.lower(text("batteryState")).alias("state"),
        app_names("process_list").alias("apps"),
        features.alias("features"),
    )


def load_registrations(items: DataFrame) -> DataFrame:
    """Registrations with missing texts as empty and a missing time as 0."""
    return items.select(
        F.coalesce("uuid", F.lit("")).alias("uuid"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("os", F.lit("")).alias("os"), F.coalesce(F.col("time").try_cast("double"), F.lit(0.0)).alias("time")
    )


def latest_registrations(regs: DataFrame) -> DataFrame:
    """Model and OS of each device's latest registration."""
    last = F.max_by(F.struct("model", "os"), F.struct("time", "os", "model"))
    return regs.groupBy("uuid").agg(last.alias("__l")).select("uuid", F.col("__l.model").alias("model"), F.col("__l.os").alias("os"))


def append_accumulated(before: DataFrame, more: DataFrame) -> DataFrame:
    return before.unionByName(more, allowMissingColumns=True)


def scan(table: DataFrame, *, equal: dict | None = None, among: dict[str, Sequence] | None = None, above: dict | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet all conditions, with the columns asked for; the file scan takes the filters and columns."""
    for name, value in (equal or {}).items():
        table = table.where(F.col(name) == F.lit(value))
    for name, values in (among or {}).items():
        table = table.where(F.col(name).isin(list(values)))
    for name, value in (above or {}).items():
        table = table.where(F.col(name) > F.lit(value))
    return table.select(*columns) if columns else table


def pages(table: DataFrame, order: str, rows: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``page``: ``rows`` rows to a page in the order of a number column (nulls have no page), a page whole in one partition."""
    return positioned(table, list(keys), order, 100 * rows).withColumn("page", F.floor((F.col("__pos") - 1) / rows)).drop("__pos").repartition(*keys, "page")


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def latest_manifest(spark: SparkSession, mark: str) -> tuple[int, float | None, list[str]]:
    """(number, watermark, folders) of the last manifest at ``mark``; (0, None, []) before the first.

    A manifest is whole as soon as its folder has its number as name, as it is written elsewhere and renamed.
    """
    fs, path = filesystem(spark, mark)
    if not fs.exists(path):
        return 0, None, []
    number = max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)
    if not number:
        return 0, None, []
    row = spark.read.schema("watermark double, folders array<string>").json(f"{mark}/{number}").first()
    return number, row["watermark"], list(row["folders"])


def saved_watermark(spark: SparkSession, path: str) -> float | None:
    """The watermark kept at ``path``; null if there is none yet."""
    return latest_manifest(spark, path)[1]


def read_kept(spark: SparkSession, kept: str, mark: str, schema) -> DataFrame:
    """The rows of the batches that the last manifest names."""
    folders = latest_manifest(spark, mark)[2]
    return spark.read.schema(schema).parquet(*[f"{kept}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def commit_manifest(spark: SparkSession, mark: str, number: int, watermark: float | None, folders: list[str]) -> None:
    """Write the manifest aside and rename it to its number: the batch and its watermark count from then on, together."""
    aside = f"{mark}/_new-{uuid.uuid4().hex}"
    row = spark.createDataFrame([(watermark, folders)], "watermark double, folders array<string>")
    row.coalesce(1).write.json(aside)
    fs, target = filesystem(spark, f"{mark}/{number}")
    if fs.exists(target) or not fs.rename(filesystem(spark, aside)[1], target):
        raise RuntimeError(f"manifest {number} of {mark} is there already: another load came first")


def load_incrementally(table: DataFrame, kept: str, mark: str, *, time: str = "time", merge: bool = True) -> DataFrame:
    """Append what is newer than the watermark to the batches at ``kept``, move the watermark at ``mark``, and read the batches.

    The new rows are written to a folder of their own, the watermark is taken from what was written, and one rename of a manifest
    commits both: a load that breaks off anywhere leaves the last manifest, and its rows are loaded by the next. Rows that
    come into the source meanwhile are newer than the watermark. Without ``merge`` old and new rows are never mixed: if there is
    anything new, a manifest that names the whole table, written anew, follows.
    """
    spark = table.sparkSession
    number, before, folders = latest_manifest(spark, mark)
    fresh = incremental(table, before, time=time)[0]
    if before is not None and not merge:
        if fresh.isEmpty():
            return read_kept(spark, kept, mark, table.schema)
        fresh, folders = table, []
    folder = f"batch-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{kept}/{folder}")
    written = spark.read.schema(table.schema).parquet(f"{kept}/{folder}")
    rows, newest = written.agg(F.count(F.lit(1)), F.max(time).cast("double")).first()
    if rows:
        commit_manifest(spark, mark, number + 1, before if newest is None else newest if before is None else max(before, newest), [*folders, folder])
    return read_kept(spark, kept, mark, table.schema)


def clean_kept(spark: SparkSession, kept: str, mark: str, keep: int = 2) -> None:
    """Delete batches and manifests that the last ``keep`` manifests do not need: those of loads that broke off, and old ones."""
    number = latest_manifest(spark, mark)[0]
    fs, path = filesystem(spark, mark)
    needed = set()
    for status in fs.listStatus(path) if fs.exists(path) else ():
        name = status.getPath().getName()
        if name.isdigit() and int(name) > number - keep:
            needed.update(spark.read.schema("folders array<string>").json(f"{mark}/{name}").first()["folders"])
        else:
            fs.delete(status.getPath(), True)
    fs, path = filesystem(spark, kept)
    for status in fs.listStatus(path) if fs.exists(path) else ():
        if status.getPath().getName() not in needed:
            fs.delete(status.getPath(), True)


def incremental(table: DataFrame, watermark: float | None, *, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Rows newer than the watermark (all, if there is none), and the one-row table of the next watermark."""
    fresh = table if watermark is None else table.where(F.col(time) > watermark)
    mark = fresh.agg(F.max(time).alias("watermark"))
    return fresh, mark if watermark is None else mark.select(F.coalesce("watermark", F.lit(watermark)).alias("watermark"))


def is_stale(saved_at: float, now: float, most_age_s: float = 7200.0) -> bool:
    """Whether saved data are old enough to be refreshed."""
    return now - saved_at > most_age_s


def cached(table: DataFrame) -> DataFrame:
    """The table written to the shared folder and read from there."""
    return cut(table)


def save_replacing(table: DataFrame, path: str) -> None:
    """Write beside ``path``, then swap: the old copy stays until the new one is whole, and is then removed."""
    spark = table.sparkSession
    table.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(f"{path}.old"), True)
        fs.rename(hadoop(path), hadoop(f"{path}.old"))
    fs.rename(hadoop(f"{path}.new"), hadoop(path))
    fs.delete(hadoop(f"{path}.old"), True)


def fix_decimal_comma(lines: DataFrame, *, text: str = "value", order: str = "pos", series: str = "file", chunk_rows: int | None = None) -> DataFrame:
    """(series_id, num, time_s, current_ma, voltage_v) of rows whose decimal commas were read as separators.

    With ``chunk_rows`` a long series is numbered in chunks.
    """
    part = F.split(text, ",")
    joined = lambda i: F.concat_ws(".", F.get(part, F.lit(i)), F.get(part, F.lit(i + 1))).try_cast("double")
    fixed = lines.withColumns({"__t": joined(0), "__c": joined(2), "__v": joined(4)}).where("__t is not null and __c is not null and __v is not null")
    first = fixed.groupBy(F.col(series).alias("__series")).agg(F.min_by("__t", order).alias("__first"))
    placed = positioned(fixed, [series], order, chunk_rows).join(first, F.col(series).eqNullSafe(F.col("__series")))
    return placed.select(
        F.col(series).alias("series_id"),
        (F.col("__pos") - 1).alias("num"),
        (F.col("__t") - F.col("__first")).alias("time_s"),
        F.col("__c").alias("current_ma"),
        F.col("__v").alias("voltage_v"),
    )


#: Fixed values of the capture format, little-endian. Header: bytes of each field in order, "s" a length-prefixed text;
#: the last eight are two bytes each, among them the offsets of status packet and samples, and the channel mask.
HEADER_FIELDS = (4, "s", 4, 8, "s", 4, 4, 4, 4, 4, 4, 4, 4, "s", "s", 4, 4, 8, 2, 2, 2, 2, 2, 2, 2, 2)
STATUS_OFFSET_FIELD, SAMPLE_OFFSET_FIELD, MASK_FIELD = 18, 20, 25
#: Status packet: places of output voltage, LEDs, sampling rate, initial USB and auxiliary voltage, hardware revision.
STATUS_VOUT, STATUS_LEDS, STATUS_RATE, STATUS_USB, STATUS_AUX, STATUS_REVISION = 20, 24, 28, 40, 42, 44
CHANNELS = (("main", 0x1000), ("usb", 0x2000), ("aux", 0x4000))
COARSE_BIT, COARSE_SCALE, MARKER_BITS = 1, 250, 3
MISSING_CURRENT, MISSING_VOLTAGE = 0x8001, 0xFFFF
REVISION_B, REVISION_C, AUX_VOLTAGE_LED = 2, 3, 0x08
VOLTS_A_COUNT = 125e-6
CAPTURE_COLUMNS = (
    "series_id string, num long, time_s double, main_ma double, main_v double, usb_ma double, usb_v double, aux_ma double, aux_v double, marker0 boolean, marker1 boolean, missing boolean"
)
CAPTURE_NAMES = [c.split(" ")[0] for c in CAPTURE_COLUMNS.split(", ")]
#: Samples that are decoded at a time, and samples of a range, of which a task reads some.
CAPTURE_PIECE, CAPTURE_RANGE = 100_000, 5_000_000
#: Stores that Arrow opens by itself.
ARROW_SCHEMES = {"file", "hdfs", "s3", "gs"}


def header_numbers(content: bytes) -> list[int]:
    """The header's fields as whole numbers; texts count as their length."""
    at, found = 0, []
    for field in HEADER_FIELDS:
        if field == "s":
            size = shift = 0
            while True:
                byte = content[at]
                at += 1
                size |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    break
            found.append(size)
            at += size
        else:
            found.append(int.from_bytes(content[at : at + field], "little"))
            at += field
    return found


class Capture(NamedTuple):
    """What the head of a capture tells: the recorded channels, where samples begin, and what their numbers mean."""

    present: list[str]
    samples_at: int
    rate: float
    fixed: dict[str, float]
    measured: str
    scale: int

    @property
    def record(self) -> np.dtype:
        return np.dtype([(c, "<u2") for c in (*self.present, "voltage")])


def capture_head(read: Callable[[int, int], bytes]) -> Capture:
    """The head of a capture, given a function from (offset, bytes) to content."""
    header = header_numbers(read(0, 4096))
    status = read(header[STATUS_OFFSET_FIELD], 64)
    short = lambda at: int.from_bytes(status[at : at + 2], "little")
    revision = status[STATUS_REVISION]
    main_scale, aux_scale = 2 if revision < REVISION_B else 1, 2 if revision < REVISION_C else 1
    fixed = {"main_v": 2.0 + status[STATUS_VOUT] * 0.01, "usb_v": short(STATUS_USB) * VOLTS_A_COUNT / main_scale, "aux_v": short(STATUS_AUX) * VOLTS_A_COUNT / aux_scale}
    measured, scale = ("aux_v", aux_scale) if status[STATUS_LEDS] & AUX_VOLTAGE_LED else ("main_v", main_scale)
    present = [c for c, bit in CHANNELS if header[MASK_FIELD] & bit]
    return Capture(present, header[SAMPLE_OFFSET_FIELD], 1000.0 * status[STATUS_RATE], fixed, measured, scale)


def capture_batches(name: str, size: int, read: Callable[[int, int], bytes], first: int = 0, count: int | None = None) -> Iterator[pa.RecordBatch]:
    """The ``count`` samples from ``first`` on of one capture of ``size`` bytes, in batches; one that is cut short ends with its last whole sample."""
    head = capture_head(read)
    record = head.record
    end = max(size - head.samples_at, 0) // record.itemsize
    end = end if count is None else min(end, first + count)
    for at in range(first, end, CAPTURE_PIECE):
        n = min(CAPTURE_PIECE, end - at)
        r = np.frombuffer(read(head.samples_at + at * record.itemsize, n * record.itemsize), record)
        missing = r["voltage"] == MISSING_VOLTAGE
        for c in head.present:
            missing = missing | (r[c] == MISSING_CURRENT)
        num = np.arange(at, at + len(r))
        columns = {"series_id": [name] * len(r), "num": num, "time_s": num / head.rate, "missing": missing}
        for c, _ in CHANNELS:
            if c in head.present:
                fine = (r[c] & ~np.uint16(COARSE_BIT)).view("<i2") / 1000.0
                columns[f"{c}_ma"] = np.where(missing, 0.0, np.where(r[c] & COARSE_BIT, fine * COARSE_SCALE, fine))
            else:
                columns[f"{c}_ma"] = np.zeros(len(r))
        volts = (r["voltage"] & ~np.uint16(MARKER_BITS)) * VOLTS_A_COUNT
        columns |= {c: np.full(len(r), v) for c, v in head.fixed.items()}
        columns[head.measured] = np.where(missing, columns[head.measured], volts / head.scale)
        columns["marker0"] = ~missing & ((r["voltage"] & 1) > 0)
        columns["marker1"] = ~missing & ((r["voltage"] & 2) > 0)
        yield pa.record_batch([pa.array(columns[c]) for c in CAPTURE_NAMES], CAPTURE_NAMES)


def capture_ranges(spark: SparkSession, path: str, samples: int = CAPTURE_RANGE) -> DataFrame:
    """(path, size, first): each capture below ``path`` in ranges of ``samples`` samples; contents are not read.

    How many samples a capture has is only known with its head, so ranges are made for the smallest record, of
    four bytes; those past the end give nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    starts = F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / 4), F.lit(samples).cast("long"))
    return files.select("path", "size", F.explode(starts).alias("first"))


def read_capture_ranges(ranges: DataFrame, samples: int = CAPTURE_RANGE) -> DataFrame:
    """The samples of ``capture_ranges``; a task reads the heads and the bytes of its ranges only."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, first in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "first")]):
                store, place = pa_fs.FileSystem.from_uri(name)
                with store.open_input_file(place) as file:
                    yield from capture_batches(name, size, lambda at, n, f=file: f.read_at(n, at), first, samples)

    spread = ranges.repartition(max(1, ranges.sparkSession.sparkContext.defaultParallelism * 4), "path", "first")
    return spread.mapInArrow(decode, CAPTURE_COLUMNS)


def read_power_captures(spark: SparkSession, path: str, *, samples: int = CAPTURE_RANGE) -> DataFrame:
    """Samples of binary captures; a capture is read by many tasks, each ``samples`` samples at a time.

    Currents are in milliamperes; a channel that was not recorded has current 0 and its initial voltage. The
    measured voltage is that of the main channel, or of the auxiliary one if the status packet says so, and
    counts half on old hardware. Missing samples have current 0 and are flagged.

    Tasks open the files with Arrow, for local, HDFS, S3 and GCS paths. Files of other stores are read whole by Spark, a
    task for each, and may have up to 2 GB.
    """
    schemes = {r[0] for r in spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()}
    if schemes <= ARROW_SCHEMES:
        return read_capture_ranges(capture_ranges(spark, path, samples), samples)
    return decode_captures(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode_captures(files: DataFrame) -> DataFrame:
    """The same of a table of (name, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = content.as_py()
                yield from capture_batches(name, len(whole), lambda at, n, w=whole: w[at : at + n])

    return files.mapInArrow(decode, CAPTURE_COLUMNS)


def replicate_fleet(rows: DataFrame, copies: int, *, uuid: str = "uuid", time: str = "time") -> DataFrame:
    """The rows and ``copies`` more of them, each with other devices and a month later than the one before."""
    n = F.explode(F.sequence(F.lit(0), F.lit(copies)))
    many = rows.withColumn("__n", n)
    return many.withColumns(
        {uuid: F.when(F.col("__n") == 0, F.col(uuid)).otherwise(F.concat(F.col(uuid).cast("string"), F.lit("-"), F.col("__n").cast("string"))), time: F.col(time) + F.col("__n") * MONTH_SECONDS}
    ).drop("__n")


def decode_distribution(rows: DataFrame, *, entries: str = "entries", xmax: str = "xmax") -> DataFrame:
    """(..., x, y) of lists of ``bucket;probability``, over 100 buckets up to xmax."""
    part = F.split(F.col("__e"), ";")
    others = [c for c in rows.columns if c not in (entries, xmax)]
    return rows.withColumn("__e", F.explode(entries)).select(
        *others, (F.get(part, F.lit(0)).try_cast("double") / 100 * F.col(xmax)).alias("x"), F.get(part, F.lit(1)).try_cast("double").alias("y")
    )


def numbers(text: Column) -> tuple[Column, Column]:
    """An untyped number as (long, double): one with a point or comma is a double, else a whole number."""
    plain = F.regexp_replace(text, ",", ".")
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
    return whole, F.when(whole.isNull(), plain.try_cast("double"))
