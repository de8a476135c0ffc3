"""Structured Streaming: incremental ingest, windowed counts, and run or bucket detection with state for each series."""

from __future__ import annotations

import io
import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat
from types import FunctionType
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ohmline.operators.segments import BucketDetector, Held, KeyChangeDetector, MovingAverageDetector, Row, RunDetector, Step, bucket_step, run_step
from ohmline.shared import ship

ship(__name__)


def ingest(spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str, *, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append the files that are new in ``source`` to ``target``, once, and stop; ``checkpoint`` remembers them."""
    rows = spark.readStream.schema(schema).parquet(source)
    rows = transform(rows) if transform else rows
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def node_hour_counts(lines: DataFrame, *, ts: str = "ts", node: str = "node", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts of each node in tumbling windows; rows later than ``late`` behind the newest are dropped."""
    stamped = lines.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = stamped.groupBy(F.window(ts, width), node).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), node, "n")


class StatePickler(cloudpickle.Pickler):
    def persistent_id(self, obj: Any) -> str | None:
        return self.names.get(id(obj))


class StateUnpickler(pickle.Unpickler):
    def persistent_load(self, name: str) -> Any:
        return self.named[name]


class Saved:
    """States as bytes. The classes and plain functions that each new detector has are named in them, not written out.

    Modules are shipped by value, so a class in a state would be written, and made again, for every series and batch.
    Functions that hold something of their own are written out.
    """

    def __init__(self, make: Callable[[], Any], columns: list[str]):
        made = make()
        plain = {f"detector.{k}": v for k, v in getattr(made, "__dict__", {}).items() if isinstance(v, FunctionType) and v.__closure__ is None and not v.__dict__}
        self.named = {"held": Held, "row": Row, "columns": columns, "detector": type(made), **plain}

    def dumps(self, state: Any) -> bytes:
        body = io.BytesIO()
        pickler = StatePickler(body)
        pickler.names = {id(v): k for k, v in self.named.items()}
        pickler.dump(state)
        return body.getvalue()

    def loads(self, body: bytes) -> Any:
        unpickler = StateUnpickler(io.BytesIO(body))
        unpickler.named = self.named
        return unpickler.load()


def stateful(
    rows: DataFrame, make: Callable[[], Any], step: Step, name: str, *, series: Sequence[str] = ("series_id",), order: str = "num",
    time: str | None = None, late: str = "10 minutes", expire_s: float | None = None, states: int | None = None,
) -> DataFrame:
    """What ``step`` gives for the rows of each series of a stream, with ``name``, its number; the state is kept from batch to batch.

    With ``time``, a timestamp, rows may come in any order, up to ``late`` behind the newest: they wait until the watermark
    has passed them and are then taken in the order of ``time``, then ``order``. Later rows, and rows without a time, are dropped. A
    series without rows for ``expire_s`` seconds of event time is forgotten; what comes after that is a new series. RocksDB as
    the session's state store (``spark.sql.streaming.stateStore.providerClass``) keeps the waiting rows out of the heap. With
    ``states``, series share so many states: much less work for batches with rows of most series, as each state's call has a
    price, but a state is written whole when any of its series has rows.

    Without ``time``, the rows of a micro-batch are taken in the order of ``order``, and batches must come in order.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])
    if time is not None:
        taken = in_order(make, step, rows.columns, [f.name for f in schema.fields], order, None if expire_s is None else int(expire_s * 1e6), series if states else ())
        stamped = rows.where(F.col(time).isNotNull()).withWatermark(time, late).withColumn("__at", F.unix_micros(time))
        if states:
            stamped, series = stamped.withColumn("__state", F.pmod(F.xxhash64(*series), F.lit(states))), ["__state"]
        return stamped.groupBy(*series).applyInPandasWithState(taken, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)

    def fold(_key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        saved = Saved(make, rows_columns)
        state = saved.loads(held.get[0]) if held.exists else Held(make())
        batch = pd.concat(list(batches)).sort_values(order)
        out = [(*row, n) for values in batch[rows_columns].itertuples(index=False, name=None) for row, n in step(state, Row(rows_columns, values))]
        held.update((saved.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    rows_columns, names = rows.columns, [f.name for f in schema.fields]
    return rows.groupBy(*series).applyInPandasWithState(fold, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def in_order(make: Callable[[], Any], step: Step, columns: list[str], names: list[str], order: str, expire_us: int | None, series: Sequence[str] = ()) -> Callable:
    """Rows of a series wait in its state until the watermark has passed them, then go through ``step`` by ``__at``, microseconds.

    A state has one series, or all that are told apart by the columns ``series``.
    """

    def fold(_key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        passed = held.getCurrentWatermarkMs() * 1000
        saved = Saved(make, columns)
        known = saved.loads(held.get[0]) if held.exists else {}
        out, calls = [], []

        def release(state: Held, waiting: list) -> None:
            waiting.sort(key=lambda x: x[:2])
            due = bisect_right(waiting, passed, key=lambda x: x[0])
            out.extend((*row, n) for *_, values in waiting[:due] for row, n in step(state, Row(columns, values)))
            del waiting[:due]

        def without_silent() -> None:
            for who in [k for k, (*_, newest) in known.items() if expire_us is not None and newest + expire_us <= passed]:
                release(*known.pop(who)[:2])

        without_silent()  # what comes now of these is a new series
        for batch in batches:
            whose = zip(*(batch[c].tolist() for c in series)) if series else repeat(())
            for who, at, place, values in zip(whose, batch["__at"].tolist(), batch[order].tolist(), zip(*(batch[c] for c in columns))):
                one = known.setdefault(tuple(None if x != x else x for x in who), [Held, [], at])
                one[0] = Held(make()) if one[0] is Held else one[0]
                one[1].append((at, place, values))
                one[2] = max(one[2], at)
        for state, waiting, newest in known.values():
            release(state, waiting)
            calls += [at for at, *_ in waiting[:1]] + ([] if expire_us is None else [newest + expire_us])
        without_silent()
        if known:
            held.update((saved.dumps(known),))
            if calls:  # a state is called when the watermark is beyond the time set
                held.setTimeoutTimestamp(max(-(-min(calls) // 1000) - 1, held.getCurrentWatermarkMs() + 1))
        else:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    return fold


def stream_buckets_with(rows: DataFrame, make: Callable[[], BucketDetector], **options) -> DataFrame:
    """``rows`` of a stream with ``bucket_id`` from 0, as a user's detector starts buckets; options of ``stateful``."""
    return stateful(rows, make, bucket_step, "bucket_id", **options)


def stream_runs_with(rows: DataFrame, make: Callable[[], RunDetector], **options) -> DataFrame:
    """Rows of the runs of a stream, with ``run_id`` from 1, as a user's detector finds them; options of ``stateful``.

    When it enters a run, what ``lead_in`` gives stands before the row, also if it came in an earlier batch.
    """
    return stateful(rows, make, run_step, "run_id", **options)


def stream_buckets(rows: DataFrame, key: Callable[[Any], Any], **options) -> DataFrame:
    """``rows`` of a stream with ``bucket_id``: a new one where ``key`` of a row differs from the row before."""
    return stream_buckets_with(rows, lambda: KeyChangeDetector(key), **options)


def stream_runs(rows: DataFrame, threshold: float, window: int, power: Callable[[Any], float], **options) -> DataFrame:
    """Rows of the runs of a stream: the mean power of the last ``window`` rows is at least ``threshold``, as in ``detect_runs``."""
    return stream_runs_with(rows, lambda: MovingAverageDetector(threshold, window, power), **options)
