"""Cutting ordered series into runs and buckets, for any partitioning of the input.

A long series is worked on in chunks of ``chunk_rows`` consecutive rows, each with a halo of rows of the chunk
before it, so no task needs a series whole. The rows are numbered first, by a count in two levels over stretches of
``chunk_rows`` of the order, which must be a number with about one row for each whole number. Without ``chunk_rows`` a
series is one window. Rows whose order is null take no part.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain
from typing import Any, Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ohmline.shared import cut, joined_on, ship

ship(__name__)

SERIES = ("series_id",)
SAMPLING_STEP = 0.0002
STEP_TOLERANCE = 0.000001
#: Times that chunks which began with a wrong state run again before a series is folded whole.
ROUNDS = 8


def col(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def positioned(rows: DataFrame, keys: Sequence[str], order: str, chunk_rows: int | None) -> DataFrame:
    """``rows`` with ``__pos``: their place in their series, from 1 without holes."""
    rows = rows.where(F.col(order).isNotNull())
    if chunk_rows is None:
        return rows.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    stretched = rows.withColumn("__stretch", F.floor(F.col(order) / chunk_rows))
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = stretched.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__stretch").alias("__s"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__stretch") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(order))
    placed = stretched.withColumn("__inside", inside).join(starts, same).withColumn("__pos", F.col("__before") + F.col("__inside"))
    return placed.select(*rows.columns, "__pos")


def with_before(rows: DataFrame, keys: Sequence[str], order: str, chunk_rows: int | None, **before: str | Column) -> DataFrame:
    """``rows`` with, for each of ``before``, the value that the row before has (null for the first of its series).

    The rows keep ``__chunk``.
    """
    if chunk_rows is None:
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.where(F.col(order).isNotNull()).select("*", F.lit(0).alias("__chunk"), *[F.lag(col(x)).over(w).alias(name) for name, x in before.items()])
    seen = with_halo(positioned(rows, keys, order, chunk_rows), "__pos", chunk_rows, 1)
    w = Window.partitionBy(*keys, "__in").orderBy("__pos")
    found = seen.select("*", *[F.lag(col(x)).over(w).alias(name) for name, x in before.items()])
    return found.where("__in = __chunk").drop("__in", "__pos")


def with_latest(rows: DataFrame, keys: Sequence[str], order: str, stretch: int | None, **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values``, the latest value that is not null, up to the row itself (null if there is none).

    A long series is worked on in stretches of ``stretch`` units of the order, which must be a number then: the latest value
    in each stretch first, what each stretch begins with from those, then the rows inside. Without, a series is one window.
    """
    upto = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if stretch is None:
        return rows.withColumns({n: F.last(v, ignorenulls=True).over(upto(Window.partitionBy(*keys))) for n, v in values.items()})
    place = [*keys, "__stretch"]
    cut_up = rows.withColumns({"__stretch": F.floor(F.col(order) / stretch)} | {f"__v_{n}": v for n, v in values.items()})
    latest = cut_up.groupBy(*place).agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__l_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = latest.select(*place, *[F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__b_{n}") for n in values])
    inside = upto(Window.partitionBy(*place))
    seen = joined_on(cut_up, begins, place).withColumns({n: F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(inside), f"__b_{n}") for n in values})
    return seen.select(*[c for c in rows.columns if c not in values], *values)


def with_halo(rows: DataFrame, order: str, chunk_rows: int | None, halo: int) -> DataFrame:
    """``rows`` with ``__chunk`` (where a row belongs) and ``__in`` (the chunk that it is seen in)."""
    rows = rows.where(F.col(order).isNotNull())
    if chunk_rows is None:
        return rows.withColumns({"__chunk": F.lit(0).cast("long"), "__in": F.lit(0).cast("long")})
    if chunk_rows < halo:
        raise ValueError("a chunk must hold at least its halo")
    chunk = F.floor(F.col(order) / chunk_rows)
    both = F.when(F.pmod(F.col(order), F.lit(chunk_rows)) >= chunk_rows - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return rows.withColumn("__chunk", chunk).withColumn("__in", F.explode(both))


def numbered(rows: DataFrame, starts: Column, keys: list[str], order: str, chunked: bool, name: str) -> DataFrame:
    """``rows`` with ``name``: how many starts there are up to each row, over all chunks of its series."""
    rows = rows.withColumn("__start", F.coalesce(starts.cast("int"), F.lit(0)))
    upto = F.sum("__start").over(Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if not chunked:
        return rows.withColumn(name, upto).drop("__start")
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "__chunk").agg(F.sum("__start").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    starts_ = chunks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__chunk"])], "__before")
    same = F.lit(True)
    for i, k in enumerate([*keys, "__chunk"]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.withColumn("__upto", upto).join(starts_, same).withColumn(name, F.col("__before") + F.col("__upto")).select(*[c for c in rows.columns if c != "__start"], name)


def with_last_sum(rows: DataFrame, keys: Sequence[str], place: str, value: str, window: int) -> DataFrame:
    """``rows`` with ``__last``: the sum of ``value`` over the last ``window`` rows up to each, for places without holes.

    Rows are in blocks of ``window`` places, so the last rows are the end of one block and the beginning of the next:
    a sum from the back and a sum from the front, each running. The work for a row does not depend on ``window``, and
    nothing is subtracted, so nothing is lost to cancellation.
    """
    blocks = rows.withColumn("__block", F.floor((F.col(place) - 1) / window))
    inside = Window.partitionBy(*keys, "__block")
    front = F.sum(value).over(inside.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    back = F.sum(value).over(inside.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0))
    both = blocks.withColumns({"__front": front, "__back": back})
    earlier = F.lag("__back", window - 1).over(Window.partitionBy(*keys).orderBy(place)) if window > 1 else F.lit(None)
    ends = F.pmod(F.col(place), F.lit(window)) == 0
    return both.withColumn("__last", F.when(ends, F.col("__front")).otherwise(F.col("__front") + earlier)).drop("__block", "__front", "__back")


def detect_runs(
    rows: DataFrame,
    threshold: float,
    window: int,
    *,
    series: Sequence[str] = SERIES,
    order: str = "num",
    power: str | Column = "current_ma * voltage_v",
    chunk_rows: int | None = None,
) -> DataFrame:
    """The rows of every run, with ``run_id`` (from 1 in each series).

    A row is active if ``window`` rows up to it exist and their mean power is at least ``threshold``. A run goes
    from the ``window - 1`` rows before its first active row to its last active row; a row may be in the lead-in
    of one run and in another. Rows without power are left out first.
    """
    keys = list(series)
    rows = positioned(rows.where(col(power).isNotNull()), keys, order, chunk_rows)
    seen = with_halo(rows, "__pos", chunk_rows, window)
    w = Window.partitionBy(*keys, "__in").orderBy("__pos")
    seen = with_last_sum(seen.withColumn("__power", col(power)), [*keys, "__in"], "__pos", "__power", window)
    seen = seen.withColumn("__active", (F.col("__pos") >= window) & (F.col("__last") >= threshold * window)).drop("__power", "__last")
    seen = seen.withColumn("__rises", F.col("__active") & ~F.coalesce(F.lag("__active").over(w), F.lit(False)))
    own = numbered(seen.where("__in = __chunk"), F.col("__rises"), keys, "__pos", chunk_rows is not None, "run_id")
    lead = own.where("__rises").select(*keys, "run_id", F.explode(F.sequence(F.col("__pos") - (window - 1), F.col("__pos") - 1)).alias("__pos")) if window > 1 else None
    found = own.where("__active")
    columns = [c for c in rows.columns if c != "__pos"] + ["run_id"]
    if lead is None:
        return found.select(*columns)
    return found.select(*columns).unionByName(joined_on(rows, lead, [*keys, "__pos"]).select(*columns))


def bucket_consecutive(
    rows: DataFrame, key: Sequence[str], *, series: Sequence[str] = SERIES, order: str = "num", chunk_rows: int | None = None
) -> DataFrame:
    """``rows`` with ``bucket_id`` (from 0 in each series): a new one starts where a key differs from the row before."""
    keys = list(series)
    seen = with_halo(positioned(rows, keys, order, chunk_rows), "__pos", chunk_rows, 1)
    w = Window.partitionBy(*keys, "__in").orderBy("__pos")
    now = F.struct(*key)
    seen = seen.withColumn("__turn", F.lag(F.lit(True)).over(w).isNotNull() & ~now.eqNullSafe(F.lag(now).over(w)))
    own = numbered(seen.where("__in = __chunk"), F.col("__turn"), keys, "__pos", chunk_rows is not None, "bucket_id")
    return own.drop("__chunk", "__in", "__turn", "__pos")


def hour_buckets(rows: DataFrame, time: str = "ts", **options) -> DataFrame:
    """Buckets of consecutive rows of the same day of the month and hour."""
    timed = rows.withColumns({"__day": F.dayofmonth(time), "__hour": F.hour(time)})
    return bucket_consecutive(timed, ["__day", "__hour"], **options).drop("__day", "__hour")


#: Old name of the same buckets; rows that are a bucket by themselves are kept.
time_buckets = hour_buckets


def run_energy(
    runs: DataFrame,
    *,
    series: Sequence[str] = SERIES,
    order: str = "num",
    time: str | Column = "time_s",
    power: str | Column = "current_ma * voltage_v",
    step: float = SAMPLING_STEP,
    tolerance: float = STEP_TOLERANCE,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Start, end, duration and watt-hours of each run; only rows a sampling step after the row before count."""
    keys = [*series, "run_id"]
    timed = with_before(runs.withColumns({"__time": col(time), "__power": col(power)}), keys, order, chunk_rows, __last="__time")
    stepped = F.col("__time") - F.col("__last")
    counted = timed.withColumn("__counts", F.coalesce(stepped.between(step - tolerance, step + tolerance), F.lit(False)))
    return counted.groupBy(*keys).agg(
        F.min("__time").alias("start_s"),
        F.max("__time").alias("end_s"),
        (F.sum(F.col("__counts").cast("int")) * F.lit(step)).alias("duration_s"),
        (F.sum(F.when(F.col("__counts"), F.col("__power")).otherwise(0.0)) * F.lit(step) / 1000 / 3600).alias("watt_hours"),
    )


class RunDetector(Protocol):
    """What a user-defined run detector offers; one instance serves one series."""

    def reset(self) -> None: ...
    def update(self, row: Any) -> None: ...
    def ready(self) -> bool: ...
    def in_run(self) -> bool: ...
    def lead_in(self) -> Iterable[Any]: ...


class BucketDetector(Protocol):
    """What a user-defined bucket detector offers: ``update`` tells whether the row starts a new bucket."""

    def reset(self) -> None: ...
    def update(self, row: Any) -> bool: ...


class Row:
    """A row as detectors see it: its values by name, and in order."""

    def __init__(self, names: Sequence[str], values: Sequence[Any]):
        self.__dict__.update(zip(names, values))

    def __iter__(self) -> Iterator[Any]:
        return iter(self.__dict__.values())


class Held:
    """What a detector knows of a series: the detector, whether it is in a run, and how many runs or turns there were."""

    def __init__(self, detector: Any):
        self.detector, self.found, self.inside, self.first = detector, 0, False, True
        detector.reset()

    def digest(self) -> bytes:
        """Equal for equal states; what was found so far is no part of it."""
        known = getattr(self.detector, "digest", None)
        own = known() if known else {k: v for k, v in vars(self.detector).items() if not callable(v)}
        again = cloudpickle.loads(cloudpickle.dumps((own, self.inside, self.first)))  # strings are shared as in any copy
        return hashlib.sha256(cloudpickle.dumps(again)).digest()


Step = Callable[[Held, Any], Iterator[tuple[Any, int]]]


def run_step(held: Held, row: Any) -> Iterator[tuple[Any, int]]:
    """Rows of a run that ``row`` begins or goes on with, and the run's number from 1."""
    held.detector.update(row)
    now = held.detector.ready() and held.detector.in_run()
    if now and not held.inside:
        held.found += 1
        for before in held.detector.lead_in():
            yield before, held.found
    if now:
        yield row, held.found
    held.inside = now


def bucket_step(held: Held, row: Any) -> Iterator[tuple[Any, int]]:
    """``row`` and its bucket's number from 0."""
    turn = held.detector.update(row)
    held.found, held.first = held.found + int(bool(turn) and not held.first), False
    yield row, held.found


def lines(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[dict, Row]]:
    """Every row: the values of ``columns`` as detectors see them, and the other values by name."""
    for batch in batches:
        values = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        more = [n for n in values if n not in columns]
        for k, row in enumerate(zip(*[values[c] for c in columns])):
            yield {n: values[n][k] for n in more}, Row(columns, row)


def record(rows: list[tuple], kinds: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def folded(rows: DataFrame, make: Callable[[], Any], step: Step, series: Sequence[str], order: str, name: str) -> DataFrame:
    """Each series, in order and row by row, through ``step``; a series is one task."""
    keys, columns = list(series), rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def by_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [*[(f.name, f.type) for f in first.schema], (name, pa.int64())]
        held, now, out = None, None, []
        for _, row in lines(chain([first], batches), columns):
            key = tuple(getattr(row, k) for k in keys)
            if held is None or key != now:
                held, now = Held(make()), key
            out += [(*source, n) for source, n in step(held, row)]
            if len(out) >= 10_000:
                yield record(out, kinds)
                out = []
        yield record(out, kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(by_series, schema)


def folded_by_chunk(rows: DataFrame, make: Callable[[], Any], step: Step, series: Sequence[str], order: str, name: str, chunk_rows: int, halo: int, rounds: int) -> DataFrame:
    """As ``folded``, with the chunks of a series in parallel, each on a guess of the state that it begins with.

    The guess is a fresh detector that has seen the ``halo`` rows before the chunk. The digest of the state with which a chunk
    began is compared with that at the end of the chunk before; chunks where they differ run again from the
    state that the chunk before ended with, round by round. Every round settles at least the first chunk that was wrong. If
    after ``rounds`` some are still wrong, the detector does not forget, and the series is folded whole.
    """
    keys, columns = list(series), rows.columns
    placed = cut(positioned(rows, keys, order, chunk_rows))
    seen = with_halo(placed, "__pos", chunk_rows, halo).withColumn("__state", F.lit(None).cast("binary"))
    own = [T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]
    more = [T.StructField(n, t) for n, t in (("__n", T.LongType()), ("__in", T.LongType()), ("__begun", T.BinaryType()), ("__ended", T.BinaryType()), ("__state", T.BinaryType()))]

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = {f.name: f.type for f in first.schema}
        kinds = [*[(c, types[c]) for c in columns], ("__n", pa.int64()), ("__in", pa.int64()), ("__begun", pa.binary()), ("__ended", pa.binary()), ("__state", pa.binary())]
        at = {c: i for i, c in enumerate(columns)}
        held, now, begun, out = None, None, None, []

        def ended() -> tuple:
            values = [None] * len(columns)
            for k, v in zip(keys, now):
                values[at[k]] = v
            return (*values, held.found, now[-1], begun, held.digest(), cloudpickle.dumps(held))

        for more, row in lines(chain([first], batches), columns):
            key = (*[getattr(row, k) for k in keys], more["__in"])
            if held is None or key != now:
                if held is not None:
                    out.append(ended())
                held, now, begun = Held(make()), key, None
            if more["__state"] is not None:  # the first of its chunk: the state to begin with, and no row
                held = cloudpickle.loads(more["__state"])
                continue
            if more["__chunk"] != more["__in"]:
                for _ in step(held, row):
                    pass
                continue
            if begun is None:
                begun, held.found = held.digest(), 0
            out += [(*source, n, key[-1], None, None, None) for source, n in step(held, row)]
            if len(out) >= 10_000:
                yield record(out, kinds)
                out = []
        if held is not None:
            out.append(ended())
        yield record(out, kinds)

    def run(some: DataFrame) -> DataFrame:
        dealt = some.repartition(*keys, "__in").sortWithinPartitions(*keys, "__in", F.col("__state").isNull(), "__pos")
        return cut(dealt.mapInArrow(by_chunk, T.StructType([*own, *more])))

    done, place = run(seen), [*keys, "__in"]
    by_place = Window.partitionBy(*keys).orderBy("__in")
    for turn in range(rounds + 1):
        ends = done.where("__ended is not null")
        before = ends.select(*place, "__begun", F.lag("__ended").over(by_place).alias("__before"))
        wrong = cut(before.where("__before is not null and __before <> __begun").select(*place))
        if wrong.isEmpty():
            break
        if turn == rounds:
            return folded(rows.where(F.col(order).isNotNull()), make, step, keys, order, name)
        states = ends.select(*keys, (F.col("__in") + 1).alias("__in"), "__state")
        begin = joined_on(states, wrong, place, "left_semi")
        again = joined_on(seen.where("__in = __chunk"), wrong, place, "left_semi").unionByName(begin, allowMissingColumns=True)
        done = cut(joined_on(done, wrong, place, "left_anti").unionByName(run(again)))
    ends = done.where("__ended is not null").select(*place, F.coalesce(F.sum("__n").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
    found = joined_on(done.where("__ended is null"), ends, place)
    return found.select(*columns, (F.col("__n") + F.col("__earlier")).alias(name))


def detected(rows: DataFrame, make: Callable[[], Any], step: Step, series: Sequence[str], order: str, name: str, chunk_rows: int | None, halo: int | None, rounds: int) -> DataFrame:
    if chunk_rows is None:
        return folded(rows.where(F.col(order).isNotNull()), make, step, series, order, name)
    return folded_by_chunk(rows, make, step, series, order, name, chunk_rows, min(chunk_rows, 1024) if halo is None else halo, rounds)


def detect_runs_with(
    rows: DataFrame, make: Callable[[], RunDetector], *, series: Sequence[str] = SERIES, order: str = "num",
    chunk_rows: int | None = None, halo: int | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """Rows of runs, with ``run_id`` from 1, as a user's detector finds them.

    The detector sees the rows of a series one by one. When it enters a run, what ``lead_in`` gives stands before
    the row; the row after which it is out of the run is not part of it. Rows whose order is null take no part.

    With ``chunk_rows`` a series is worked on by many tasks, as in ``folded_by_chunk``: that is fast for detectors that
    forget what is more than ``halo`` rows back, and right for all. A detector may offer ``digest()``, a value that is
    equal for states that act alike; else its attributes are compared.
    """
    return detected(rows, make, run_step, series, order, "run_id", chunk_rows, halo, rounds)


def bucket_with(
    rows: DataFrame, make: Callable[[], BucketDetector], *, series: Sequence[str] = SERIES, order: str = "num",
    chunk_rows: int | None = None, halo: int | None = None, rounds: int = ROUNDS,
) -> DataFrame:
    """``rows`` with ``bucket_id`` from 0, as a user's detector starts buckets; options as for ``detect_runs_with``."""
    return detected(rows, make, bucket_step, series, order, "bucket_id", chunk_rows, halo, rounds)


class MovingAverageDetector:
    """Run detector over the mean of the last ``window`` powers."""

    def __init__(self, threshold: float, window: int, power: Callable[[Any], float]):
        self.threshold, self.window, self.power = threshold, window, power
        self.reset()

    def reset(self) -> None:
        self.rows: deque[Any] = deque()
        self.front: list[float] = []  # sums from each of the older rows to the last of them, the oldest at the end
        self.back: list[float] = []  # powers of the newer rows
        self.sum = 0.0  # of the newer rows

    def update(self, row: Any) -> None:
        self.rows.append(row)
        self.back.append(self.power(row))
        self.sum += self.back[-1]
        if len(self.rows) > self.window:
            self.rows.popleft()
            if not self.front:
                self.front, self.back, self.sum = list(accumulate(reversed(self.back))), [], 0.0
            self.front.pop()

    def ready(self) -> bool:
        return len(self.rows) == self.window

    def in_run(self) -> bool:
        return (self.front[-1] if self.front else 0.0) + self.sum >= self.threshold * self.window

    def lead_in(self) -> list[Any]:
        return list(self.rows)[:-1]

    def digest(self) -> Any:
        """The rows of the window: what is done with later rows depends on nothing else, but for the rounding of sums."""
        return list(map(tuple, self.rows))


class KeyChangeDetector:
    """Bucket detector that starts a bucket where a key changes."""

    def __init__(self, key: Callable[[Any], Any]):
        self.key = key
        self.reset()

    def reset(self) -> None:
        self.last = None

    def update(self, row: Any) -> bool:
        now, before, self.last = self.key(row), self.last, self.key(row)
        return now != before
