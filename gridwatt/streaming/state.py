"""Keyed state: runs that arrive in pieces, and revisions of a feed with a side table for what comes too late.

Both keep what they wait for in the state store, by key, and forget it in time: a run when its pieces are no longer due, a feed's days
when they are past revision. Nothing that was sent before is read again. The sinks write each micro-batch once and under its
own number, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..sources.tables import dedupe_last, read_if_there, upsert_partitions

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries of this module inside: keyed state with timers needs the RocksDB store. The session's setting comes back afterwards."""
    name, wanted = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _fields(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names])


class _Pieces(StatefulProcessor):
    """State of one run: its pieces so far, and whether it has been built."""

    def __init__(self, columns: list[str], part: T.StructType, payload: T.StructType, min_members: int):
        self.columns, self.part, self.payload, self.min_members = columns, part, payload, min_members

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = T.StructType([T.StructField("rows", T.ArrayType(self.payload))])
        self.pieces = handle.getMapState("pieces", self.part, held)
        self.run = handle.getValueState("run", "built boolean")

    def _told(self, key: tuple, part: tuple, rows: Iterable[tuple], status: str) -> Iterator[Row]:
        for r in rows:
            yield Row(*self.columns, "status")(*key, *part, *r, status)

    def _all(self, key: tuple, status: str) -> Iterator[Row]:
        for part, (rows,) in self.pieces.iterator():
            yield from self._told(key, tuple(part), map(tuple, rows), status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got: dict[tuple, list] = {}
        for r in rows:
            part, sent = tuple(r[n] for n in self.part.names), tuple(r[n] for n in self.payload.names)
            if part[0] is None:
                continue
            if r["_at"] > r["_due"]:
                yield from self._told(key, part, [sent], "late")
            else:
                got.setdefault(part, []).append(sent)
                due = r["_due"]
        if not got:
            return
        state = self.run.get()
        if state is None:
            self.handle.registerTimer(due)
        changed = False
        for part, sent in got.items():
            fresh = sorted(sent, key=repr)
            had = self.pieces.getValue(part) if self.pieces.containsKey(part) else None
            if had is None or [tuple(x) for x in had[0]] != fresh:
                self.pieces.updateValue(part, (fresh,))
                changed = True
        built = state is not None and state[0]
        if changed and len({part[0] for part in self.pieces.keys()}) >= self.min_members:
            yield from self._all(key, "built")
            built = True
        self.run.update((built,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.run.get()
        if state is not None and not state[0]:
            yield from self._all(key, "expired")
        self.pieces.clear()
        self.run.clear()

    def close(self) -> None:
        pass


def pending_runs(stream: DataFrame, run_keys: Sequence[str], member: str, piece: Sequence[str], arrived: str, due: str, min_members: int,
                 delay: str = "1 hour") -> DataFrame:
    """Rows of runs that have enough members, from a stream of pieces in any order, with ``status``.

    The rows of one (run, member, piece) in one micro-batch are that piece; sent again, it replaces what was there, and if it is the
    same nothing happens. Once ``min_members`` members have a piece, all rows of the run come out as ``built``, and again whenever a
    further or changed piece arrives. ``due`` is a time of the run until which its pieces are taken: rows that arrived after it come
    out as ``late``. Past it the state is dropped, and a run that was never complete comes out as ``expired``. So state holds only runs
    that are still due. Rows without a member build nothing; they only move time on.

    ``arrived`` is the event time. Rows not newer than the watermark (the newest arrival less ``delay``) are dropped by Spark, so
    ``delay`` is how far out of order rows may arrive. A run's rows are reduced to what its build needs before they come here.
    """
    part = [member, *piece]
    payload = [c for c in stream.columns if c not in (*run_keys, *part, arrived, due)]
    columns = [*run_keys, *part, *payload]
    told = _fields(stream, columns).add("status", "string")
    x = stream.withWatermark(arrived, delay)
    for name, c in (("_at", arrived), ("_due", due)):
        x = x.withColumn(name, F.unix_millis(F.col(c).cast("timestamp")))
    state = _Pieces(columns, _fields(stream, part), _fields(stream, payload), min_members)
    return x.groupBy(*run_keys).transformWithState(state, told, "Append", "EventTime")


def not_loaded(stream: DataFrame, path: str, run_keys: Sequence[str]) -> DataFrame:
    """A stream without the runs that the table at ``path`` held when the stream was first started.

    Their keys are written beside the table once, so that a restarted stream still takes further pieces of its own runs.
    """
    spark, kept = stream.sparkSession, f"{path.rstrip('/')}__loaded"
    if read_if_there(spark, kept) is None:
        there = read_if_there(spark, path)
        keys = _fields(stream, run_keys)
        first = spark.createDataFrame([], keys) if there is None else there.select(*[F.col(f.name).cast(f.dataType) for f in keys]).distinct()
        first.write.parquet(kept)
    loaded = spark.read.parquet(kept).select(*[F.col(k).alias(f"_{k}") for k in run_keys])
    return stream.join(loaded, [stream[k].eqNullSafe(loaded[f"_{k}"]) for k in run_keys], "left_anti")


def _once(batch: DataFrame, path: str) -> DataFrame:
    """The batch, written: its state must not be run through again. The folder holds one batch at a time."""
    folder = f"{path.rstrip('/')}__batch"
    batch.write.mode("overwrite").parquet(folder)
    return batch.sparkSession.read.schema(batch.schema).parquet(folder)


def build_runs(path: str, run_keys: Sequence[str], build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for :func:`pending_runs`: built runs replace their partition of the table, other rows go to ``__left``."""
    def write(batch: DataFrame, number: int) -> None:
        rows = _once(batch, path)
        build(rows.filter("status = 'built'").drop("status")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run_keys).parquet(path)
        rows.filter("status <> 'built'").write.mode("overwrite").parquet(f"{path.rstrip('/')}__left/batch={number}")
    return write


def stream_new_runs(stream: DataFrame, path: str, run_keys: Sequence[str], member: str, piece: Sequence[str], arrived: str, due: str, min_members: int,
                    build: Callable[[DataFrame], DataFrame], checkpoint: str, delay: str = "1 hour") -> DataStreamWriter:
    """Writer that adds runs to a table as their members come in; runs that were there before are left as they are."""
    told = pending_runs(not_loaded(stream, path, run_keys), run_keys, member, piece, arrived, due, min_members, delay)
    return told.writeStream.outputMode("append").foreachBatch(build_runs(path, run_keys, build)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


class _Revisions(StatefulProcessor):
    """State of one series: its newest day, and the values of the days that can still be revised."""

    def __init__(self, columns: list[str], day: str, values: T.StructType, window: int):
        self.columns, self.day, self.values, self.window = columns, day, values, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "day long", self.values)
        self.newest = handle.getValueState("newest", "day long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self.newest.get()
        newest = state[0] if state is not None else None
        limit = None if newest is None else newest - self.window
        known = {k[0]: tuple(v) for k, v in self.held.iterator()}
        changed = {}
        for r in sorted(rows, key=lambda r: (r["_day"], r["_at"])):
            day, now = r["_day"], tuple(r[n] for n in self.values.names)
            if limit is not None and day < limit:
                status = "late"
            else:
                status = "new" if day not in known else "same" if known[day] == now else "revised"
                known[day] = changed[day] = now
                newest = day if newest is None else max(newest, day)
            yield Row(*self.columns, "status")(*(r[n] for n in self.columns), status)
        for day, now in changed.items():
            if day >= newest - self.window:
                self.held.updateValue((day,), now)
        for day in known.keys() - changed.keys():
            if day < newest - self.window:
                self.held.removeKey((day,))
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def revisions(stream: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], arrived: str, window: int) -> DataFrame:
    """Every row of a feed that sends its last days again, with ``status``: new, revised, same, or late.

    A row is late if its day lies more than ``window`` days before the newest day of its series in earlier micro-batches; Spark's own
    watermark would drop it without a word. State holds the values of a window's days and no more. Of rows for one day in one
    micro-batch the last to arrive counts, each with its own status. Rows without a day are dropped.
    """
    columns = list(stream.columns)
    told = T.StructType([*stream.schema.fields, T.StructField("status", T.StringType())])
    x = stream.filter(F.col(day).isNotNull()).withColumn("_day", F.unix_date(F.col(day)).cast("long")).withColumn("_at", F.unix_micros(F.col(arrived).cast("timestamp")))
    return x.groupBy(*keys).transformWithState(_Revisions(columns, day, _fields(stream, values), window), told, "Append", "None")


def keep_revisions(path: str, keys: Sequence[str], day: str, arrived: str, partition: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for :func:`revisions`: new and revised rows are upserted, late ones go to ``__late``, the same ones nowhere."""
    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, _once(batch, path)
        rows.filter("status = 'late'").drop("status").write.mode("overwrite").parquet(f"{path.rstrip('/')}__late/batch={number}")
        fresh = dedupe_last(rows.filter("status in ('new', 'revised')").drop("status"), [*keys, day], arrived).drop(arrived)
        if read_if_there(spark, path) is None:
            fresh.write.mode("overwrite").partitionBy(partition).parquet(path)
        else:
            upsert_partitions(spark, path, fresh, [*keys, day], partition)
    return write


__all__ = ["build_runs", "keep_revisions", "keyed_state", "not_loaded", "pending_runs", "revisions", "stream_new_runs"]
