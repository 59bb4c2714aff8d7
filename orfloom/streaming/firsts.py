"""First row per key of an unordered stream, by event time, with late rows in a table of their own.

A key's state is its earliest row so far and one timer at that row's time. Once the watermark has passed it, no row that is
still on time can be earlier, so the timer hands the row out and the state shrinks to a mark. Rows behind the watermark are
not dropped: they come out with ``late`` set. The watermark column itself is hidden from the stateful step (a computed copy stands
for it), because Spark would remove late rows there before the processor sees them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LATE = "late"
MICROS = "__us"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: the process that prepares the processor beside the driver may not find this package: the class travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstByTime(StatefulProcessor):
    """Keeps the least (time, order columns) of a key; ``forget_us`` after it was handed out the key is forgotten."""

    def __init__(self, names: list[str], order: list[str], state: T.StructType, forget_us: int | None):
        self.names, self.order, self.state_schema, self.forget_us = names, order, state, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", self.state_schema)
        self.held_row, self.out_row = Row(*self.names, MICROS, "__done"), Row(*self.names, LATE)

    def _rank(self, row: Row) -> tuple:
        values = [row[c] for c in self.order]
        return (row[MICROS], *[(v is not None, v) for v in values])  # null first

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.state.get()  # a call to the JVM each, so it is not asked first whether there is one
        held = None if held is None else self.held_row(*held)
        if held is not None and held["__done"] and self.forget_us is not None and held[MICROS] + self.forget_us < now:
            self.handle.deleteTimer(_after(held[MICROS] + self.forget_us))  # input comes before the timers of its batch
            self.state.clear()
            held = None
        best = held
        for row in rows:
            if row[MICROS] is None or row[MICROS] < now:
                yield self.out_row(*[row[c] for c in self.names], True)
            elif best is None or (not best["__done"] and self._rank(row) < self._rank(best)):
                best = self.held_row(*[row[c] for c in self.names], row[MICROS], False)
        if best is not held:
            if held is not None:
                self.handle.deleteTimer(_after(held[MICROS]))
            self.state.update(tuple(best))
            self.handle.registerTimer(_after(best[MICROS]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first = self.state.get()
        if first[-1]:
            self.state.clear()
            return
        yield self.out_row(*first[: len(self.names)], False)
        self.state.update((*[None] * len(self.names), first[-2], True))
        if self.forget_us is not None:
            self.handle.registerTimer(_after(first[-2] + self.forget_us))

    def close(self) -> None:
        pass


def _after(micros: int) -> int:
    """The first millisecond at which the watermark is past a time."""
    return micros // 1000 + 1


def first_by_time(
    stream: DataFrame, keys: list[str], time: str, delay: str, order: list[str] | None = None, forget: str | None = None
) -> DataFrame:
    """The rows of ``stream`` that are first of their key, and all late ones, told apart by ``late``.

    First means the least ``time``, then ``order`` (columns that make the order total, null first). A row is handed out when the
    watermark, ``delay`` behind the newest time, has passed it. Rows older than the watermark at their arrival and rows without a
    time are late. Null keys are a key. Keys are remembered for ever, or with ``forget`` (as ``"30 days"``) for that span of event
    time, so that the state is bounded and a key that returns later counts as new. A key's rows pass through one task but are not held.
    """
    fields = list(stream.schema.fields)
    names = [f.name for f in fields]
    opened = [T.StructField(f.name, f.dataType, True) for f in fields]
    state = T.StructType([*opened, T.StructField(MICROS, T.LongType()), T.StructField("__done", T.BooleanType())])
    out = T.StructType([*opened, T.StructField(LATE, T.BooleanType())])
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = None
    if forget is not None:
        span = stream.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{forget}')").first()[0]
    watched = stream.withWatermark(time, delay)
    # a computed column carries no watermark mark
    plain = watched.select(*[_unmarked(f) if f.name == time else F.col(f"`{f.name}`") for f in fields], micros.alias(MICROS))
    return plain.groupBy(*keys).transformWithState(
        statefulProcessor=FirstByTime(names, order or [], state, span), outputStructType=out, outputMode="Append", timeMode="EventTime",
    )


def _unmarked(field: T.StructField):
    return F.timestamp_micros(F.unix_micros(F.col(f"`{field.name}`").cast("timestamp"))).cast(field.dataType).alias(field.name)


@contextmanager
def _timers_enabled(spark: SparkSession):
    """Timers need the RocksDB state store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_first_by_time(firsts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all files not yet seen, append first rows to ``path/late=false`` and late ones to ``path/late=true``, stop.

    A first row stays in the state until the watermark has passed it; a row with a later time (a heartbeat) releases it.
    """
    with _timers_enabled(firsts.sparkSession):
        query = (
            firsts.writeStream.format("parquet").outputMode("append").partitionBy(LATE)
            .option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


def read_firsts(spark: SparkSession, path: str) -> DataFrame:
    """Both tables of ``run_first_by_time`` with ``late`` as a boolean."""
    return spark.read.parquet(path).withColumn(LATE, F.col(LATE).cast("boolean"))
