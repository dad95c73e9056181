"""Only the newest frame of each device, across micro-batches: a processor with one frame of state, a pending one, timers, and a time to live.

State of a device: time and key of the newest frame that went on, when that was, and at most one pending frame. So it does not grow with the frames.

Defined cases: of frames at one time the one with the largest key is the newest; an older frame than the one that went on last is dropped, also
when it comes in a later micro-batch, and a repeated one as well; frames without a time are dropped; a null device is a device; an empty
batch says nothing; other columns go along with their frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams with a processor have to be started inside; the setting is put back behind."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Newest(StatefulProcessor):
    """Lets a device's newest frame through, at most one in `interval` milliseconds of processing time; what comes meanwhile waits as the pending frame."""

    def __init__(self, schema: str, columns: list[str], whole: set[str], ms: str, key: str, interval: int, forget_ms: int | None):
        self.schema, self.columns, self.whole, self.ms, self.key, self.interval, self.forget_ms = schema, columns, whole, ms, key, interval, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        live = {} if self.forget_ms is None else {"ttlDurationMs": self.forget_ms}
        self.last = handle.getValueState("last", self.schema, **live)
        self.at = handle.getValueState("at", "ms long", **live)
        self.pending = handle.getValueState("pending", self.schema, **live)

    def _value(self, column: str, v):
        """A plain value for the state; a column with nulls comes with whole numbers as floats."""
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if column in self.whole else v

    def _order(self, row: tuple) -> tuple:
        return row[self.columns.index(self.ms)], row[self.columns.index(self.key)]

    def _sent(self, row: tuple, now: int) -> pd.DataFrame:
        self.last.update(row)
        self.at.update((now,))
        self.pending.clear()
        return pd.DataFrame([row], columns=self.columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # one part after the other: no list of a device's frames
            part = part[part[self.ms].notna()]
            if len(part):
                one = part.sort_values([self.ms, self.key]).iloc[-1]
                row = tuple(self._value(c, one[c]) for c in self.columns)
                best = row if best is None or self._order(row) > self._order(best) else best
        for state in (self.last, self.pending):
            old = state.get() if state.exists() else None
            if best is not None and old is not None and self._order(tuple(old)) >= self._order(best):
                best = None
        if best is None:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.interval else 0
        due = (self.at.get()[0] if self.at.exists() else now - self.interval) + self.interval if self.interval else 0
        if now >= due:
            yield self._sent(best, now)
        else:
            self.pending.update(best)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            yield self._sent(tuple(self.pending.get()), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def newest_stream(frames: DataFrame, device: str, ms: str, key: str, interval: int = 0, forget_ms: int | None = None) -> DataFrame:
    """The stream of newest frames; start it inside state_in_rocksdb().

    With an interval or forget_ms (after which the state of a silent device goes) the stream looks at the clock all the time, so it does
    not end by itself when its input does.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    whole = {c for c, kind in frames.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    processor = Newest(schema, frames.columns, whole, ms, key, interval, forget_ms)
    mode = "None" if not interval and forget_ms is None else "ProcessingTime"
    return frames.groupBy(device).transformWithStateInPandas(processor, schema, "Append", mode)
