"""Frames: throttling by the last kept frame, the latest frame of each device, and classification of a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTERVAL_MS = 500
#: Milliseconds of one device that a task folds in one go, at least, and that many intervals at least.
BLOCK_MS, INTERVALS = 3_600_000, 64


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((device, block), rows) of sorted batches whose first columns are device and block."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, lambda row: row[:2])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _ways(times: Iterator[int], bound: int, interval: int) -> tuple[list[int], list[int]]:
    """Where the first frame of a block may be kept (below bound, or the next one), and the time of the last frame then kept.

    Entries that lead to the same last frame stand together: `until` is the last of each run of them, `leave` where it leads.
    """
    entry: list[int] = []
    lasts: deque = deque()  # (last kept time, tree of the entries that lead to it), by time
    for t in times:
        here = None
        while lasts and t - lasts[0][0] >= interval:
            own = lasts.popleft()[1]
            here = own if here is None else (here, own)
        if not entry or entry[-1] < bound:
            here = len(entry) if here is None else (here, len(entry))
            entry.append(t)
        if here is not None:
            lasts.append((t, here))
    leave = [0] * len(entry)
    for last, tree in lasts:
        todo = [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                leave[x] = last
    ends = [k for k in range(len(entry)) if k + 1 == len(entry) or leave[k + 1] != leave[k]]
    return [entry[k] for k in ends], [leave[k] for k in ends]


def throttle(frames: DataFrame, device: str, ms: str, key: str, interval: int = INTERVAL_MS) -> DataFrame:
    """Batch: keeps a frame unless it is less than `interval` after the last one kept of its device (the first one always stays).

    Of frames at the same millisecond only the one with the least key can stay. A device's time is cut into blocks of BLOCK_MS, or of
    INTERVALS intervals if that is more, which are folded by themselves: first for each of the few times at which the first kept frame of
    a block may be (those of its first interval); from that it follows, block by block, what was kept last before each of them. Ways that
    meet go on as one, so a block says little. So a task holds no list of frames, and a device with many of them is spread over tasks.
    Frames without a time all stay.
    """
    block_ms = max(BLOCK_MS, INTERVALS * interval)
    rows = frames.select(F.col(device).alias("d"), F.col(ms).cast("long").alias("t"), F.col(key).alias("key"))
    done = rows.select(F.col("d").alias(device), "key", "t")
    if interval <= 0:
        return done.select(device, F.col("key").alias(key))
    first = rows.where("t is not null").groupBy("d", F.floor(F.col("t") / F.lit(block_ms)).alias("block"), "t").agg(F.min(F.struct("key")).alias("k")).select("d", "block", "t", "k.key")
    kinds = {c: first.schema[c].dataType.simpleString() for c in ("d", "key")}

    def ways(batches):
        batches = iter(batches)
        b = next(batches, None)
        if b is not None:
            schema = pa.schema([b.schema.field("d"), ("block", pa.int64()), ("until", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))])
            yield from _batches(((*k, *_ways((t for _, _, t in own), k[1] * block_ms + interval, interval)) for k, own in _runs(_chain(b, batches))), schema)

    def before(batches):
        batches = iter(batches)
        b = next(batches, None)

        def run():
            now, last = (), None
            for (d, block), own in _runs(_chain(b, batches)):
                if now != (d,):
                    now, last = (d,), None
                yield d, block, last
                for _, _, until, leave in own:
                    at = 0 if last is None else int(np.searchsorted(until, last + interval))
                    last = leave[at] if at < len(leave) else last

        if b is not None:
            yield from _batches(run(), pa.schema([b.schema.field("d"), ("block", pa.int64()), ("last", pa.int64())]))

    def kept(batches):
        batches = iter(batches)
        b = next(batches, None)

        def run():
            for (d, _), own in _runs(_chain(b, batches)):
                last = None
                for nth, (_, _, t, key, start) in enumerate(own):
                    last = start if nth == 0 else last
                    if last is None or t - last >= interval:
                        last = t
                        yield d, key

        if b is not None:
            yield from _batches(run(), pa.schema([b.schema.field("d"), b.schema.field("key")]))

    parts = first.select("d", "block", "t").repartition("d", "block").sortWithinPartitions("d", "block", "t").mapInArrow(ways, f"d {kinds['d']}, block long, until array<long>, leave array<long>")
    starts = parts.repartition("d").sortWithinPartitions("d", "block").mapInArrow(before, f"d {kinds['d']}, block long, last long")
    starts = starts.select(F.col("d").alias("d2"), F.col("block").alias("block2"), "last")
    both = first.join(starts, F.col("d").eqNullSafe(F.col("d2")) & (F.col("block") == F.col("block2"))).select("d", "block", "t", "key", "last")
    out = both.repartition("d", "block").sortWithinPartitions("d", "block", "t").mapInArrow(kept, f"d {kinds['d']}, key {kinds['key']}")
    return out.select(F.col("d").alias(device), F.col("key").alias(key)).union(done.where("t is null").select(device, "key"))


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def throttle_stream(frames: DataFrame, device: str, ms: str, key: str, interval: int = INTERVAL_MS, forget_ms: int | None = None) -> DataFrame:
    """The same for a stream: the state of a device is the time of its last kept frame. Frames of a micro-batch go in order of time.

    With forget_ms the state of a device that sends nothing for so long is dropped, and its next frame is kept as its first one. Such a
    stream has to look for silent devices all the time, so it does not end by itself when its input does.
    """
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (device, ms, key)}

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows, kept = pd.concat(list(parts)).sort_values([ms, key]), []
        for t, k in zip(rows[ms], rows[key], strict=True):
            if last is None or t - last >= interval:
                last = int(t)
                kept.append((of[0], t, k))
        if last is not None:
            state.update((last,))
            if forget_ms is not None:
                state.setTimeoutDuration(max(forget_ms, interval, 1))
        yield pd.DataFrame(kept, columns=[device, ms, key])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (device, ms, key))
    return frames.groupBy(device).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest(frames: DataFrame, device: str, ms: str, key: str | None = None) -> DataFrame:
    """Of each device the newest frame alone; of frames of the same time the one with the largest key."""
    rest = [c for c in frames.columns if c != device]
    order = F.struct(ms, key) if key else F.col(ms)
    return frames.groupBy(device).agg(F.max_by(F.struct(*rest), order).alias("f")).select(device, "f.*")


def classify_stream(frames: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, device: str = "device", ms: str = "ms", newest_only: bool = True):
    """Each micro-batch: the newest frame of each device (others are dropped), classified, to a folder of its own below `out`. Returns the query.

    A batch that is run again after a failure writes its folder anew, so it is there once; batch_id is the partition column of `out`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, device, ms) if newest_only else batch
        classify(rows).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
