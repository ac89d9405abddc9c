"""State that puts a stream into event-time order: rows wait until the watermark passes, timers let them go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

US_PER_DAY = 86_400_000_000
FIRST, LAST, END, FAR = (d * US_PER_DAY for d in (-98_615, 84_006, 106_651, 2_567_655))
"""1700-01-01, 2200-01-01, 2262-01-01 and 9000-01-01: pandas holds no instant outside 1678 to 2261."""

ROW = np.dtype([("us", "i8"), ("named", "i1"), ("id", "i8"), ("value", "f8")])
RUN, BLOCK = 1 << 18, 1 << 13


@contextmanager
def ordered_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which list state and timers need; the setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def event_time(us: Column) -> Column:
    """The instant a row counts by against the watermark: its own, and in the order of time one that pandas holds."""
    inside = F.greatest(F.least(us, F.lit(LAST)), F.lit(FIRST))
    return F.timestamp_micros(F.when(us >= FAR, F.lit(END)).otherwise(inside))


class Drift(StatefulProcessor):
    """Bias-corrected exponentially weighted mean of one machine over its rows in event-time order.

    State: `mean` (numerator, denominator, average, time of the last row) and the rows the watermark has not passed. They
    wait in runs: up to RUN rows of one trigger, sorted, in `blocks` of up to BLOCK rows packed as bytes; `runs` holds the
    next run's number and (run, next block, end, first time) of those that still have rows. One timer stands at the earliest
    waiting row; when it fires, the runs are merged block by block up to the watermark and the timer moves on, so a task
    holds a block of each run, or the rows of one instant. No later row can precede those: the watermark drops it.

    Columns in: us, named (1 where the row has an event id), event_id (0 without), value. Out: `known` tells an average from
    none, since Arrow makes NaN of pandas a NULL.
    """

    OUT = "machine string, us bigint, named boolean, event_id bigint, known boolean, ewma double"

    def __init__(self, alpha: float, forget_s: int | None = None):
        if not 0.0 < alpha < 1.0:
            raise ValueError("alpha must lie between 0 and 1")
        self.q, self.forget_us = 1.0 - alpha, None if forget_s is None else forget_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mean = handle.getValueState("mean", "num double, den double, held double, last bigint")
        self.runs = handle.getValueState("runs", "following bigint, waiting binary")
        self.blocks = handle.getMapState("blocks", "run bigint, block bigint", "rows binary")

    def _wake(self, us: int) -> None:
        if us < FAR:
            self.handle.registerTimer(-(-min(us, LAST) // 1000))

    def _index(self) -> tuple[int, list[list[int]]]:
        if not self.runs.exists():
            return 0, []
        following, waiting = self.runs.get()
        return following, np.frombuffer(waiting, "i8").reshape(-1, 4).tolist()

    def _put(self, following: int, waiting: list[list[int]]) -> None:
        self.runs.update((following, np.array(waiting, "i8").tobytes()))

    def _add(self, run: int, rows: np.ndarray) -> list[int]:
        rows = rows[np.lexsort((rows["id"], rows["named"], rows["us"]))]
        starts = range(0, len(rows), BLOCK)
        for block, at in enumerate(starts):
            self.blocks.updateValue((run, block), (rows[at : at + BLOCK].tobytes(),))
        return [run, 0, len(starts), int(rows["us"][0])]

    def _take(self, run: int, block: int) -> np.ndarray:
        rows = np.frombuffer(bytes(self.blocks.getValue((run, block))[0]), ROW)
        self.blocks.removeKey((run, block))
        return rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added, held, size = [], [], 0
        following, waiting = self._index()
        for part in rows:
            packed = np.empty(len(part), ROW)
            for name, column in zip(ROW.names, ("us", "named", "event_id", "value"), strict=True):
                packed[name] = part[column].to_numpy()
            held.append(packed)
            size += len(packed)
            if size >= RUN:
                added.append(self._add(following + len(added), np.concatenate(held)))
                held, size = [], 0
        if size:
            added.append(self._add(following + len(added), np.concatenate(held)))
        if added:
            self._put(following + len(added), waiting + added)
            self._wake(min(r[3] for r in added))
        return iter(())

    def _due(self, waiting: list[list[int]], passed: int) -> Iterator[np.ndarray]:
        """Rows up to `passed`, in order and in portions; `waiting` and the blocks are left with the others."""
        heads = {r[0]: np.empty(0, ROW) for r in waiting if r[3] <= passed}
        reading = [r for r in waiting if r[0] in heads]
        limit = None
        while True:
            for r in reading:  # an instant that fills the block of a run is read to its end
                head = heads[r[0]]
                if r[1] < r[2] and (not len(head) or head["us"][-1] == limit):
                    heads[r[0]] = np.concatenate([head, self._take(r[0], r[1])])
                    r[1] += 1
            limit = min([int(heads[r[0]]["us"][-1]) for r in reading if r[1] < r[2]], default=passed + 1)
            limit = min(limit, passed + 1)
            ready = {run: int(np.searchsorted(head["us"], limit)) for run, head in heads.items()}
            if any(ready.values()):
                rows = np.concatenate([heads[run][:n] for run, n in ready.items()])
                heads = {run: heads[run][n:] for run, n in ready.items()}
                yield rows[np.lexsort((rows["id"], rows["named"], rows["us"]))]
            elif limit > passed:
                break
        for r in reading:
            head = heads[r[0]]
            if len(head):
                r[1], r[3] = r[1] - 1, int(head["us"][0])
                self.blocks.updateValue((r[0], r[1]), (head.tobytes(),))
        waiting[:] = [r for r in waiting if r[1] < r[2]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        passed = FAR - 1 if passed >= LAST else passed
        following, waiting = self._index()
        if not any(r[3] <= passed for r in waiting):
            return
        num, den, held, last = self.mean.get() if self.mean.exists() else (0.0, 0.0, None, None)
        for rows in self._due(waiting, passed):
            out = []
            for us, value in zip(rows["us"].tolist(), rows["value"].tolist(), strict=True):
                if self.forget_us is not None and last is not None and us - last > self.forget_us:
                    num, den, held = 0.0, 0.0, None
                num, den, last = num * self.q, den * self.q, us
                if value == value:
                    num, den = num + value, den + 1.0
                    held = num / den
                elif den < 1e-200 and held is not None:  # long runs of NULL would let both vanish; their ratio is kept
                    num, den = held * 1e-200, 1e-200
                out.append(held)
            yield pd.DataFrame({
                "machine": [key[0]] * len(out), "us": rows["us"], "named": rows["named"] == 1, "event_id": rows["id"],
                "known": [x is not None for x in out], "ewma": np.array(out, "f8"),
            })
        self.mean.update((num, den, held, last))
        self._put(following, waiting)
        if waiting:
            self._wake(min(r[3] for r in waiting))

    def close(self) -> None:
        pass
