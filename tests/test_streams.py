"""The drift average of a stream against the batch form, with files in any order over several triggers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from millwright.operators import scan
from millwright.streaming import jobs, ordered

SCHEMA = "machine string, ts timestamp, event_id bigint, value double"
T0 = datetime(2024, 1, 1)


def rows_of(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for m in ("A", "B", None):
        t = T0
        for i in range(n):
            t += timedelta(seconds=rng.choice([0, 1, 30, 60]), microseconds=rng.choice([0, 0, 7]))
            out.append((m, t, i * 3 + len(m or "xx"), None if rng.random() < 0.2 or 20 < i < 40 else rng.random()))
    return out


def write(spark, folder, parts):
    """One file a part; a later file has a later modification time, so triggers take them in this order."""
    import os

    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        new = max((f for f in folder.iterdir() if f.suffix == ".parquet"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(new, (1_700_000_000 + 60 * k,) * 2)


def batch(spark, rows, alpha):
    df = spark.createDataFrame(rows, SCHEMA)
    numbered = scan.row_index(df, ["machine"], "ts", ties=["event_id"])
    return {(r["machine"], r["event_id"]): r["ewma"] for r in scan.ewma(numbered, ["machine"], "rn", "value", alpha).collect()}


def stream(spark, folder, alpha, delay, files=1, forget_s=None):
    end = jobs.Closing(spark)
    live = jobs.read_files(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files)
    out = jobs.drain(jobs.ewma(end.over(live, "ts"), alpha, delay, forget_s), "test-ewma", end, ordered=True)
    return {(r["machine"], r["event_id"]): r["ewma"] for r in out.collect()}


def test_shuffled_triggers_equal_the_batch(spark, tmp_path):
    rows = rows_of(150, 4)
    mixed = list(rows)
    random.Random(2).shuffle(mixed)
    write(spark, tmp_path / "in", [mixed[i::4] for i in range(4)])
    got, want = stream(spark, tmp_path / "in", 0.3, "10 hours"), batch(spark, rows, 0.3)
    assert got.keys() == want.keys()
    assert {k: v is None for k, v in got.items()} == {k: v is None for k, v in want.items()}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=1e-9)


def test_late_rows_are_dropped_and_early_ones_leave_before_the_end(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    parts = [[("A", at(60), 3, 3.0), ("A", at(0), 1, 1.0)], [("A", at(120), 5, 5.0)], [("A", at(5), 2, 99.0), ("A", at(115), 4, 4.0)]]
    write(spark, tmp_path / "in", parts)
    kept = [r for part in parts for r in part if r[2] != 2]
    assert stream(spark, tmp_path / "in", 0.5, "10 minutes") == pytest.approx(batch(spark, kept, 0.5))


def test_a_silent_machine_is_forgotten(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    write(spark, tmp_path / "in", [[("A", at(0), 1, 8.0), ("A", at(1), 2, 4.0), ("A", at(500), 3, 1.0)]])
    assert stream(spark, tmp_path / "in", 0.5, "10 minutes", forget_s=3600)["A", 3] == 1.0


def test_odd_times_ids_and_values(spark, tmp_path):
    """Instants pandas can't hold, ids no double can hold, rows without id, value or time."""
    big = 2**53 + 1
    rows = [("A", T0, big, 4.0), ("A", T0, big + 1, 2.0), ("A", T0, None, 1.0), ("A", datetime(1960, 1, 1), 7, None), ("A", datetime(8000, 1, 1), 8, 9.0),
            ("A", datetime(8000, 1, 2), 3, 1.0), ("A", datetime(2230, 1, 1), 9, 5.0), (None, T0, 1, None), ("B", T0, None, None)]
    write(spark, tmp_path / "in", [rows[3:4], [*rows[:3], *rows[4:], ("A", None, 5, 5.0)]])
    got, want = stream(spark, tmp_path / "in", 0.5, "1 hour"), batch(spark, rows, 0.5)
    del want["A", 7]  # before 1970, where the watermark starts: late
    assert got == want


class Held:
    """The state of one key in memory, with the packed values put and taken."""

    def __init__(self):
        self.value, self.map, self.timers, self.put, self.taken = {}, {}, set(), 0, 0

    def getValueState(self, name, schema):
        held = self

        class Value:
            exists = staticmethod(lambda: name in held.value)
            get = staticmethod(lambda: held.value[name])
            update = staticmethod(lambda v: held.value.update({name: v}))

        return Value

    def getMapState(self, name, keys, schema):
        held = self

        class Map:
            @staticmethod
            def updateValue(k, v):
                held.put, held.map[k] = held.put + 1, v

            @staticmethod
            def getValue(k):
                held.taken += 1
                return held.map[k]

            removeKey = staticmethod(held.map.pop)

        return Map

    def registerTimer(self, ms):
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_waiting_rows_are_packed_and_read_once(monkeypatch):
    """Blocks leave once and in order, whatever waits behind them; a firing timer does not rewrite the other rows."""
    monkeypatch.setattr(ordered, "RUN", 64)
    monkeypatch.setattr(ordered, "BLOCK", 8)
    rng, held, out, every, fired = random.Random(5), Held(), [], [], 0
    drift = ordered.Drift(0.2)
    drift.init(held)
    for trigger in range(12):
        lo = trigger * 100
        rows = [((lo + rng.randrange(4000)) // 7 * 7 * 1000, 1, len(every) + i, rng.choice([rng.random(), float("nan")])) for i in range(500)]
        every += rows
        part = pd.DataFrame(rows, columns=["us", "named", "event_id", "value"])
        assert list(drift.handleInputRows(("A",), iter([part[:200], part[200:]]), held)) == []
        held.watermark = lo + 99 if trigger < 11 else 10_000
        while due := sorted(t for t in held.timers if t <= held.watermark):
            held.timers.discard(due[0])
            fired += 1
            out += [tuple(r) for part in drift.handleExpiredTimer(("A",), held, None) for r in part[["us", "event_id", "ewma"]].itertuples(index=False)]
    assert [(r[0], r[1]) for r in out] == sorted((r[0], r[2]) for r in every) and not held.map
    assert held.put <= len(every) / 8 + 12 * 8 * 2 + fired * 12 * 8 and held.taken == held.put
    num, den, want = 0.0, 0.0, []
    for us, _, event, value in sorted(every):
        num, den = num * 0.8 + (value if value == value else 0.0), den * 0.8 + (value == value)
        want.append((us, event, num / den if den else float("nan")))
    assert [r[2] for r in out] == pytest.approx([w[2] for w in want], nan_ok=True)
