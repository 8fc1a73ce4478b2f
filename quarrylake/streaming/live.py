"""Folds over time as streams: transformWithState with the open fold as value state, rows that may still be overtaken as map state, and timers.

Rows come in any order within the watermark. A key keeps them until the watermark has passed, then folds them in order; so the result is that of the batch operators, whatever the
micro-batches. A timer also ends what only silence ends: no next row is needed. State lives in the state store, hence a query that starts again goes on where it was."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """fields: the schema of a key's state, longs; step(state or None, t, flag) gives the state then and a list of results; silent(state) gives the time at which a silence ends the
    state, or None; ended(state) the results then."""

    fields: str = "last long"
    columns: list[str] = []

    def step(self, state: tuple | None, t: int, flag: int) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def silent(self, state: tuple) -> int | None:
        return None

    def ended(self, state: tuple) -> list[tuple]:
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.fields)
        self.waiting = handle.getMapState("waiting", "t long, flag long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        added: dict[tuple[int, int], int] = {}
        for b in rows:
            for t, flag in zip(b["t"], b["flag"], strict=True):
                added[int(t), int(flag)] = added.get((int(t), int(flag)), 0) + 1
        for at, n in added.items():
            before = self.waiting.getValue(at)
            self.waiting.updateValue(at, (n + (before[0] if before else 0),))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        """Folds what no row can come before any more, ends what is over, and sets the timer for what is next."""
        now = watermark // 1000
        rows = sorted((tuple(map(int, at)), int(n[0])) for at, n in self.waiting.iterator())
        found = self.open.get()
        state, out = (tuple(map(int, found)) if found is not None else None), []
        for (t, flag), n in rows:
            if t >= now:
                break
            for _ in range(n):
                if state is not None and (end := self.silent(state)) is not None and end <= t:
                    out += self.ended(state)
                    state = None
                state, made = self.step(state, t, flag)
                out += made
            self.waiting.removeKey((t, flag))
        end = self.silent(state) if state is not None else None
        if end is not None and end < now:
            out += self.ended(state)
            state = end = None
        if state is None:
            self.open.clear()
        else:
            self.open.update(state)
        left = [t for (t, _), _ in rows if t >= now]
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(due))
        if (due := min([t + 1 for t in left[:1]] + ([end + 1] if end is not None else []), default=None)) is not None:
            self.handle.registerTimer(due * 1000)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=self.columns)

    def close(self) -> None:
        pass


class Cooled(OrderedFold):
    columns = ["key", "t"]

    def __init__(self, seconds: int):
        self.seconds = seconds

    def step(self, state: tuple | None, t: int, flag: int) -> tuple[tuple, list[tuple]]:
        return (state, []) if state is not None and t - state[0] < self.seconds else ((t,), [(t,)])

    def silent(self, state: tuple) -> int | None:
        """After the cooldown a key needs no state."""
        return state[0] + self.seconds


class Bursts(OrderedFold):
    fields, columns = "first long, last long, n long", ["key", "first_t", "last_t", "n", "fires_at"]

    def __init__(self, quiet: int, most: int):
        self.quiet, self.most = quiet, most

    def step(self, state: tuple | None, t: int, flag: int) -> tuple[tuple, list[tuple]]:
        if state is None:
            return (t, t, 1), []
        first, last, n = state
        if last - first >= self.most:
            return (t, t, 1), [(first, last, n, last)]
        return (first, t, n + 1), []

    def silent(self, state: tuple) -> int | None:
        return state[1] + self.quiet

    def ended(self, state: tuple) -> list[tuple]:
        first, last, n = state
        return [(first, last, n, last if last - first >= self.most else last + self.quiet)]


class BackedOff(OrderedFold):
    fields, columns = "last long, fails long", ["key", "t", "failed"]

    def __init__(self, step_seconds: int, most_seconds: int):
        self.wait, self.most = step_seconds, most_seconds

    def step(self, state: tuple | None, t: int, flag: int) -> tuple[tuple, list[tuple]]:
        last, fails = state or (t, 0)
        if fails and t - last < min(self.wait * fails, self.most):
            return (last, fails), []
        return (t, fails + 1 if flag else 0), [(t, bool(flag))]


def _live(rows: DataFrame, fold: OrderedFold, schema: str, late: str) -> DataFrame:
    """rows: key, t (seconds), flag, a stream. Rows that come more than `late` after younger ones are too late."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(fold, outputStructType=schema, outputMode="append", timeMode="eventTime")


def cooled(alerts: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """folds.cooled of a stream."""
    return _live(alerts.select("key", "t", F.lit(0).cast("long").alias("flag")), Cooled(seconds), "key long, t long", late)


def capped_sessions(events: DataFrame, quiet: int, most: int, late: str = "1 minute") -> DataFrame:
    """folds.capped_sessions of a stream; a burst that silence ends comes when the watermark has passed its fires_at."""
    return _live(events.select("key", "t", F.lit(0).cast("long").alias("flag")), Bursts(quiet, most), "key long, first_t long, last_t long, n long, fires_at long", late)


def backed_off(attempts: DataFrame, late: str = "1 minute") -> DataFrame:
    """queue.backed_off of a stream."""
    from ..operators.queue import WATCH_MOST, WATCH_STEP

    return _live(attempts.select("key", "t", F.coalesce(F.col("failed"), F.lit(False)).cast("long").alias("flag")), BackedOff(WATCH_STEP, WATCH_MOST), "key long, t long, failed boolean", late)
