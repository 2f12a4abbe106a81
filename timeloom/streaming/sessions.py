"""Streams with state: gap sessions of many files, and job records that live and expire."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The state store that processors with timers need, for queries that start here; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _seconds(text: str) -> float:
    number, unit = text.split()
    return float(number) * {"millisecond": 0.001, "second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86_400.0}[unit.removesuffix("s")]


def merged_sessions(start: np.ndarray, reach: np.ndarray, end: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches (start, reach, end, n) put together where one starts no later than those before it reach; places in milliseconds."""
    order = np.argsort(start, kind="stable")
    start, reach, end, n = start[order], reach[order], end[order], n[order]
    open_ = np.maximum.accumulate(reach)
    head = np.flatnonzero(np.append(True, start[1:] > open_[:-1])) if len(start) else np.zeros(0, np.int64)
    if not len(head):
        return start, reach, end, n
    return start[head], np.maximum.reduceat(reach, head), np.maximum.reduceat(end, head), np.add.reduceat(n, head)


SESSIONS = "file_id bigint, start_us bigint, end double, n_words bigint"


class _Sessions(StatefulProcessor):
    """State of a file: its sessions so far. They come out, and the state goes, when the file's timer runs out."""

    def __init__(self, pause_ms: int, quiet_ms: int) -> None:
        self.pause, self.quiet = pause_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", "start long, reach long, end double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [np.array(list(self.open.get()), float).reshape(-1, 4)] if self.open.exists() else []
        arrived = 0
        for frame in rows:
            start = (frame["start"].to_numpy(float) * 1000).round()
            end = frame["end"].to_numpy(float)
            reach = np.maximum((end * 1000).round(), start) + self.pause
            parts.append(np.column_stack([start, reach, end, np.ones(len(frame))]))
            arrived = max(arrived, int(frame["arrived"].max().timestamp() * 1000))
        every = np.concatenate(parts)
        merged = merged_sessions(every[:, 0], every[:, 1], every[:, 2], every[:, 3])
        self.open.put([(int(a), int(b), float(c), int(d)) for a, b, c, d in zip(*merged)])
        later = arrived + self.quiet
        timers = list(self.handle.listTimers())
        if not timers or later > max(timers):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(later)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.open.get())
        self.open.clear()
        yield pd.DataFrame({"file_id": [key[0]] * len(held), "start_us": [int(x[0]) * 1000 for x in held], "end": [float(x[2]) for x in held], "n_words": [int(x[3]) for x in held]})

    def close(self) -> None:
        pass


def gap_sessions(words: DataFrame, pause: str = "300 milliseconds", quiet: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """Sessions of a file's words by silence, from a stream of words (file_id, start, end, arrived).

    `start` and `end` are places in a file, `arrived` is when a word came in. Each file has a timer of its own: when nothing of it has
    arrived for `quiet`, by the watermark over `arrived` (`late` behind the latest), its sessions come out and its state goes. So files
    may arrive one after another, in parts and out of order; words after that are a file of their own. A query over this starts within
    `state_store`."""
    rows = words.select("file_id", "start", "end", "arrived").withWatermark("arrived", late)
    processor = _Sessions(round(_seconds(pause) * 1000), round(_seconds(quiet) * 1000))
    return rows.groupBy("file_id").transformWithStateInPandas(processor, SESSIONS, "Append", "EventTime")


#: What an event makes of a job in a state; other pairs change nothing.
MOVES = {("", "submit"): "queued", ("queued", "start"): "running", ("running", "finish"): "done", ("running", "fail"): "failed", ("running", "refuse"): "refused", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("queued", "restart"): "failed", ("running", "restart"): "failed"}
KEPT_LINES = 40
STATES = "id string, state string, n_events bigint, log array<string>, at timestamp"
EXPIRED = "expired"


class _Jobs(StatefulProcessor):
    """State of a job: a value (its state, how many events, when the last was) and a list (the last lines of its log)."""

    def __init__(self, keep_ms: int) -> None:
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, n long, at timestamp")
        self.log = handle.getListState("log", "line string")

    def _lines(self) -> list[str]:
        return [x[0] for x in self.log.get()] if self.log.exists() else []

    def _kept(self, state: str, n: int, at: pd.Timestamp, lines: list[str]) -> None:
        self.job.update((state, n, at.to_pydatetime()))
        if lines:
            self.log.put([(x,) for x in lines])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.keep)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self._kept(row["state"], int(row["n_events"]), pd.Timestamp(row["at"]), [str(x) for x in row["log"]][-KEPT_LINES:])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, n, at = self.job.get() if self.job.exists() else ("", 0, None)
        at, lines = None if at is None else pd.Timestamp(at), self._lines()
        for r in pd.concat(list(rows)).sort_values(["at", "event", "line"]).itertuples(index=False):
            state, n = MOVES.get((state, r.event), state), n + 1
            at = r.at if at is None else max(at, r.at)
            if r.line is not None:
                lines = [*lines, r.line][-KEPT_LINES:]
        self._kept(state, n, at, lines)
        yield pd.DataFrame({"id": [key[0]], "state": [state], "n_events": [n], "log": [lines], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, n, at = self.job.get()
        yield pd.DataFrame({"id": [key[0]], "state": [EXPIRED], "n_events": [n], "log": [[]], "at": [pd.Timestamp(at)]})
        self.job.clear()
        self.log.clear()

    def close(self) -> None:
        pass


def job_states(events: DataFrame, history: DataFrame | None = None, keep: str = "30 days", late: str = "0 seconds") -> DataFrame:
    """Updates (STATES) of jobs from a stream of events (id, at, event, line), each with the job's last KEPT_LINES lines.

    history: jobs (id, state, n_events, log, at) that were there before the stream's first batch. A job without an event for `keep`, by
    the watermark over `at`, comes out as expired, and its state goes. A query over this starts within `state_store`, in update mode."""
    rows = events.select("id", "at", "event", "line").withWatermark("at", late)
    start = history.select("id", "state", "n_events", "log", "at").groupBy("id") if history is not None else None
    return rows.groupBy("id").transformWithStateInPandas(_Jobs(round(_seconds(keep) * 1000)), STATES, "Update", "EventTime", start)
