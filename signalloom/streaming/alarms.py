"""Alarms with state per key: unanswered requests, and congestion windows that start at an event.

Both hold what has come until the watermark has passed it, so the order in which rows arrive does not matter. State is
bounded by what a key sends within its timeout, or the window, and the allowed lateness.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from signalloom.config import RanRules
from signalloom.operators.transactions import requests_and_answers, threshold
from signalloom.streaming.traffic import event_time

REQUEST_KEY = ["capture_id", "protocol", "seq", "sess", "asked_by", "asked_of"]
_RULES = RanRules()


class _Unanswered(StatefulProcessor):
    """Rows of one key, kept from the oldest request that is not decided yet. What comes at once is one entry of the state:
    rows of frame, time, due time and kind, as the bytes of an array."""

    REQUEST, ANSWER, TOLD = range(3)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = []
        for batch in rows:
            kind = np.where(batch.answer.to_numpy(dtype=bool), self.ANSWER, self.REQUEST)
            found = np.column_stack([batch[c].to_numpy(dtype="<i8") for c in ("frame_number", "ts_us", "due_us")] + [kind])
            self.rows.appendValue((found.astype("<i8").tobytes(),))
            due = found[kind == self.REQUEST, 2]
            if len(due):
                first.append(int(due.min()))
        if first:
            self.handle.registerTimer(-(-min(first) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        kept = [np.frombuffer(r[0], dtype="<i8").reshape(-1, 4) for r in self.rows.get()]
        if not kept:
            return
        rows = np.concatenate(kept)
        rows = rows[np.lexsort(rows.T[::-1])]
        frame, ts, due, kind = rows.T
        asked = kind == self.REQUEST
        waits = asked & (due > now)
        answered = np.zeros(len(rows), dtype=bool)
        answered[:-1] = (kind[1:] == self.ANSWER) & (ts[1:] <= due[:-1])
        lost = asked & ~waits & ~answered
        if waits.any():
            # requests that are decided stay between the others, but are not told again
            rest = rows.copy()
            rest[asked & ~waits, 3] = self.TOLD
            self.rows.put([(rest[waits.argmax() :].tobytes(),)])
            self.handle.registerTimer(-(-int(due[waits].min()) // 1000))
        else:
            self.rows.clear()
        if lost.any():
            names = dict(zip(REQUEST_KEY, key, strict=True))
            alarm = pd.DataFrame({"frame_number": frame[lost], "ts_us": ts[lost], "due_us": due[lost]})
            yield alarm.assign(capture_id=names["capture_id"], protocol=names["protocol"])[
                ["capture_id", "protocol", "frame_number", "ts_us", "due_us"]
            ]

    def close(self) -> None:
        pass


def unanswered_alarms(transactions: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Requests of a stream of transactions that no response answered within their protocol's time.

    A response answers the request right before it of its reversed direction, as in the batch pairing; the alarm is
    raised once the watermark passes the request's time and its protocol's limit (``due_us``)."""
    rows = requests_and_answers(transactions).filter("ts_us is not null")
    limit = (threshold(F.col("protocol"), "response_timeout_ms") * 1000).cast("bigint")
    rows = rows.select(
        "capture_id",
        "protocol",
        "seq",
        F.col("_id").alias("sess"),
        F.col("_from").alias("asked_by"),
        F.col("_to").alias("asked_of"),
        "frame_number",
        "ts_us",
        F.col("_answer").alias("answer"),
        (F.col("ts_us") + limit).alias("due_us"),
        event_time().alias("ts"),
    ).withWatermark("ts", late)
    return rows.groupBy(*REQUEST_KEY).transformWithStateInPandas(
        _Unanswered(),
        "capture_id string, protocol string, frame_number long, ts_us long, due_us long",
        "append",
        "eventTime",
    )


class _Anchored(StatefulProcessor):
    """The times of a UE that the watermark has not passed, and the last ones before."""

    def __init__(self, events: int, window_us: int) -> None:
        self.events = events
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "ts long")
        self.past = handle.getListState("past", "ts long")
        self.alarmed = handle.getValueState("alarmed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.alarmed.exists():
            first = []
            for batch in rows:
                self.ahead.appendList([(int(t),) for t in batch.ts_us])
                first.append(int(batch.ts_us.min()))
            if first:
                self.handle.registerTimer(-(-min(first) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.alarmed.exists():
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(int(r[0]) for r in self.ahead.get())
        ring = deque((int(r[0]) for r in self.past.get()), maxlen=self.events)
        passed = [t for t in times if t <= now]
        for at in passed:
            ring.append(at)
            if len(ring) == self.events and at - ring[0] <= self.window_us:
                self.alarmed.update((at,))
                self.ahead.clear()
                self.past.clear()
                yield pd.DataFrame([(key[0], key[1], ring[0], at)], columns=["capture_id", "ue_key", "start_us", "reached_us"])
                return
        if ring:
            self.past.put([(t,) for t in ring])
        rest = times[len(passed) :]
        if rest:
            self.ahead.put([(t,) for t in rest])
            self.handle.registerTimer(-(-rest[0] // 1000))
        else:
            self.ahead.clear()

    def close(self) -> None:
        pass


def anchored_congestion(events: DataFrame, rules: RanRules = _RULES, late: str = "10 seconds") -> DataFrame:
    """The first event of each UE with enough events in the window that starts with it (``start_us``), and when the last
    of these came; the exact twin of the batch rule. Events count once the watermark has passed them."""
    rows = events.filter("ts_us is not null").select("capture_id", "ue_key", "ts_us", event_time().alias("ts"))
    return rows.withWatermark("ts", late).groupBy("capture_id", "ue_key").transformWithStateInPandas(
        _Anchored(rules.congestion_events, rules.congestion_window_us),
        "capture_id string, ue_key string, start_us long, reached_us long",
        "append",
        "eventTime",
    )
