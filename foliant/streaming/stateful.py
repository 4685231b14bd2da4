"""Streamed replies with state of their own: deltas in a list, timers for silence, for the whole, and for what follows a terminal event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .replies import Limits

REPLY = "request_id string, text string, finish_reason string, status string, connection string"
_HEAD = "begin double, heard double, reason string, chars bigint, ended string, until double, last bigint"


class Replies(StatefulProcessor):
    """One reply a request. Events of a batch are taken by seq, those of a later batch behind them.

    After `done` or the size cap the reply is complete, but the connection has `drain_s` more seconds to end by itself (an event `eof`): then it is kept, otherwise dropped. A timer stands
    for whichever limit comes first. An end without a terminal event is ok with a finish reason, incomplete without.
    """

    def __init__(self, limits: Limits, drain_s: float):
        self.limits, self.drain_s = limits, drain_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.deltas = handle.getListState("deltas", "delta string")

    def _limit(self, row: dict) -> float:
        if row["ended"]:
            return row["until"]
        return min(row["heard"] + self.limits.idle_s, row["begin"] + self.limits.wall_s)

    def _reply(self, key: str, row: dict, end: str, connection: str) -> pd.DataFrame:
        status = end if end in ("idle_timeout", "wall_timeout", "error", "incomplete") else "ok"
        text = "".join(d[0] for d in self.deltas.get()) if status == "ok" else None
        reason = None if status != "ok" else "length" if end == "cap" else row["reason"]
        self.deltas.clear()
        self.head.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        return pd.DataFrame({"request_id": [key], "text": [text], "finish_reason": [reason], "status": [status], "connection": [connection]})

    def _due(self, key: str, row: dict, at: float) -> pd.DataFrame | None:
        """The reply, if a limit was passed before `at`."""
        if row["ended"]:
            return self._reply(key, row, row["ended"], "dropped") if at > row["until"] else None
        if at - row["begin"] > self.limits.wall_s:
            return self._reply(key, row, "wall_timeout", "dropped")
        if at - row["heard"] > self.limits.idle_s:
            return self._reply(key, row, "idle_timeout", "dropped")
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("begin", "heard", "reason", "chars", "ended", "until", "last")
        row = dict(zip(names, self.head.get())) if self.head.exists() else None
        for e in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            at = e.ts.timestamp()
            if row is None:
                row = {"begin": at, "heard": at, "reason": None, "chars": 0, "ended": None, "until": None, "last": -1}
            late = self._due(key[0], row, at)
            if late is not None:
                yield late
                return
            row["last"] = int(e.seq)
            if row["ended"]:
                if e.kind == "eof":
                    yield self._reply(key[0], row, row["ended"], "kept")
                    return
                continue
            if e.kind == "error":
                yield self._reply(key[0], row, "error", "dropped")
                return
            if e.kind == "eof":
                yield self._reply(key[0], row, "done" if row["reason"] else "incomplete", "kept")
                return
            if e.kind == "data":
                text = "" if e.delta is None or e.delta != e.delta else e.delta
                if text:
                    self.deltas.appendValue((text,))
                row["heard"], row["chars"] = at, row["chars"] + len(text)
                if e.finish_reason is not None and e.finish_reason == e.finish_reason:
                    row["reason"] = e.finish_reason
            if e.kind == "done" or row["chars"] >= self.limits.chars:
                row["ended"] = "done" if e.kind == "done" else "cap"
                row["until"] = min(at + self.drain_s, row["heard"] + self.limits.idle_s)
        self.head.update(tuple(row[n] for n in names))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(self._limit(row) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.head.exists():
            return
        row = dict(zip(("begin", "heard", "reason", "chars", "ended", "until", "last"), self.head.get()))
        if row["ended"]:
            end = row["ended"]
        elif row["begin"] + self.limits.wall_s <= row["heard"] + self.limits.idle_s:
            end = "wall_timeout"
        else:
            end = "ok" if row["reason"] else "idle_timeout" if row["chars"] else "incomplete"
        yield self._reply(key[0], row, end, "dropped")

    def close(self) -> None:
        pass


def replies(events: DataFrame, limits: Limits = Limits(), drain_s: float = 5.0, late: str = "10 seconds") -> DataFrame:
    """events (request_id, seq, ts, kind, delta, finish_reason; kind may be eof) to one row a request, as it ends. Timers go by event time, so a replay gives the same rows; needs the RocksDB state store."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.withWatermark("ts", late).groupBy("request_id").transformWithStateInPandas(statefulProcessor=Replies(limits, drain_s), outputStructType=REPLY, outputMode="Append", timeMode="EventTime")
