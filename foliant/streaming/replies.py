"""Streamed replies: deltas of a request become one text, with idle and absolute limits, a size cap and a terminal event.

The same rules come as a batch query over recorded events and as a stateful streaming operator with timers.
events: request_id, seq, ts, kind (data, comment, done, error), delta, finish_reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "request_id string, text string, finish_reason string, status string"


@dataclass(frozen=True)
class Limits:
    idle_s: int = 120
    wall_s: int = 1800
    chars: int = 200_000


def assemble(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """request_id, text, finish_reason, status (ok, error, idle_timeout, wall_timeout, incomplete) of recorded events.

    What follows a terminal event is ignored; comments don't reset the idle clock; the event that reaches the cap is the last, with finish reason length.
    """
    w = Window.partitionBy("request_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    secs = F.unix_micros("ts") / 1e6
    data = F.col("kind") == "data"
    last = F.max(F.when(data, F.col("_s"))).over(before)
    begin = F.min("_s").over(so_far)
    rows = events.withColumn("_s", secs).withColumns({"_idle": F.col("_s") - F.coalesce(last, begin) > limits.idle_s, "_wall": F.col("_s") - begin > limits.wall_s, "_n": F.sum(F.when(data, F.coalesce(F.length("delta"), F.lit(0))).otherwise(0)).over(so_far)})
    ends = F.when(F.col("_wall"), "wall_timeout").when(F.col("_idle"), "idle_timeout").when(F.col("kind") == "error", "error").when(F.col("kind") == "done", "done").when(data & (F.col("_n") >= limits.chars), "cap")
    rows = rows.withColumn("_end", ends)
    rows = rows.withColumn("_over", F.max(F.when(F.col("_end").isNotNull(), 1).otherwise(0)).over(before)).filter("_over is null or _over = 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(data & ~F.coalesce(F.col("_end").isin("idle_timeout", "wall_timeout"), F.lit(False)), F.struct("seq", F.coalesce("delta", F.lit("")).alias("d"))))), lambda s: s.d), "")
    reason = F.max_by("finish_reason", F.when(data & F.col("finish_reason").isNotNull(), F.col("seq")))
    one = rows.groupBy("request_id").agg(said.alias("text"), reason.alias("reason"), F.max("_end").alias("end"))
    status = F.when(F.col("end").isin("wall_timeout", "idle_timeout", "error"), F.col("end")).when(F.col("end").isNotNull() | F.col("reason").isNotNull(), "ok").otherwise("incomplete")
    return one.select("request_id", F.when(status == "ok", F.col("text")).alias("text"), F.when(status == "ok", F.when(F.col("end") == "cap", "length").otherwise(F.col("reason"))).alias("finish_reason"), status.alias("status"))


_CHUNK = """struct<id:string, model:string, error:variant, choices:array<struct<delta:struct<content:string>, finish_reason:string>>,
  usage:struct<prompt_tokens:bigint, completion_tokens:bigint, cost:double>>"""


def sse_events(lines: DataFrame) -> DataFrame:
    """Raw lines of event streams (request_id, seq, ts, line) as events, with what each says of id, model, usage and an error's code.

    Comments and blank lines are comments; lines of other fields and data that can't be read are skipped, but one that says `[DONE]` ends the stream.
    """
    data = F.trim(F.substring("line", 6, 1 << 30))
    is_data = F.startswith("line", F.lit("data:"))
    event = F.from_json(F.when(is_data, data), _CHUNK)
    readable = F.startswith(F.schema_of_variant(F.try_parse_json(F.when(is_data, data))), F.lit("OBJECT"))
    rows = lines.withColumns({"event": F.when(readable, event), "data": F.when(is_data, data)})
    comment = (F.trim("line") == "") | F.startswith("line", F.lit(":"))
    failed = F.col("event.error").isNotNull() & ~F.is_variant_null("event.error")
    kind = F.when(comment, "comment").when(F.col("data") == "[DONE]", "done").when(failed, "error").when(F.col("event").isNotNull(), "data")
    first = F.try_element_at("event.choices", F.lit(1))
    code = F.try_variant_get("event.error", "$.code", "int")
    out = rows.select("request_id", "seq", "ts", kind.alias("kind"), first["delta"]["content"].alias("delta"), F.nullif(first["finish_reason"], F.lit("")).alias("finish_reason"), "event.id", "event.model", "event.usage", code.alias("code"))
    return out.filter("kind is not null")


def with_details(events: DataFrame, replies: DataFrame) -> DataFrame:
    """replies with id and model (of the first data event), usage (the last one told) and code (of the error), from events up to the terminal one."""
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col("kind").isin("done", "error")).over(before)
    live = events.withColumn("over", F.coalesce(ended, F.lit(False))).filter("not over")
    said = F.when(F.col("kind") == "data", F.col("seq"))
    told = live.groupBy("request_id").agg(
        F.min_by(F.struct("id", "model"), said).alias("first"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"),
        F.max(F.when(F.col("kind") == "error", F.col("code"))).alias("code"),
    )
    return replies.join(told, "request_id", "left").select(*replies.columns, "first.id", "first.model", "usage", "code")


def _step(state: dict, seq: int, at: float, kind: str, delta: str | None, reason: str | None, limits: Limits) -> str | None:
    """Takes one event into the state; what ended the request, if it did."""
    if state["begin"] is None:
        state["begin"] = state["heard"] = at
    if at - state["begin"] > limits.wall_s:
        return "wall_timeout"
    if at - state["heard"] > limits.idle_s:
        return "idle_timeout"
    if kind in ("error", "done"):
        return kind
    if kind == "data":
        state["heard"] = at
        state["text"] += delta or ""
        state["reason"] = reason or state["reason"]
        if len(state["text"]) >= limits.chars:
            return "cap"
    return None


def assemble_stream(events: DataFrame, limits: Limits = Limits(), late: str = "10 seconds") -> DataFrame:
    """The streaming form: a row when a request ends, or when the watermark passes its idle timer. Timers go by event time, so a replay gives the same rows."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        row = dict(zip(("begin", "heard", "text", "reason", "over"), state.get)) if state.exists else {"begin": None, "heard": None, "text": "", "reason": None, "over": False}
        end = None
        if state.hasTimedOut:
            end = None if row["over"] else ("ok" if row["reason"] else "idle_timeout" if row["text"] else "incomplete")
            state.remove()
        else:
            for b in batches:
                for e in b.sort_values("seq").itertuples():
                    if row["over"] or end:
                        continue
                    text = lambda v: None if v is None or v != v else v
                    end = _step(row, e.seq, e.ts.timestamp(), e.kind, text(e.delta), text(e.finish_reason), limits)
            row["over"] |= end is not None
            state.update((row["begin"], row["heard"], "" if row["over"] else row["text"], None if row["over"] else row["reason"], row["over"]))
            state.setTimeoutTimestamp(max(int((row["heard"] + limits.idle_s) * 1000), state.getCurrentWatermarkMs() + 1))
        if end:
            status = end if end.endswith("timeout") or end in ("error", "incomplete") else "ok"
            good = status == "ok"
            yield pd.DataFrame({"request_id": [key[0]], "text": [row["text"] if good else None], "finish_reason": ["length" if end == "cap" else row["reason"] if good else None], "status": [status]})

    return events.withWatermark("ts", late).groupBy("request_id").applyInPandasWithState(run, OUT, "begin double, heard double, text string, reason string, over boolean", "append", "EventTimeTimeout")


def idle_sessions(events: DataFrame, key: str, ts: str, gap_s: int = 120) -> DataFrame:
    """key, session, started, ended, n: runs of events with no gap above gap_s."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) > gap_s * 1_000_000).cast("int"), F.lit(1))
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def idle_sessions_stream(events: DataFrame, key: str, ts: str, gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """The streaming form: session windows behind a watermark."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("ended")).select(key, F.col("session_window.start").alias("started"), "ended", "n")
