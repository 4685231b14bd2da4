"""Calls from executors that may die, replies with state and timers, histories without what failed."""

import json
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from foliant.operators import client, runs
from foliant.operators.shared import scratch
from foliant.streaming import replies, stateful


def _asked(folder):
    """What the provider was asked, a line a finished call."""
    out = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            out += [json.loads(line) for line in f]
    return out


def _provider(folder, dies_at=None):
    def call(request, attempt):
        mine = int(request["request_id"][1:])
        if dies_at == mine and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)  # the worker is gone, as with a lost executor
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(json.dumps([request["request_id"], attempt]) + "\n")
        if mine % 5 == 1 and attempt == 1:
            return 503, None
        if mine % 5 == 2:
            raise ConnectionError("cut")
        return (404, None) if mine % 5 == 3 else (200, f"{request['prompt']}!")

    return call


def test_calls_survive_a_lost_worker(spark):
    """A worker dies in the middle and the run with it; the next run asks what has no answer, and nothing twice."""
    folder, path = tempfile.mkdtemp(), scratch(spark)
    requests = spark.createDataFrame([(f"r{i}", f"p{i}") for i in range(60)] + [("r4", "p4"), (None, "x")], "request_id string, prompt string")
    make = lambda: client.Client(spark, path, _provider(folder, 37), threads=1, per_task=12, delays=(0.0, 0.0))
    with pytest.raises(Exception):  # noqa: B017
        make().ask(requests)
    before = {r for r, _ in _asked(folder)}
    assert 0 < len(before) < 60
    got = make().ask(requests).collect()
    assert len(got) == 62
    asked = _asked(folder)
    tries = {}
    for r, n in asked:
        tries.setdefault(r, []).append(n)
    for r in got:
        if r["request_id"] is None:
            assert r["content"] is None and r["tries"] is None
            continue
        i = int(r["request_id"][1:])
        want = {1: 2, 2: 3}.get(i % 5, 1)
        assert r["tries"] == want and sorted(tries[r["request_id"]]) == list(range(1, want + 1)), (r, tries[r["request_id"]])
        assert (r["content"], r["error"]) == ((None, "ConnectionError: cut") if i % 5 == 2 else (None, "status 404") if i % 5 == 3 else (f"p{i}!", None))
    n = len(_asked(folder))
    assert make().ask(requests).count() == 62 and len(_asked(folder)) == n
    again = make().ask(requests, again=True).filter("error is not null").count()
    assert again == 24 and len(_asked(folder)) == n + 12 * 3 + 12


def test_a_task_has_one_journal(spark):
    """Answers are lines of their task's files, not a file each, and a line that a worker died over is asked again."""
    path, folder = scratch(spark), tempfile.mkdtemp()

    def call(request, attempt):
        files = sum(len(names) for _, _, names in os.walk(f"{path.removeprefix('file:')}/journal"))
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(files))
        return 200, "x"

    asked = client.Client(spark, path, call, threads=4, per_task=100, delays=())
    assert asked.ask(spark.range(400).select(F.col("id").cast("string").alias("request_id"))).filter("content = 'x'").count() == 400
    seen = []
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            seen.append(int(f.read()))
    assert len(seen) == 400 and 0 < max(seen) <= 40 and os.listdir(f"{path.removeprefix('file:')}/journal") == []

    files, at = client._open(tempfile.mkdtemp())
    lines = client._Journal(files, at)
    for i in range(3):
        lines.add({"request_id": str(i), "content": "a\nb"})
    with open(f"{at}/torn.json", "w") as f:
        f.write('{"request_id": "7", "content": "ok"}\n{"request_id": "8", "cont')
    assert sorted(client._kept(files, at)) == ["0", "1", "2", "7"]


def test_waits_are_spread_and_agree():
    waits = []
    got = client.answer(lambda r, n: (429, None), {"request_id": "a"}, (429,), (2.0, 8.0), 0.25, waits.append)
    assert got["tries"] == 3 and got["error"] == "status 429" and got["waited"] == pytest.approx(sum(waits))
    assert 1.5 <= waits[0] <= 2.5 and 6 <= waits[1] <= 10 and waits == [client.spread("a", 1, 2.0, 0.25), client.spread("a", 2, 8.0, 0.25)]


def _event(request, seq, second, kind="data", delta=None, reason=None):
    return (request, seq, second, kind, delta, reason)


EVENTS = [
    *(_event("good", i, i, "data", f"t{i}") for i in range(5)), _event("good", 5, 5, "data", "", "stop"), _event("good", 6, 6, "done"), _event("good", 7, 8, "comment"), _event("good", 8, 9, "eof"),
    _event("slow", 0, 0, "data", "x"), _event("slow", 1, 1, "done"), _event("slow", 2, 9, "eof"),
    _event("silent", 0, 0, "data", "x"), *(_event("silent", i, 30 * i, "comment") for i in range(1, 8)),
    _event("long", 0, 0, "data", "a"), *(_event("long", i, 100 * i, "data", "b") for i in range(1, 25)),
    _event("bad", 0, 0, "data", "a"), _event("bad", 1, 1, "error"), _event("cut", 0, 0, "data", "part"), _event("cut", 1, 2, "eof"),
    _event("large", 0, 0, "data", "y" * 60), _event("large", 1, 1, "data", "y" * 60), _event("large", 2, 2, "data", "z"), _event("said", 0, 0, "data", "q", "stop"), _event("said", 1, 1, "eof"),
    _event("end", 0, 90000, "comment"),
]


def test_replies_with_timers_and_a_restart(spark):
    """A replay in files of a few seconds each, with a restart from the checkpoint in between."""
    root = tempfile.mkdtemp()
    source, out, mark = (f"{root}/{x}" for x in ("in", "out", "mark"))
    os.makedirs(source)
    kind = "request_id string, seq bigint, ts timestamp, kind string, delta string, finish_reason string"
    limits = replies.Limits(idle_s=120, wall_s=1800, chars=100)

    def go():
        events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(source)
        stateful.replies(events, limits, drain_s=5).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(300)

    steps = ((0, 3), (3, 40), (40, 1000), (1000, 10**9))
    for k, (a, b) in enumerate(steps):
        rows = [r for r in EVENTS if a <= r[2] < b]
        with open(f"{source}/{k}.json", "w") as f:
            for r, seq, second, what, delta, reason in rows:
                f.write(json.dumps({"request_id": r, "seq": seq, "ts": f"2024-01-01T{0:02d}:00:00Z" if second == 0 else (f"2024-01-0{1 + second // 86400}T{second % 86400 // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}Z"), "kind": what, "delta": delta, "finish_reason": reason}) + "\n")
        os.utime(f"{source}/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        if k in (1, 3):
            go()
    got = {r["request_id"]: tuple(r)[1:] for r in spark.read.parquet(out).collect()}
    assert got == {
        "good": ("t0t1t2t3t4", "stop", "ok", "kept"), "slow": ("x", None, "ok", "dropped"), "silent": (None, None, "idle_timeout", "dropped"), "long": (None, None, "wall_timeout", "dropped"),
        "bad": (None, None, "error", "dropped"), "cut": (None, None, "incomplete", "kept"), "large": ("y" * 120, "length", "ok", "dropped"), "said": ("q", "stop", "ok", "kept"),
    }
    batch = spark.createDataFrame([(r, s, t, "comment" if k == "eof" else k, d, f) for r, s, t, k, d, f in EVENTS if r != "end"], "request_id string, seq bigint, s bigint, kind string, delta string, finish_reason string")
    same = {r["request_id"]: (r["text"], r["finish_reason"], r["status"]) for r in replies.assemble(batch.withColumn("ts", F.timestamp_seconds("s")), limits).collect()}
    assert {k: v[:3] for k, v in got.items()} == same


def test_failed_turns_leave_the_history(spark):
    rows = [(1, 0, "user", "a", True), (1, 1, "user", "b", False), (1, 2, "assistant", "c", None), (1, 3, "user", "d", True), (1, 4, "user", "e", False)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, failed boolean")
    got = [[p["text"] for p in r["prior"]] for r in runs.history(turns, failed=F.col("failed")).orderBy("turn").collect()]
    assert got == [[], [], ["b"], ["b", "c"], ["b", "c"]]
