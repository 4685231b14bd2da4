import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import runs
from foliant.operators.provider import Replay, Stub, request_id
from foliant.streaming import ingest, replies


def test_resume_table(spark):
    cases = [  # image, stored status, attempts, candidates, body, paused run -> status, attempts
        ("a", "done", 3, [], "ok", False, "done", 3),
        ("b", "done", 3, [], "[ERROR: x]", False, "pending", 0),
        ("c", "judge_pending", 2, ["x"], "ok", False, "judge_pending", 2),
        ("d", "judge_pending", 2, [], "ok", False, "pending", 0),
        ("e", "pending", 5, [], None, False, "pending", 5),
        ("f", "judge_pending", 2, ["x"], "ok", True, "pending", 0),
        ("g", "done", 1, [], "ok", True, "done", 1),
        ("h", None, None, None, None, False, "pending", 0),
    ]
    images = spark.createDataFrame([(c[0], "i") for c in cases], "doc string, image string")
    state = spark.createDataFrame([(c[0], "i", *c[1:4]) for c in cases if c[1]], "doc string, image string, status string, attempts_used int, candidates array<string>")
    output = spark.createDataFrame([(c[0], "i", c[4]) for c in cases if c[4]], "doc string, image string, body string")
    paused = spark.createDataFrame([(c[0],) for c in cases if c[5]], "doc string")
    got = {r["doc"]: (r["status"], r["attempts_used"]) for r in runs.resume_pages(images, state, output, paused).collect()}
    assert got == {c[0]: (c[6], c[7]) for c in cases}


def test_budget(spark):
    df = spark.createDataFrame([(0, "failed"), (39, "failed"), (5, "success"), (5, "judge_pending"), (20, "failed")], "attempts_used int, outcome string")
    assert [(r["status"], r["backoff"]) for r in runs.next_state(df).collect()] == [("pending", 0.5), ("paused", 0.0), ("done", 0.0), ("judge_pending", 0.0), ("pending", 5.0)]
    pages = spark.createDataFrame([("a", "done"), ("a", "judge_pending"), ("b", "done"), ("c", "paused")], "doc string, status string")
    assert {r["doc"]: r["run_status"] for r in runs.run_status(pages).collect()} == {"a": "completed_with_judge_pending", "b": "completed", "c": "paused"}


def test_merge_states_is_idempotent(spark):
    state = spark.createDataFrame([("d", "i", "pending", 0, None), ("d", "j", "done", 1, "x")], "doc string, image string, status string, attempts_used int, text string")
    cycles = spark.createDataFrame([("d", "i", "success", "t", 1)], "doc string, image string, outcome string, text string, attempt int")
    once = ingest.merge_states(state, cycles)
    twice = ingest.merge_states(once, cycles)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("d", "i", "done", 1, "t"), ("d", "j", "done", 1, "x")]


@pytest.mark.parametrize(
    "log, want",
    [
        ([(4, 0, False)] * 3, 5),
        ([(4, 0, False)] * 2, 4),
        ([(4, 0, False), (4, 1, False)], 3),
        ([(4, 0, False), (5, 0, True)], 2),
        ([(1, 0, True)], 1),
        ([(16, 0, False)] * 3, 16),
        ([(4, 1, False), (4, 0, False), (4, 0, False)], 4),
    ],
)
def test_concurrency(spark, log, want):
    df = spark.createDataFrame([("m", i, *r) for i, r in enumerate(log)], "model string, pos bigint, concurrency int, errors int, paused boolean")
    models = spark.createDataFrame([("m",), ("new",)], "model string")
    assert {r["model"]: r["concurrency"] for r in runs.with_seed(models, runs.recommend(df)).collect()} == {"m": want, "new": 4}


def test_wilson(spark):
    low, high = runs.wilson(F.lit(23), F.lit(24))
    assert [round(x, 2) for x in spark.range(1).select(low, high).first()] == [0.80, 0.99]
    low, high = runs.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_usage(spark):
    kind = "response struct<model: string, usage: struct<prompt_tokens: bigint, completion_tokens: bigint, cost: double, prompt_tokens_details: struct<cached_tokens: bigint>>, error: string>"
    df = spark.createDataFrame([((None, None, "bad"),), (("m", (5, 6, 0.5, (2,)), None),)], kind)
    got = [r[0] for r in df.select(runs.usage()).collect()]
    assert (got[0]["model"], got[0]["cost"], got[0]["error"]) == ("unknown", 0.0, "bad") and got[1]["cached_tokens"] == 2


def test_provider(spark):
    asked = spark.createDataFrame([("p1",), ("p2",)], "prompt string").withColumn("request_id", request_id("prompt"))
    known = asked.filter("prompt = 'p1'").select("request_id", F.lit("yes").alias("content"), F.lit("stop").alias("finish_reason"), F.lit(None).cast("string").alias("error"))
    assert {r["prompt"]: (r["content"], r["error"]) for r in Replay(known).answer(asked).collect()} == {"p1": ("yes", None), "p2": (None, "not recorded")}
    assert {r["content"] for r in Stub(str.upper).answer(asked).collect()} == {"P1", "P2"}


T0 = datetime.datetime(2024, 1, 1)
STREAM = "request_id string, seq bigint, ts timestamp, kind string, delta string, finish_reason string"
CASES = {
    "terminal": ([(0, "data", "x", None), (1, "done", None, None), (2, "data", "y", None)], ("x", None, "ok")),
    "cut": ([(0, "data", "x", None)], (None, None, "incomplete")),
    "idle": ([(0, "data", "x", None), *((t, "comment", None, None) for t in range(30, 121, 30)), (121, "data", "y", "stop")], (None, None, "idle_timeout")),
    "cap": ([(0, "data", "x" * 60, None), (1, "data", "y" * 60, None), (2, "data", "z", None)], ("x" * 60 + "y" * 60, "length", "ok")),
    "error": ([(0, "data", "x", None), (1, "error", None, None), (2, "done", None, None)], (None, None, "error")),
    "plain": ([(0, "data", "a", None), (1, "comment", None, None), (2, "data", "b", "stop")], ("ab", "stop", "ok")),
}


def _events(spark):
    rows = [(name, i, T0 + datetime.timedelta(seconds=t), kind, delta, reason) for name, (events, _) in CASES.items() for i, (t, kind, delta, reason) in enumerate(events)]
    return spark.createDataFrame(rows, STREAM)


def test_assembly(spark):
    got = {r["request_id"]: (r["text"], r["finish_reason"], r["status"]) for r in replies.assemble(_events(spark), replies.Limits(chars=100)).collect()}
    assert got == {k: v for k, (_, v) in CASES.items()}


def test_streams(spark, tmp_path):
    _events(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(STREAM).parquet(str(tmp_path / "in"))
    q = replies.assemble_stream(source, replies.Limits(chars=100)).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["request_id"]: (r["text"], r["finish_reason"], r["status"]) for r in spark.table("assembled").collect()}
    # what has no end in the data ends with its timer, if the watermark gets there
    got.pop("cut", None), got.pop("plain", None)
    assert got == {k: v for k, (_, v) in CASES.items() if k not in ("cut", "plain")}

    dim = spark.createDataFrame([("k", 1)], "key string, ord int")
    kind = "pos bigint, front string, back string, collection string, category string"
    out = str(tmp_path / "deck")
    for week, rows in enumerate([[(0, "a", "1", "k", "a_x"), (1, "b", "1", "k", "a_x")], [(0, "A ", "1", "k", "a_x"), (1, "c", "1", "k", "a_x")]]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "weeks"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "weeks"))
        ingest.upsert_stream(stream, out, str(tmp_path / "c2"), dim, "collection_9_new").awaitTermination(90)
    found = {r["front"]: r["sort_field"] for r in spark.read.parquet(out).collect()}
    assert found == {"a": "01_A_01_a", "b": "01_A_02_b", "c": "01_A_03_c"}


def test_balanced_pairs_break_all_ties(spark):
    """Equal margins of one good model, on two rows of it, go to the smaller bad one; rows without hits are in no pair, nor do they hide others."""
    rows = [(1, 4, True, 20, 9), (1, 4, True, 15, 5), (1, 7, False, 5, 20), (1, 2, False, 10, 12), (1, 1, False, None, 30)]
    rows += [(2, 4, True, 20, 10), (2, 4, True, 15, 30), (2, 2, False, 0, 20), (2, 7, False, 5, 5), (2, 1, False, None, 1)]
    c = spark.createDataFrame(rows, "page int, model int, good boolean, hits int, length int")
    pairs = [(p, g[0], b[0], g[1] - b[1], "good_longer" if g[2] > b[2] else "good_shorter") for p in (1, 2) for g in [r[1:2] + r[3:] for r in rows if r[0] == p and r[2]] for b in [r[1:2] + r[3:] for r in rows if r[0] == p and not r[2] and r[3] is not None] if g[2] != b[2] and g[1] > b[1]]
    want = {}
    for p, g, b, m, o in sorted(pairs, key=lambda x: (-x[3], x[1], x[2])):
        want.setdefault((p, o), (g, b, m))
    got = {(r["page"], r["orient"]): (r["good"], r["bad"], r["margin"]) for r in runs.balanced_pairs(c).collect()}
    assert got == want and len(want) == 3
    # the longer of two equal good rows meets another partner than the shorter one, with the same margin
    tied = [(3, 1, True, 15, 10), (3, 1, True, 12, 50), (3, 8, False, 10, 5), (3, 3, False, 7, 40)]
    t = spark.createDataFrame(tied + [(r[0] + 1, *r[1:]) for r in reversed(tied)], "page int, model int, good boolean, hits int, length int")
    assert sorted((r["page"], r["bad"]) for r in runs.balanced_pairs(t).filter("orient = 'good_longer'").collect()) == [(3, 3), (4, 3)]


def test_medians_are_exact_over_ranges(spark):
    """Medians of groups that lie in several ranges, of even and odd numbers of values, a null group and values of null; no plan gathers a group's values."""
    rows = [(g, None if i % 9 == 0 else float((i * 7919) % 501) / 4) for g, n in (("a", 4001), ("b", 778), (None, 6), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "j string, cost double").repartition(5)
    want = {r["j"]: r["m"] for r in df.groupBy("j").agg(F.percentile("cost", F.lit(0.5)).alias("m")).collect()}
    got = {r["g"]: r["median"] for r in runs.medians(df, "cost", "j").collect()}
    assert got == {k: v for k, v in want.items() if v is not None} and want["c"] is None and len(got) == 3
    told = runs.model_stats(df.withColumn("ok", F.lit(True)), "j", "cost")
    assert {r["j"]: r["median"] for r in told.collect()} == want
    cost = {r["judge"]: r["cost"] for r in runs.cost_model(df, df.withColumnRenamed("j", "judge")).collect()}
    two = 2 * df.agg(F.percentile("cost", F.lit(0.5))).first()[0]
    assert cost == {k: None if v is None else two + v for k, v in want.items()}
