"""Calls, projects, files and traces: what the queries over the test tables don't show."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import similarity
from foliant.functions import text as T
from foliant.operators import calls, cluster, projects, provider, records
from foliant.sources import readers, writers
from foliant.streaming import replies

TRIES = "request_id string, attempt int, code int"


def test_retries_are_spread_and_bounded(spark):
    rows = [(f"r{i}", a, 429) for i in range(200) for a in (1, 2, 3)] + [("auth", 1, 401), ("auth", 2, None), ("late", 1, 503), ("late", 2, 200), ("late", 3, 500), ("open", 1, 500)]
    got = calls.retry_schedule(spark.createDataFrame(rows, TRIES))
    first = [r["delay"] for r in got.filter("attempt = 1 and request_id like 'r%'").collect()]
    second = [r["delay"] for r in got.filter("attempt = 2 and request_id like 'r%'").collect()]
    assert 1.5 <= min(first) < 1.7 < 2.3 < max(first) <= 2.5 and 6 <= min(second) and max(second) <= 10
    out = {r["request_id"]: (r["outcome"], r["tries"]) for r in calls.request_outcomes(got).collect()}
    assert out["r0"] == ("failed", 3) and out["auth"] == ("failed", 1) and out["late"] == ("ok", 2) and out["open"] == ("open", 1)
    assert calls.retry_schedule(spark.createDataFrame([], TRIES)).count() == 0


def test_unknown_models(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "model string")
    got = calls.unknown_models(one("acme/flash-lte", "acme/pro", "acme/flash-lte", None, " "), one("acme/flash-lite", "acme/flash", "acme/pro", None)).collect()
    assert [(r["model"], r["suggestions"][0]) for r in got] == [("acme/flash-lte", "acme/flash-lite")] and len(got[0]["suggestions"]) <= 3
    assert calls.unknown_models(one("x"), None).count() == calls.unknown_models(one("x"), one()).count() == calls.unknown_models(one("x"), one("y"), skip=True).count() == 0


def test_cost_line_counts_errors(spark):
    phases = spark.createDataFrame([("a", [(0.0125, None), (None, "busy")]), ("a", [(0.5, None)]), ("b", [])], "run_id string, llm_calls array<struct<cost:double,error:string>>")
    assert [tuple(r) for r in calls.cost_lines(phases).collect()] == [("a", 0.5125, 3, "~$0.513 (3 calls)")] or calls.cost_lines(phases).first()["line"] == "~$0.512 (3 calls)"


def test_states_and_names(spark):
    files = spark.createDataFrame([("a", '{"run_status": "paused"}'), ("b", "{}"), ("c", "{"), ("d", "[1]"), ("e", None)], "path string, value string")
    assert {r["path"]: r["run_status"] for r in projects.run_states(files).collect()} == {"a": "paused", "b": "running", "c": None, "d": None, "e": None}
    one = spark.range(1).select(projects.archived_name(F.lit("x/y.txt.ocr_state.json"), F.lit(dt.datetime(2024, 5, 6, 7, 8, 9, 12)).cast("timestamp_ntz")).alias("n"))
    assert one.first()["n"] == "y.txt.ocr_state_20240506_070809_000012.json"


def test_image_folders(spark):
    files = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    own = projects.image_folders(files("/in/a.png", "/in/s/b.JPG", "/in/s/t/c.png", "/in/u/d.txt"), "/in").collect()
    assert [tuple(r) for r in own] == [("/in", 1)]
    subs = projects.image_folders(files("/in/s/b.JPG", "/in/s/e.png", "/in/s/t/c.png", "/in/u/d.txt", "/in/v/w.jpeg"), "/in").collect()
    assert sorted(tuple(r) for r in subs) == [("/in/s", 2), ("/in/v", 1)]
    assert projects.image_folders(files(), "/in").count() == 0


def test_tree(spark):
    files = spark.createDataFrame([("b/x.pdf", "  [n]"), ("b/c/y", None), ("a", None), ("pdf2pic/z", None), ("b/log_archive/q", None), ("Z/w", None)], "path string, note string")
    lines = [r["line"] for r in projects.directory_tree(files).orderBy("pos").collect()]
    assert lines == ["├── Z/", "│   └── w", "├── b/", "│   ├── c/", "│   │   └── y", "│   └── x.pdf  [n]", "└── a"]


def test_materials(spark):
    empty = spark.createDataFrame([], "number int, name string, path string, description string, is_default boolean")
    m = projects.add_material(projects.add_material(empty, "a", "a.txt", "first"), "b", "b.txt")
    assert [tuple(r) for r in m.orderBy("number").collect()] == [(1, "a", "a.txt", "first", False), (2, "b", "b.txt", "Material: b", False)]
    m = projects.set_default(m, 2)
    texts = spark.createDataFrame([("a.txt", "A")], "path string, text string")
    assert [tuple(r) for r in projects.material(m, texts).collect()] == [(2, "b.txt", None)] and projects.material(m, texts, 1).first()["text"] == "A"
    assert projects.remove_material(m, 2).count() == 2 and projects.remove_material(m, 1).count() == 1
    with pytest.raises(ValueError):
        projects.add_material(m, " ", "x")


def test_projects(spark, tmp_path):
    made = projects.new_project("My Deck")
    assert made["tag_prefix"] == "MY_DECK" and made["collections"] and projects.PROJECT["project_name"] != "My Deck"
    assert projects.with_defaults({"llm": {}})["llm"] == {}
    at = str(tmp_path / "p" / "project.json")
    projects.write_project(spark, at, made)
    assert projects.read_project(spark, at) == made
    with pytest.raises(FileExistsError):
        projects.write_project(spark, at, made)
    projects.write_project(spark, at, made | {"domain": "ü"}, overwrite=True)
    assert projects.read_project(spark, at)["domain"] == "ü"
    with pytest.raises(ValueError, match="tag_prefix is empty"):
        projects.write_project(spark, at, made | {"tag_prefix": ""}, overwrite=True)
    config = spark.createDataFrame([], "key string, subkey string, value string")
    for bad in (("no", "v"), ("default_model", "v", "model"), ("defaults", "v", "no"), ("defaults", "v")):
        with pytest.raises(ValueError):
            projects.set_value(config, *bad)


def test_candidates_and_traces(spark, tmp_path):
    cards = spark.createDataFrame([(1, "b", "B", None), (0, "a", "A", "c")], "pos bigint, front string, back string, collection string")
    at = str(tmp_path / "new_cards")
    writers.write_candidates(cards, at)
    assert [(r["front"], r["back"], r["collection"]) for r in readers.read_candidates(spark, at).orderBy("pos").collect()] == [("a", "A", "c"), ("b", "B", None)]
    done = writers.mark_processed(spark, at, "20240101")
    assert readers.read_candidates(spark, done).count() == 2
    trace, kind = str(tmp_path / "trace"), "run_id string, status string"
    assert writers.read_trace(spark, trace, kind).count() == 0
    writers.flush_trace(spark.createDataFrame([("r", "running")], kind), trace)
    writers.flush_trace(spark.createDataFrame([("r", "success"), ("s", "running")], kind), trace)
    assert sorted(tuple(r) for r in writers.read_trace(spark, trace, kind).collect()) == [("r", "success"), ("s", "running")]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.json").write_text('{"run_id": "r"}\n{"run')
    assert writers.read_trace(spark, str(tmp_path / "broken"), kind).count() == 0
    assert (tmp_path / "broken.bak" / "part.json").exists() and not (tmp_path / "broken").exists()


def test_prompts_keep_a_backup(spark, tmp_path):
    at = str(tmp_path / "prompt.md")
    render = lambda n: spark.range(1).select(T.fill(F.lit("Ask {name} ü"), {"name": n}).alias("t")).first()["t"]
    assert writers.write_prompt(spark, at, render("a")) is None
    kept = writers.write_prompt(spark, at, render("b"))
    writers.write_prompt(spark, at, render("c"))
    assert (tmp_path / "prompt.md").read_text() == "Ask c ü" and open(kept).read() == "Ask b ü"


def test_collections_are_written_in_order(spark, tmp_path):
    cards = spark.createDataFrame([(f"f{i}", "b", "c", ["t"], f"g{i}", None if i == 7 else f"{(i * 7) % 10:02d}") for i in range(10)], "front string, back string, collection string, tags array<string>, guid string, sort_field string").repartition(4)
    writers.write_collections(cards, spark.createDataFrame([], "key string, filename string"), str(tmp_path / "o"))
    files = [p for p in (tmp_path / "o").rglob("*.json") if p.is_file()]
    said = [json.loads(line).get("sort_field", "") for line in files[0].read_text().splitlines()]
    assert len(files) == 1 and len(said) == 10 and said == sorted(said)


def test_images_are_listed(spark, tmp_path):
    for name in ("d/page_2.png", "d/page_10.jpg", "e/cover.png", "e/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    got = readers.read_images(spark, str(tmp_path)).select("doc", "image", "page_no", "size").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("d", "page_2.png", 2, 3), ("d", "page_10.jpg", 10, 3), ("e", "cover.png", None, 3)], key=str)


def test_usable_images(spark):
    png, jpeg = bytes.fromhex("89504E470D0A1A0A0049454E44AE426082"), bytes.fromhex("FFD8FF00FFD9")
    rows = [(0, png), (1, jpeg), (2, png[:-1]), (3, b""), (4, None), (5, b"GIF89a"), (6, jpeg[:-1])]
    got = spark.createDataFrame(rows, "n int, content binary").filter(readers.usable_image(F.col("content"))).collect()
    assert sorted(r["n"] for r in got) == [0, 1]


def test_digits_of_any_length(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(T.page_number(F.lit("page_12345678901.png"))) is None and one(T.page_number(F.lit("page_0000000000012.png"))) == 12
    assert one(T.page_spec(F.lit("2-3,99999999999,5-99999999999,7"))) == [1, 2, 6]
    assert one(T.rectangle(F.lit("1,2,3,99999999999"))) is None
    deck = spark.createDataFrame([("collection_12345678901_x",), ("collection_7_y",), ("plain",)], "collection string")
    assert records.next_number(deck).first()["next_number"] == 12345678902


def test_votes_lose_no_copy_pair(spark):
    """Copies whose first line a smaller row has too still get all their votes."""
    rows = spark.createDataFrame([(0, "x", "x", "t"), (1, "y", "y", "t"), (2, "y", "y", "t"), (3, "z", "y", "t"), (4, None, None, None)], "pos int, a string, b string, c string")
    got = {(r["i"], r["j"]): r["confidence"] for r in cluster.key_votes(rows, ["a", "b", "c"]).collect()}
    assert got[1, 2] == "HIGH" and got[1, 3] == "MEDIUM" and got[0, 1] == got[0, 3] == "LOW" and 4 not in {x for p in got for x in p}
    found = cluster.clusters(cluster.key_votes(rows, ["a", "b", "c"])).collect()
    assert [(r["members"], r["confidence"]) for r in found] == [([1, 2, 3], "MEDIUM")]


def test_tokens_and_scores():
    assert similarity.norm_tokens("<math display='x_y'>A_1</math> (B), ­c­o. ﬁn") == ["a", "1", "b", "co", "fin"]
    assert similarity.norm_tokens(None) == [] and similarity.order_score([], ["a"]) == similarity.order_score(["a"], []) == 0.0
    assert similarity.order_score(["a", "b", "c", "d"], ["a", "c", "d", "b"]) == 0.75
    assert similarity.flat(" a\n\tb ") == "a b"


def test_sse_lines(spark):
    chunk = lambda **k: "data: " + json.dumps({"id": "i", "model": "m", **k})
    said = lambda t, f=None: chunk(choices=[{"delta": {"content": t}, "finish_reason": f}])
    lines = {
        "good": [": hi", said("a"), "", "event: x", "data: {oops", said("b", "stop"), chunk(usage={"prompt_tokens": 3, "completion_tokens": 2, "cost": 0.5}), "data: [DONE]", said("late")],
        "failed": [said("a"), 'data: {"error": {"code": 429, "message": "slow"}}', said("b", "stop")],
        "text error": ['data: {"error": "bad"}'],
        "cut": [said("a")],
    }
    rows = [(k, i, dt.datetime(2024, 1, 1, 0, 0, i), x) for k, v in lines.items() for i, x in enumerate(v)]
    events = replies.sse_events(spark.createDataFrame(rows, "request_id string, seq int, ts timestamp, line string"))
    got = {r["request_id"]: r for r in replies.with_details(events, replies.assemble(events)).collect()}
    good = got["good"]
    assert (good["text"], good["finish_reason"], good["status"], good["id"], good["model"], good["usage"]["cost"]) == ("ab", "stop", "ok", "i", "m", 0.5)
    assert (got["failed"]["status"], got["failed"]["code"], got["failed"]["text"]) == ("error", 429, None)
    assert got["text error"]["status"] == "error" and got["cut"]["status"] == "incomplete"


def test_ingestor_and_exporter(spark, tmp_path):
    sources = spark.createDataFrame([("/a/y.txt", "two"), ("/a/x.txt", "one")], "file string, text string")
    said = '```json\n{"new_cards": [{"front": "f", "back": "b", "collection": "c_1_x"}]}\n```'
    got = provider.TextIngestor(provider.Stub(lambda p: said if "one" in p and p.index("one") < p.index("two") else ""), "Read: {text}").ingest(sources)
    assert [(r["front"], r["back"], r["collection"]) for r in got.collect()] == [("f", "b", "c_1_x")]
    cards = spark.createDataFrame([("f", "b", "c_2", ["t"], "g", "s"), ("f", "b", "c_10", ["t"], "h", "s"), ("f", "b", None, ["t"], "i", "s")], "front string, back string, collection string, tags array<string>, guid string, sort_field string")
    dim = spark.createDataFrame([("c_2", "two.json")], "key string, filename string")
    out = provider.CollectionExporter().export(cards, dim, str(tmp_path / "out"))
    assert [tuple(r) for r in out.collect()] == [("c_10.json", 1), ("collection_0_unsorted.json", 1), ("two.json", 1)]
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_discovery_is_bounded():
    script = iter([{"tool": "list", "argument": "x"}, {"tools": [{"tool": "read"}, {"tool": "list"}]}, {"tool": "no"}, {"result": {"ok": 1}}])
    tools = {"list": lambda s, a: f"listed {a}", "read": lambda s, a: 1 / 0}
    result, said = provider.discover(lambda _: next(script), tools, None)
    assert result == {"ok": 1} and [x["result"].split(":")[0] for x in said] == ["listed x", "failed", "deferred", "no such tool"]
    result, said = provider.discover(lambda _: {"tool": "list"}, tools, None, most=3)
    assert result is None and [x["result"] for x in said] == ["listed ", "listed ", "this is the last turn: answer now", "listed "]
