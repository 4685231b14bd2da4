"""Orders over ranges, stored indexes, tables in buckets, quarantined lines, label scores."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import json_repair, similarity
from foliant.functions import text as T
from foliant.operators import blocks, cluster, growing, order, outline, records, scores
from foliant.operators.shared import cut, scratch
from foliant.sources import buckets, readers


@pytest.fixture
def ranges(spark):
    """Nine ranges, none of them put together with others."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


# ---- orders ------------------------------------------------------------------------------------------------------------------------------------------


def _skewed(n=2000):
    rng = random.Random(1)
    rows = {}
    for i in range(n):
        s = rng.choice([0, 0, 0, 0, 0, 1, 2, None, 3])
        rows[s, i if s == 0 else rng.randrange(100000)] = (rng.choice([None, rng.randrange(1000)]), rng.randrange(9))
    return [(s, o, v, p) for (s, o), (v, p) in rows.items()]


def test_numbers_over_a_skewed_order(spark, ranges):
    rows = _skewed()
    df = spark.createDataFrame(rows, "s int, o bigint, v bigint, part int").repartition(5)
    got = order.numbered(df, "s", "o").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1]))
    assert [(r["s"], r["o"], r["v"], r["part"]) for r in sorted(got, key=lambda r: r["n"])] == want and [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(len(rows)))
    assert order.numbered(df.limit(0), "s").count() == 0


def test_running_values_of_segments_that_span_ranges(spark, ranges):
    rows = _skewed()
    df = spark.createDataFrame(rows, "s int, o bigint, v bigint, part int").repartition(5)
    laid = order.lay(df, "s", "o")
    done = order.running(laid, ["s"], {"n": ("sum", F.lit(1)), "m": ("max", F.col("v")), "x": ("xor", F.col("v")), "l": ("last", F.col("v")), "b": ("last", F.col("o"))}, before=("b",))
    assert done.rows.select(done.part).distinct().count() == 9
    state, bad = {}, 0
    got = {(r["s"], r["o"]): r for r in done.rows.collect()}
    for s, o, v, p in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        a = state.setdefault(s, [0, None, None, None, None])
        before, a[0] = a[4], a[0] + 1
        if v is not None:
            a[1], a[2], a[3] = max(v, a[1] or 0), v if a[2] is None else a[2] ^ v, v
        a[4] = o
        r = got[s, o]
        bad += (r["n"], r["m"], r["x"], r["l"], r["b"], r["part"]) != (a[0], a[1], a[2], a[3], before, p)
    assert not bad and len(got) == len(rows)


def test_one_document_over_many_ranges(spark, ranges):
    """Sections and marks of a document that is nearly all lines there are."""
    text = "\n".join("x" if i % 7 else f"Image: page_{i // 7}" for i in range(1, 700))
    docs = spark.createDataFrame([("a", text), ("b", "Image: page_1\ny\n"), ("c", "no head"), ("d", None)], "doc string, text string")
    lines = cut(outline.lines_of(docs).repartition(6))
    got = {(r["doc"], r["image"]): (r["ord"], r["body"]) for r in outline.sections(lines).collect()}
    assert len(got) == 100 and got["a", "page_40"] == (40, "\n".join("x" * 6)) and got["b", "page_1"] == (1, "y")
    mark = F.when(F.col("line").startswith("Image"), F.col("line"))
    current = {(r["doc"], r["line_no"]): r["current"] for r in outline.carry_forward(lines, mark).collect()}
    assert current["a", 0] is None and all(current["a", i - 1] == (f"Image: page_{i // 7}" if i >= 7 else None) for i in range(1, 700))


def test_numbers_that_no_int_holds(spark):
    """A mark of too many digits is read as null, and ends no query."""
    text = "\n".join(f"<!-- COLLECTION_{n}_START -->\n**T**\n<!-- CARDS_START -->\n1. front {len(n)}\n<!-- CARDS_END -->\n<!-- COLLECTION_{n}_END -->" for n in ("7", "12345678901", "9" * 40))
    got = outline.read_outline(spark.createDataFrame([("d", text)], "doc string, text string")).collect()
    assert sorted((r["front"], r["collection_no"]) for r in got if r["collection_no"] is not None) == [("front 1", 7)] and len(got) == 3


def test_rescue_numbers_rows_in_order(spark, ranges):
    rows = [(i * 37 % 101, f"f{i}", 5) for i in range(101)]
    got = records.rescue(spark.createDataFrame(rows, "c_pos int, front string, n int").repartition(7), 21, "X").collect()
    assert all(r["sort_key"] == "21_A_%02d" % (r["c_pos"] + 1) and r["n"] == 5 for r in got) and len(got) == 101


def test_first_of_keeps_a_column_of_its_own_name(spark):
    got = records.first_of(spark.createDataFrame([(1, 1, 5, 2), (1, 2, 6, 1)], "k int, n int, _n int, pos int"), "k").collect()
    assert [tuple(r) for r in got] == [(1, 2, 6, 1)]


def test_more_categories_than_letters(spark):
    structure = spark.createDataFrame([("collection_1_a", f"c{i:02d}") for i in range(60)], "collection string, category string")
    codes = records.category_codes(structure, outline.collection_order)
    got = {r["category"]: r["code"] for r in codes.collect()}
    assert got["c00"] == "1A" and got["c25"] == "1Z" and got["c26"] == "1A1" and got["c59"] == "1H2"
    said = spark.createDataFrame([(0, "1h2"), (1, "1B, please"), (2, "1A1")], "pos int, reply string")
    assert {r["pos"]: r["category"] for r in records.decode_categories(said, codes).collect()} == {0: "c59", 1: "c01", 2: "c26"}


def test_star_of_many_links(spark):
    edges = spark.range(1, 200_000).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j")).unionByName(spark.range(300_000, 300_002).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j")))
    got = cluster.components(edges).groupBy("component").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 200_000), (300_000, 3)]


def test_repair_is_linear():
    for n in (100_000, 800_000):
        text = "[" + ", ".join(["1"] * (n // 3)) + ", ]"
        began = time.time()
        assert json_repair.repair(text) == text[:-3] + " ]"
        assert time.time() - began < 2
    assert json_repair.repair('{"a": "\\x, ]", }') == '{"a": "\\\\x ]" }'


# ---- what grows --------------------------------------------------------------------------------------------------------------------------------------


def _texts(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([3, 8, 20]))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "z%d" % rng.randrange(50)
        out.append((i, rng.choice([" ".join(w), " ".join(w), "", None]) if i % 10 == 0 else " ".join(w)))
    return out


@pytest.mark.parametrize("t", [0.3, 0.6])
def test_index_gives_the_pairs_of_the_join(spark, t):
    rows = _texts(120, 3)
    docs = spark.createDataFrame(rows, "id bigint, text string")
    index, got = growing.TokenIndex(spark, scratch(spark), t, 8), []
    for k, part in enumerate(("id < 50", "id >= 50 and id < 80", "id >= 80")):
        pairs = index.extend(docs.filter(part), k).collect()
        if k == 1:  # a batch that runs again finds the same and adds nothing
            again = index.extend(docs.filter(part), k).collect()
            assert sorted(map(tuple, again)) == sorted(map(tuple, pairs))
        got += pairs
    want = cluster.similarity_join(docs, docs, t).filter("left_id < right_id").collect()
    assert sorted((min(r[0], r[1]), max(r[0], r[1]), r[2], r[3]) for r in got) == sorted(map(tuple, want)) and want


def test_index_moves_sets_and_not_meetings(spark, monkeypatch):
    """Sets that share common tokens by twos: what a batch shuffles grows with the sets, not with their pairs. Equal sets of two batches are stored once."""
    monkeypatch.setattr(blocks, "_LEAST", 2000)
    rng = random.Random(6)
    texts = [" ".join({f"w{rng.randrange(60)}" for _ in range(rng.choice((6, 12, 18)))}) for _ in range(1000)]
    rows = [(i, text) for i, text in enumerate(texts + texts[:200] + [text + " z" for text in texts[100:200]])]
    docs = spark.createDataFrame(rows, "id bigint, text string").repartition(4).cache()
    docs.count()
    index, got = growing.TokenIndex(spark, scratch(spark), 0.6, 4), []
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    for k, part in enumerate(("id < 600", "id >= 600")):
        got += map(tuple, index.extend(docs.filter(part), k).collect())
    assert written() - before < 40 * sum(len(text) for _, text in rows)
    sets = [(i, set(text.split())) for i, text in rows]
    assert sorted(got) == [(i, j, len(x & y), len(x | y)) for i, x in sets for j, y in sets[i + 1 :] if len(x & y) > 0.6 * len(x | y)] and got
    assert spark.read.parquet(f"{index.path}/keys").count() == len({frozenset(x) for _, x in sets})


def test_index_hashes_long_tokens_alone(spark, monkeypatch):
    """Texts are told apart once, as `text.token_set` does; only tokens of more than 11 letters are stored to be compared, and pairs are those of the sets."""
    monkeypatch.setattr(blocks, "_BYTES", 40)
    odd = ["", None, "...", "İ K\u212a ß", "ab-cd_EF 9z\nab", "abcdefghijk abcdefghijkl ABCDEFGHIJKL", "é" * 30 + "a" * 5000, "a" * 5000 + " b", "b a", "A! b?", "ab cd ef 9z 日本x", "x 日本 ab cd ef", "k i"]
    docs = spark.createDataFrame(list(enumerate(odd)), "id bigint, text string")
    want = {r["id"]: set(r["tokens"]) for r in docs.select("id", T.token_set("text").alias("tokens")).collect() if r["tokens"]}
    sets = {r["id"]: r for r in blocks.coded(docs, 0, "id", "text").collect()}
    assert {i: r["size"] for i, r in sets.items()} == {i: len(x) for i, x in want.items()} and all(list(r["codes"]) == sorted(set(r["codes"])) for r in sets.values())
    assert all((sets[i]["key"] == sets[j]["key"]) == (x == y) and len(set(sets[i]["codes"]) & set(sets[j]["codes"])) == len(x & y) for i, x in want.items() for j, y in want.items())
    index, got = growing.TokenIndex(spark, scratch(spark), 0.3, 4), []
    for k in range(2):
        got += map(tuple, index.extend(docs.filter(F.col("id") % 2 == k), k).collect())
    assert {r["token"] for r in spark.read.parquet(f"{index.path}/vocabulary").collect()} == {"abcdefghijkl", "a" * 5000}
    pairs = {(min(i, j), max(i, j), n, u) for i, j, n, u in got}
    assert pairs == {(i, j, len(x & y), len(x | y)) for i, x in want.items() for j, y in want.items() if i < j and len(x & y) > 0.3 * len(x | y)} and len(pairs) == len(got) > 3


def test_index_refuses_tokens_of_one_code(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_BITS", 4)
    index = growing.TokenIndex(spark, scratch(spark), 0.6, 4)
    index.extend(spark.createDataFrame([(0, "a b")], "id bigint, text string"), 0)
    with pytest.raises(ValueError, match="share a code"):
        index.extend(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(17)))], "id bigint, text string"), 1)


def test_components_grow(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(-5, 140), (7, 7)]
    grown, done = growing.Components(spark, scratch(spark), 4), []
    df = lambda rows: spark.createDataFrame(rows, "i bigint, j bigint")
    for k, part in enumerate((edges[:40], edges[40:70], [], edges[70:])):
        grown.extend(df(part), k)
        done += part
        want = {r["node"]: r["component"] for r in cluster.components(df(done)).collect()}
        got = {r["node"]: r["component"] for r in grown.read(k + 1).collect()}
        assert {n: c for n, c in got.items() if n in want} == want and all(n == c for n, c in got.items() if n not in want)
    before = sorted(map(tuple, grown.read(4).collect()))
    grown.extend(df(edges[70:]), 3)
    assert sorted(map(tuple, grown.read(4).collect())) == before


# ---- buckets -----------------------------------------------------------------------------------------------------------------------------------------


def test_merge_writes_the_buckets_that_it_touches(spark):
    at = scratch(spark)
    table = buckets.Buckets(spark, at, "k", 8)
    with pytest.raises(FileNotFoundError):
        table.read()
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    assert table.merge(rows) == list(range(8))
    first = table.manifest()
    open_reader = table.read()
    touched = table.merge(spark.createDataFrame([(3, 1), (3, 2), (500, 7), (None, 4)], "k bigint, v int"), spark.createDataFrame([(3,), (9,), (77,)], "k bigint"))
    now = table.manifest()
    assert 1 <= len(touched) < 8 and all((now["folders"][b] == p) == (int(b) not in touched) for b, p in first["folders"].items())
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {**{k: 0 for k in range(100) if k not in (9, 77)}, 3: 2, 500: 7, None: 4}
    assert open_reader.count() == 100 and table.read(1).count() == 100  # files of the version before are still there
    assert table.merge(spark.createDataFrame([], "k bigint, v int")) == [] and table.versions() == [1, 2]


def test_merge_that_fails_or_comes_second_is_not_seen(spark):
    table = buckets.Buckets(spark, scratch(spark), "k", 4)
    table.merge(spark.range(20).select(F.col("id").alias("k"), F.lit(0).alias("v")))
    with pytest.raises(Exception):  # noqa: B017
        table.merge(spark.range(5).select(F.col("id").alias("k"), F.raise_error(F.lit("lost")).cast("int").alias("v")))
    with pytest.raises(ValueError):
        table.merge(spark.range(5).toDF("k"))
    other = table.manifest()
    table.merge(spark.createDataFrame([(1, 5)], "k bigint, v int"))
    with pytest.raises(OSError):  # another writer that began with the same version
        table._commit({**other, "version": other["version"] + 1})
    assert table.versions() == [1, 2] and table.read().filter("v = 5").count() == 1
    table.vacuum()
    assert table.versions() == [2] and table.read().count() == 20


# ---- lines and labels --------------------------------------------------------------------------------------------------------------------------------


def test_bad_lines_are_told_by_file_and_line(spark):
    at = scratch(spark)
    os.makedirs(at.removeprefix("file:"))
    files = {"a.json": ['{"x": 1, "y": "é"}', "", '{"x": "no"}', "[1]", '{"x": 2, "z": 5}', '{"x"'] * 200, "b.json": ['{"y": null}', "7"]}
    for name, lines in files.items():
        with open(f"{at.removeprefix('file:')}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # several blocks a file
        good, bad = readers.split_records(spark, at, "x int, y string")
        good, bad = good.collect(), bad.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    why = {2: "a field of another type", 3: "no object", 5: "no JSON"}
    want = [("a.json", i + 1, why[i % 6]) for i in range(1200) if i % 6 in why] + [("b.json", 2, "no object")]
    assert sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["reason"]) for r in bad) == sorted(want)
    assert len(good) == 401 and sum(r["x"] or 0 for r in good) == 600 and all(files[r["file"].rsplit("/", 1)[-1]][r["line"] - 1] == r["value"] for r in bad)


def _near(text, label, value, window):
    """Whether the value is a number of what follows some occurrence of the label."""
    whole, at = similarity.flat(text), -1
    while label and (at := whole.lower().find(label.lower(), at + 1)) >= 0:
        if value in re.findall(r"-?\d+(?:[.,]\d+)?", whole[at + len(label) : at + len(label) + window]):
            return True
    return False


def test_label_hits_are_those_of_the_text_itself(spark):
    """The binned join against a search of each text, with labels that overlap themselves, numbers that the window cuts, and hot labels."""
    rng = random.Random(2)
    labels = ["aa", "U1", "Strom", "x.", "é", "(", "n-", ""]
    bits = ["aa", "aaa", "U1", "U12", "strom", "x.", "1.5.3", "-7", "12,5", " ", "\n", "ÉÉ", "é", "(", "n-", "n--3", "99999999", "b"]
    pages = [(p, m, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.choice([0, 5, 60])))) for p in range(30) for m in ("m1", "m2")] + [(90, "m1", None), (91, "m1", "aa 7 " * 500 + "aa 8")]
    truth = [(p, lab, v) for p in [*range(31), 90, 91, 92] for lab in labels for v in ("7", "-7", "5.3", "12", "12,5", "3", "999", "8")] + [(1, None, "7"), (1, "aa", "7")]
    got = scores.label_hits(spark.createDataFrame(truth, "page int, label string, value string"), spark.createDataFrame(pages, "page int, model string, text string"), window=6).collect()
    text = {(p, m): t for p, m, t in pages}
    rows = [(r["page"], r["model"], r["label"], r["value"], r["hit"]) for r in got]
    want = [_near(text.get((p, m)), lab, v, 6) for p, m, lab, v, _ in rows]
    assert [r[4] for r in rows] == want and sum(want) > 50 and len(rows) == len(set(rows))
    assert {r[1] for r in rows if r[0] == 92} == {None} and len({r[:4] for r in rows}) == (60 + 2 + 2) * 64 + 2
    one = {r["model"]: r for r in scores.page_scores(scores.label_hits(spark.createDataFrame([(91, "AA", "8"), (91, "aa", "9")], "page int, label string, value string"), spark.createDataFrame(pages, "page int, model string, text string")), ("page", "model")).collect()}
    assert (one["m1"]["hits"], one["m1"]["total"], one["m1"]["missed"]) == (1, 2, ["aa=9"])


def test_label_hits_read_a_page_once(spark):
    """A page and its labels are one row: no window runs over pieces of texts, of which there are many times the text."""
    df = scores.label_hits(spark.createDataFrame([(1, "a", "7")], "page int, label string, value string"), spark.createDataFrame([(1, "x a 7")], "page int, text string"))
    assert df.collect()[0]["hit"] and "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_deck_may_be_many_files(spark):
    """Cards of a deck's folder are rows in the order of its files, and only those with both sides."""
    at = scratch(spark)
    rows = [("a", 1, '[{"front": "q0", "back": "b"}, {"front": "q1"}, {"front": "q2", "back": "b", "due": 3}]'), ("a", 2, '[{"front": "q3", "back": "b", "tags": ["t"]}]'), ("c", 1, '[{"front": "q4", "back": "b"}]')]
    spark.createDataFrame(rows, "deck string, part int, value string").write.partitionBy("deck", "part").text(at)
    got = readers.read_import_cards(spark, at).orderBy("file", "pos").collect()
    assert [(r["folder"], r["pos"], r["front"], r["tags"], r["due"]) for r in got] == [("deck=a", 0, "q0", [], 0), ("deck=a", 2, "q2", [], 3), ("deck=a", 0, "q3", ["t"], 0), ("deck=c", 0, "q4", [], 0)]
    assert sum(r["n"] for r in readers.read_imports(spark, at).collect()) == 4
