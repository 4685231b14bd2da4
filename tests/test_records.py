import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import audit, blocks, cluster, outline, records
from foliant.sources import readers, writers

CARD = "pos bigint, guid string, front string, back string, collection string, category string, sort_field string"


def cards(spark, rows):
    return spark.createDataFrame([(i, str(i), *r, None) for i, r in enumerate(rows)], CARD)


def test_integrate(spark):
    old = cards(spark, [("a", "x", "c_1_q", "a_x")])
    new = cards(spark, [("A", "1", "c_1_q", "a_x"), ("b", "1", "c_1_q", "a_x"), (" B ", "1", "c_1_q", "a_x"), ("", "1", "c_1_q", "a_x"), ("c", "1", "zzz", None), ("grÃ¼n", "1", "c_1_q", "a_x"), ("d", " ", "c_1_q", "a_x"), ("e", "1", "c_1_q", "a_x")])
    dim = spark.createDataFrame([("c_1_q", 1)], "key string, ord int")
    got = {r["front"]: (r["collection"], r["category"], r["sort_field"]) for r in records.integrate(old, new, dim, "collection_5_Neue_Karten").collect()}
    assert got == {"b": ("c_1_q", "a_x", "01_A_01_b"), "e": ("c_1_q", "a_x", "01_A_02_e"), "c": ("collection_5_Neue_Karten", "a_Unsortiert", "02_A_01_c")}
    on = records.integrate(old, new, dim, "x", go_on=True).filter("front = 'b'").first()
    assert on["sort_field"] == "01_A_02_b"


def test_next_number(spark):
    df = spark.createDataFrame([("collection_2_x",), ("Skript_ws_25",), ("single",), (None,)], "collection string")
    assert records.next_number(df).first()[0] == 3
    assert records.next_number(df.filter("collection = 'single'")).first()[0] == 0


def test_reconcile(spark):
    both = spark.createDataFrame([(0, "a", "B2"), (1, "A ", "B1"), (2, "b", "X"), (3, "m", "M")], "pos bigint, front string, back string")
    md = spark.createDataFrame([(0, "a", "k", "a_x", "01_A_01"), (1, "c", "k", "a_x", "01_A_02"), (2, "m", "k", "a_x", "01_A_03")], "pos bigint, front string, collection string, category string, sort_key string")
    got = {r["norm_front"]: (r["state"], r["outcome"], r["back"]) for r in records.reconcile(both, md).collect()}
    assert got == {"a": ("conflict", "kept", "B1"), "b": ("orphan", "rescued", "X"), "c": ("missing", "todo", "TODO"), "m": ("matched", "kept", "M")}
    said = spark.createDataFrame([("a", "B2")], "norm_front string, back string")
    strict = {r["norm_front"]: (r["outcome"], r["back"]) for r in records.reconcile(both, md, "drop", "ignore", "drop", said).collect()}
    assert strict["a"] == ("kept", "B2") and strict["b"][0] == "ignored" and strict["c"][0] == "dropped"
    with pytest.raises(ValueError):
        records.reconcile(both, md, conflict="?")
    assert records.rescue(records.reconcile(both, md).filter("outcome = 'rescued'"), 4, "Orphan").first()["sort_key"] == "04_A_01"


def test_update_and_delete(spark):
    c = cards(spark, [("a", "x", "c", "k"), ("b", "y", "c", "k")])
    news = spark.createDataFrame([("1", "z", None)], "guid string, back string, category string")
    assert {r["guid"]: (r["back"], r["category"]) for r in records.update_by(c, news).collect()} == {"0": ("x", "k"), "1": ("z", "k")}
    assert [r["guid"] for r in records.delete_by(c, news).collect()] == ["0"]
    nested = records.nest(c).select(F.map_from_entries(F.array(F.struct("collection", "categories"))).alias("generated_cards"))
    assert sorted(r["front"] for r in records.unnest(nested).collect()) == ["a", "b"]


def test_similarity_join_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefghijkl") + rng.choice("12") for _ in range(rng.randint(0, 12)))) for i in range(160)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    left, right = df.filter("id < 60"), df.filter("id >= 60")
    for t in (0.3, 0.6):
        got = {(r["left_id"], r["right_id"], r["inter"], r["uni"]) for r in cluster.similarity_join(left, right, t).collect()}
        want = set()
        for i, a in rows[:60]:
            for j, b in rows[60:]:
                x, y = set(a.split()), set(b.split())
                if x and y and len(x & y) > t * len(x | y):
                    want.add((i, j, len(x & y), len(x | y)))
        assert got == want


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_similarity_join_moves_sets_and_not_meetings(spark, monkeypatch):
    """Thousands of sets that share common tokens by twos: what is shuffled grows with the sets, not with their pairs. They lie in several blocks, and codes of few bits are told apart."""
    monkeypatch.setattr(blocks, "_LEAST", 2000)
    monkeypatch.setattr(blocks, "_BITS", 11)
    rng = random.Random(5)
    rows = [(i, " ".join({f"w{rng.randrange(60)}" for _ in range(rng.choice((6, 12, 18)))})) for i in range(2850)]
    rows += [(2850 + i, text + " z") for i, text in rows[:150]]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4).cache()
    df.count()
    left, right = df.filter("id < 1500"), df.filter("id >= 1500")
    before = _shuffled(spark)
    got = {tuple(r) for r in cluster.similarity_join(left, right, 0.6).collect()}
    assert _shuffled(spark) - before < 20 * sum(len(text) for _, text in rows)
    sets = [(i, set(text.split())) for i, text in rows]
    assert got == {(i, j, len(x & y), len(x | y)) for i, x in sets[:1500] for j, y in sets[1500:] if len(x & y) > 0.6 * len(x | y)} and got


def _block(sets: list[list[int]]) -> blocks._Block:
    uniq, items = np.unique(np.array([x for s in sets for x in s], np.int64), return_inverse=True)
    keys = b"".join(i.to_bytes(16, "big") for i in range(len(sets)))
    return blocks._Block(keys, np.array([len(s) for s in sets], np.int32).tobytes(), uniq.tobytes(), items.astype(np.int32).tobytes())


@pytest.mark.parametrize("limits", [{}, {"_CELLS": 500, "_AT_ONCE": 700}, {"_TABLE": 0}, {"_WORD": 0.0}])
def test_common_tokens_take_little_work_in_a_meeting(monkeypatch, limits):
    """Sets of tokens as common as those of a language: fewer tokens are met than there are pairs of sets, and what is found is what all pairs give."""
    for name, value in limits.items():
        monkeypatch.setattr(blocks, name, value)
    met, spread = [], blocks._spread
    monkeypatch.setattr(blocks, "_spread", lambda starts, counts: met.append(int(counts.sum())) or spread(starts, counts))
    rng = random.Random(7)
    sets = [sorted({int(1500 ** rng.random()) for _ in range(rng.choice((5, 60, 90, 120)))}) for _ in range(500)]
    sets += [sorted(set(s[3:]) | {2000 + i % 50}) for i, s in enumerate(sets[:100])]
    left, right = sets[:300], sets[300:]
    for a, b, same in ((left, right, False), (sets[:200], sets[:200], True)):
        met.clear()
        got = set()
        for batch in blocks._pairs(_block(a), _block(b), 0.5, same):
            got |= {(int.from_bytes(r["l"], "big"), int.from_bytes(r["r"], "big"), r["inter"], r["uni"]) for r in batch.to_pylist()}
        want = {(i, j, len(x & y), len(x | y)) for i, x in enumerate(map(set, a)) for j, y in enumerate(map(set, b)) if len(x & y) > 0.5 * len(x | y) and (not same or i <= j)}
        assert got == want and len(want) > 50
        assert "_TABLE" in limits or sum(met) < 2 * len(a) * len(b)


def test_tokens_of_one_code_are_seen(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_BITS", 4)
    vocab = spark.createDataFrame([(f"w{i}",) for i in range(17)], "token string")
    assert not blocks.one_code(vocab, 0) and blocks.one_code(vocab.limit(1).unionAll(vocab.limit(1)), 0)


def test_votes_and_clusters(spark):
    pairs = spark.createDataFrame([(p, 0, 1) for p in (1, 2, 3)] + [(p, 1, 2) for p in (1, 2, 3)] + [(1, 0, 2)] + [(p, 5, 6) for p in (1, 2)] + [(1, 8, 9)], "pass int, i int, j int")
    v = cluster.vote(pairs, 3)
    assert {(r["i"], r["j"]): r["confidence"] for r in v.collect()} == {(0, 1): "HIGH", (1, 2): "HIGH", (0, 2): "LOW", (5, 6): "MEDIUM", (8, 9): "LOW"}
    assert [(r["members"], r["confidence"]) for r in cluster.clusters(v).collect()] == [([5, 6], "MEDIUM")]
    every = {tuple(r["members"]): r["confidence"] for r in cluster.clusters(v, include_low=True).collect()}
    assert every == {(0, 1, 2): "LOW", (5, 6): "MEDIUM", (8, 9): "LOW"}
    assert {r["confidence"] for r in cluster.vote(pairs.filter("pass = 1"), 2).collect()} == {"LOW"}
    members = spark.createDataFrame([([3, 3, 99, 1],), ([3],)], "m array<int>").select(cluster.valid_members(F.col("m"), F.lit(5))).collect()
    assert [r[0] for r in members] == [[1, 3], None]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in cluster.components(spark.createDataFrame(edges, "i int, j int")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_resolution(spark):
    t = datetime.datetime(2024, 1, 1)
    people = spark.createDataFrame([(i, str(i), i, t if i < 2 else t + datetime.timedelta(days=i), f"b{i}") for i in range(4)], "node int, guid string, pos bigint, created_at timestamp, back string")
    found = spark.createDataFrame([(0, [0, 1, 2, 3], "MEDIUM")], "component int, members array<int>, confidence string")
    for action, kept in (("keep_oldest", "0"), ("keep_newest", "3"), ("merge", "0")):
        said = spark.createDataFrame([(0, action)], "component int, action string")
        acts = cluster.resolve(found, "hybrid", said)
        assert [r["guid"] for r in cluster.kept_and_gone(acts, people).filter("role = 'kept'").collect()] == [kept]
    acts = cluster.resolve(found, "hybrid", said).withColumns({"action": F.lit("keep_specific"), "target": F.lit(2)})
    assert [r["guid"] for r in cluster.kept_and_gone(acts, people).filter("role = 'kept'").collect()] == ["2"]
    assert cluster.resolve(found, "hybrid").first()["action"] == "skip"
    rows = people.withColumn("component", F.lit(0))
    assert cluster.merge_backs(rows).first()["back"] == "b0"
    assert cluster.merge_backs(rows, spark.createDataFrame([(0, "m")], "component int, merged string")).first()["back"] == "m"
    assert sorted(cluster.permutation(7, 3)) == list(range(7)) and cluster.permutation(0, 1) == []


def test_sections(spark):
    docs = spark.createDataFrame([("d", "junk\nImage: p1\na\n\nImage: p2\nb\nImage: p1\nc\n\n"), ("e", "none")], "doc string, text string")
    got = outline.sections(outline.lines_of(docs)).orderBy("ord").collect()
    assert [(r["doc"], r["image"], r["body"]) for r in got] == [("d", "p1", "c"), ("d", "p2", "b")]
    pages = spark.createDataFrame([("d", "page_10", "x "), ("d", "page_2", "y"), ("d", "cover", "")], "doc string, image string, body string")
    assert outline.write_sections(pages).first()["text"] == "Image: page_2\ny\n\nImage: page_10\nx\n\nImage: cover"


def test_outline(spark):
    c = cards(spark, [("q1", "1", "collection_2_b", "a_one"), ("q2", "1", "collection_10_a", "b_two"), ("q3", "1", "collection_2_b", "a_one"), ("q4", "1", "Z", "a_x")]).withColumn("sort_field", F.col("guid"))
    dim = spark.createDataFrame([("collection_2_b", "Two")], "key string, display_name string")
    text = outline.write_outline(c, dim, "# Head\n\n")
    got = outline.read_outline(text.withColumn("doc", F.lit("x"))).orderBy("collection_no", "number").collect()
    assert [(r["collection_no"], r["title"], r["category"], r["number"], r["front"]) for r in got] == [(0, "Two", "a_one", 1, "q1"), (0, "Two", "a_one", 2, "q3"), (1, "A", "b_two", 1, "q2"), (2, "", "a_x", 1, "q4")] or len(got) == 4
    assert audit.marker_parity(text).first()["parity"]


def test_outline_lines_are_those_of_the_text(spark):
    """Lines of an index in several ranges against a plain text: fronts of many lines, without one, of a category without a name, and no cards at all."""
    rows = [(i, f"f{i}\n<!-- CARDS_START -->\n\nend" if i % 7 == 0 else None if i % 11 == 0 else f"f{i}", f"collection_{i % 12}_x", [None, "a_one", "b_two"][i % 3] if i % 12 != 5 else None, None if i % 2 else f"{i % 5}") for i in range(200)]
    kind = "pos int, front string, collection string, category string, sort_field string"
    c, dim = spark.createDataFrame(rows, kind), spark.createDataFrame([("collection_2_x", "Two\nlines")], "key string, display_name string")

    def text(rows, header=""):
        blocks = []
        for n in range(12 if rows else 0):
            body = []
            for cat, head in (("a_one", "**A. One**"), ("b_two", "**B. Two**")):
                mine = sorted((r[4] or "", r[0], r[1]) for r in rows if r[2] == f"collection_{n}_x" and r[3] == cat)
                if mine:
                    body.append(f"{head}\n" + "\n".join(f"{k}. {r[2]}" for k, r in enumerate(mine, 1) if r[2] is not None) + "\n")
            name = "Two\nlines" if n == 2 else "X"
            blocks.append(f"<!-- COLLECTION_{n}_START -->\n# Sammlung {n}\n\n**{name}**\n\n<!-- CARDS_START -->\n***\n\n" + "\n".join(body) + f"\n<!-- CARDS_END -->\n<!-- COLLECTION_{n}_END -->\n\n---")
        return f"{header}<!-- ANKI_CARD_LIST_START -->\n\n" + "\n".join(blocks)

    lines = outline.outline_lines(c, dim, "# H\n").orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == list(range(len(lines))) and "\n".join(r["line"] for r in lines) == text(rows, "# H\n")
    assert outline.write_outline(c.limit(0), dim).first()["text"] == text([])
    said = outline.outline_lines(c.filter("pos % 7 <> 0"), dim).withColumn("doc", F.lit("d"))
    assert audit.marker_parity_of_lines(said).first()["parity"] and not audit.marker_parity_of_lines(said.filter("line not like '%_END -->'")).first()["parity"]
    assert outline.read_outline_lines(said).count() == sum(1 for r in rows if r[0] % 7 and r[1] and r[3])


@pytest.mark.parametrize("counts, median, threshold, low", [((50, 50, 1), 50, 7, [1]), ((5, 5), None, None, []), ((1, 2, 30, 40), 30, 4, [1, 2])])
def test_balance(spark, counts, median, threshold, low):
    df = spark.createDataFrame([(f"c{i}",) for i, n in enumerate(counts) for _ in range(n)], "collection string")
    got = audit.balance_warnings(df).orderBy("n").collect()
    assert [r["n"] for r in got] == low
    assert all((r["median"], r["threshold"]) == (median, threshold) for r in got)


def test_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"front": "f", "back": "b", "extra": 1}, {"front": "g", "tags": ["t"]}]')
    (tmp_path / "bad.json").write_text('[{"front": "f", ')
    got = readers.read_records(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["front"] for r in got][:2] == ["f", "g"] and got[1]["tags"] == ["t"]
    shapes = spark.createDataFrame([("a", '[{"front": "1"}]'), ("b", '{"new_cards": [{"front": "2"}]}'), ("c", '{"generated_cards": {"k": {"x": [{"front": "3"}]}}}'), ("d", "oops")], "file string, value string")
    assert sorted((r["file"], r["front"], r["collection"]) for r in readers.candidates(shapes).collect()) == [("a", "1", None), ("b", "2", None), ("c", "3", "k")]
    (tmp_path / "log.ndjson").write_text('{"model": "m", "errors": 1}\nbroken\n{"model": "n"}\n')
    assert sorted(r["model"] for r in readers.read_log(spark, str(tmp_path / "log.ndjson")).collect()) == ["m", "n"]
    table = str(tmp_path / "table")
    writers.replace_table(spark.range(3), table)
    backup = writers.replace_table(spark.range(5), table, keep_backup=True)
    assert spark.read.parquet(table).count() == 5
    writers.restore(spark, table, backup)
    assert spark.read.parquet(table).count() == 3
    calls = []
    for start in (1, 2):
        stages = writers.Stages(spark, str(tmp_path / "run"), start)
        for name in ("one", "two"):
            stages.run(name, lambda name=name: calls.append(name) or spark.range(2))
    assert calls == ["one", "two", "two"]
    c = cards(spark, [("a", "x", "k", "a_x"), ("b", "y", None, "a_x")]).withColumn("tags", F.array().cast("array<string>"))
    dim = spark.createDataFrame([("k", "K.json", "Kay")], "key string, filename string, display_name string")
    writers.write_collections(c, dim, str(tmp_path / "out"))
    assert sorted(r["filename"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["K.json", "collection_0_unsorted.json"]
    assert {r["deck"] for r in writers.deck_rows(c, dim).collect()} == {"Kay", "Unsorted"}
    assert '"k"' in writers.template(c.filter("collection = 'k'")).first()["json"]
