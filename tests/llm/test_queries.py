"""The registered queries over whole test tables: against their SQL, and against plain versions where there is none."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

from foliant.llm import decontaminate, html_layout, quality, queries, toxicity

from . import brute

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def _rows(rows, columns):
    plain = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    said = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in said.description]
    want = [dict(zip(names, r)) for r in said.fetchall()]
    got = queries.QUERIES[name](spark, SF).collect()
    assert set(names) == set(got[0].asDict()) and _rows([r.asDict() for r in got], names) == _rows(want, names)


def test_op1(spark):
    got = queries.op1_mixing(spark, SF1).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(docs)
    sizes = {}
    for r in docs.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == len(brute.words(docs[r["doc_id"]]["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 4 for s, t in want.items())


def test_op3_votes_and_em_row_by_row(spark):
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, SF).collect()}
    docs = _table(spark, "documents")
    votes = [brute.votes(r["text"]) for r in docs]
    post = brute.weak_labels(votes)
    assert [got[r["doc_id"]]["weak_label"] for r in docs] == pytest.approx(post, abs=1e-6)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    marked = {r["doc_id"]: r["quality"] for r in _table(spark, "labels")}
    right = [got[d]["predicted"] == y for d, y in marked.items()]
    assert np.mean(right) > 0.85


def test_op4(spark):
    html = {r["page_id"]: r["html"] for r in _table(spark, "pages")}
    got = {r["page_id"]: r["text"] for r in queries.op4_html_text(spark, SF).collect()}
    assert got == {k: html_layout.render(html_layout.parse(v)) for k, v in html.items()}


def test_op6_scores_one_text_at_a_time(spark):
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in _table(spark, "documents")}
    assert set(got) == set(docs)
    learned = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    net = toxicity.Network(toxicity.Plan(), *learned)
    longest = sorted(docs, key=lambda d: -len(docs[d] or ""))
    for d in [*list(docs)[::5], *longest[:4]]:  # long texts of many windows, too
        assert got[d]["score"] == pytest.approx(brute.toxic(net, docs[d]), abs=1e-3)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())


def test_op9(spark):
    docs = [(r["doc_id"], r["text"]) for r in _table(spark, "documents")]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()]
    assert sorted(got) == sorted(brute.simhash(docs))


def test_op10(spark):
    docs, items = _table(spark, "documents"), _table(spark, "benchmark")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in queries.op10_decontaminate(spark, SF).collect()}
    want = set()
    folded = [(i["item_id"], decontaminate.fold(i["text"].encode())) for i in items if i["text"]]
    for r in docs:
        text = decontaminate.fold((r["text"] or "").encode())
        for i, item in folded:
            e = brute.edits_of(item, text)
            if len(text) and e <= len(item) // 10:
                want.add((r["doc_id"], i, e))
    assert got == want and want
