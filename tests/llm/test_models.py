import random

import numpy as np
import pytest

from foliant.llm import html_layout, quality, topk, toxicity


def test_gradients():
    net = toxicity.Network(toxicity.Plan(hidden=3, window=6), np.zeros(0, np.uint64))
    net.begin()
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, ids = rng.standard_normal((10, 18)), rng.integers(0, 9, (4, 6))
    x[-1] = 0
    mask = np.arange(6) < np.array([6, 4, 2, 6])[:, None]
    ids[~mask] = 9
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p = 1 / (1 + np.exp(-net.read(x, ids, mask)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g, dx = net.gradients(x, ids, mask, y, np.ones(4))
    for v, grad in [*((net.p[k], g[k]) for k in ("ahead", "back", "look", "ask", "out", "level")), (x[:-1], dx[:-1])]:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in v.shape)
            v[i] += 1e-3
            up = loss()
            v[i] -= 2e-3
            down = loss()
            v[i] += 1e-3
            assert abs(grad[i] - (up - down) / 2e-3) < 1e-3 * max(1, abs(grad[i])) + 1e-4


def test_windows_cover_whole_texts():
    bounds = np.cumsum([0, 0, 1, 32, 33, 48, 49, 1000])
    doc, at, size = toxicity.cut_windows(bounds, 32, 16)
    for d in range(len(bounds) - 1):
        seen = {w for a, s in zip(at[doc == d], size[doc == d]) for w in range(a, a + s)}
        assert seen == set(range(bounds[d], bounds[d + 1])) and (doc == d).any()


def _texts(n, seed):
    rng = random.Random(seed)
    plain = ["ba%d" % i for i in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.choice([5, 30, 120]))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(rng.randint(0, len(w)), rng.choice(["vexor", "Gribble,", "snarf"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark):
    rows = _texts(500, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, None, 0.5), (1000, "", 0.5), (1000, "", 0.5), (1001, "ba1 " * 3000 + "snarf vexor gribble", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.7) == rows[r["doc_id"]][2] for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert len(held) > 100 and np.mean(held) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    empty = [r for r in got if r["doc_id"] in (None, 1000)]
    assert len({r["score"] for r in empty}) == 1 and len(empty) == 3
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs.limit(3), labels.limit(0)).count() == 3


def test_quality(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("aeioulnst") for _ in range(rng.randint(1, 8))) for _ in range(80)]
        if i % 5 == 0:
            w = [x.upper() + "!!$$" for x in w]
        lines = [" ".join(w[a : a + 10]).capitalize() + "." for a in range(0, 80, 10)]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows] + [(None, None, "s"), (500, "", "s"), (500, "", "s"), (501, "x" * 200_000, "s")], "doc_id bigint, text string, score string")
    got = {r["doc_id"]: r for r in quality.score_quality(docs).collect()}
    right = [got[i]["predicted"] == (i % 5 != 0) for i, _ in rows]
    assert np.mean(right) > 0.97
    assert quality.score_quality(docs).count() == 304
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_weak_labels_find_the_good_labellers():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.7
    accuracy = [0.95, 0.8, 0.7, 0.55]
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where((rng.random(4000) < a) == y, 2, 1)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, prior = quality.fit_votes(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.06
    assert abs(table[1, 0, 2] - 0.95) < 0.05 and table[1, 0, 2] > table[1, 1, 2] > table[1, 3, 2]


def test_html():
    text = lambda s: html_layout.render(html_layout.parse(s))
    assert text("<title>no</title><h1>A</h1>b<p>c<p>d<br>e") == "A\n\nb\n\nc\n\nd\ne"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>") == "- a\n- b\n  - c\n- d\n\n3. x\n4. y"
    assert text("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>both</table>z") == "Name       Qty\napple pie  3\nboth\n\nz"
    assert text("a<div hidden>x</div><div style='display: none'>y</div><script>'<p>'</script><!-- <p>c -->b") == "ab"
    assert text("<pre>  x\n   y</pre>") == "  x\n   y".strip("\n")
    assert text("&amp;&eacute;<b>c</b>&nbsp;d") == "&é" + "c\u00a0d"
    assert text("<div>" * 5000 + "x") == "x"
    assert text("") == text("<") .replace("<", "") == ""
    assert text("a < b > c <3") == "a < b > c <3"
    for broken in ("<p", "</", "<table><td>", "<!--", "<script>", "<li></ul></li>", "<td>x</td>", "</table></tr>", "<a href='", "<select><option>a<option>b"):
        text(broken)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (None, None, "old"), (2, "", "old"), (1, "<p>a", "old"), (3, "<b>x</b>" * 20000, "old")], "page_id bigint, html string, text string")
    got = html_layout.extract_text(pages)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted(((r["page_id"], (r["text"] or "")[:3], r["text"] is None) for r in got.collect()), key=str) == sorted([(1, "a", False), (None, "", True), (2, "", False), (1, "a", False), (3, "xxx", False)], key=str)
    assert html_layout.page_texts(pages.limit(0)).count() == 0


def _plain_top_k(rows, k=10):
    """(id, vector) rows: for each row whose id is divisible by 100 the k best of all other rows."""
    m = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for a, (q, x) in enumerate(m):
        if q % 100 == 0:
            best = sorted((-int(x[: len(y)] @ y[: len(x)]), i) for b, (i, y) in enumerate(m) if a != b)[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize("block", [3, 8192])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    vecs = [(i, [float(x) for x in rng.standard_normal(8) * rng.choice([0.1, 1, 3])]) for i in range(400)]
    vecs += [(i, vecs[7][1]) for i in range(400, 640)]  # one vector very often
    vecs += [(641, []), vecs[100], vecs[100], (100, vecs[3][1]), vecs[5], (200, [1.0, 2.0])]
    odd = [(700, None), (800, [None] * 8), (900, [float("nan")] * 8), (1000, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs + odd], "vec_id bigint, embedding array<float>, score int").repartition(5)
    got = topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == _plain_top_k(vecs)


def test_top_k_of_few(spark):
    kind = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0])], kind)
    same, other = 1024 * 1024 * 5, 1024 * 1024 * 5
    got = topk.top_k(df, df.filter("vec_id = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, same)] * 2 + [(0, 2, 1, other)] * 2
    assert topk.top_k(df.limit(0), df).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0
    assert topk.top_k(df, spark.createDataFrame([(7, [1.0, 0.0])], kind)).count() == 3


def test_top_k_prunes_what_is_far():
    """Clustered vectors: most products are never computed."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 4)) * 4000
    x = centres[rng.integers(0, 12, 24_000)] + rng.standard_normal((24_000, 4)) * 40
    x = np.floor(x / np.sqrt((x * x).sum(1))[:, None] * 4000)
    top = float((x * x).sum(1).max())
    lifted = topk._lifted(x, top)
    pivots = topk._far_apart(lifted[:512], 32)
    d = topk._distances(lifted, pivots)
    near = d.argmin(1)
    dist = d[np.arange(len(x)), near]
    by = np.lexsort((dist, near))
    task = topk.Searcher(np.arange(50), x[:50], pivots, top, np.full(50, -np.inf), 10)
    task.annuli(by, near[by], dist[by], x[by])
    assert task.products < 0.5 * task.pairs


