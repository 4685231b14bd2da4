"""Whitening, the chosen-path join and the prefix trie against plain versions, with odd rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import chosen_path, near_copies, prefix_trie, queries, whitening

from . import brute

SF1 = "/root/testdata/sf0.01"


# ---- whitening ---------------------------------------------------------------------------------------------------------------------------------------


def _whitened(rows, components=8):
    """vec_id, deviation, whitened by double precision, one row after the other; eigenvalue shares."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in good)
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in good], object)
    n, s = len(x), x.sum(0)
    centred = np.array([[float(a * n - b) / n for a, b in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return [i for i, _ in good], [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x], centred @ u[:, :components], e, u


def test_whitening_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF1}/embeddings.parquet").collect()]
    ids, dev, y, e, _ = _whitened(rows)
    got = {}
    for r in queries.op11_whitening(spark, SF1).collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(ids) and all(sorted(g) == list(range(1, 9)) for g in got.values())
    found = np.array([[got[i][c]["whitened"] for c in range(1, 9)] for i in ids])
    want = y / np.sqrt(e[:8])
    sign = np.sign((found * want).sum(0))
    assert np.abs(found * sign - want).max() < 1e-8
    one = got[ids[0]]
    assert [one[c]["explained"] for c in range(1, 9)] == pytest.approx((e[:8] / e.sum()).tolist(), rel=1e-9)
    assert all(got[i][3]["deviation"] == d and got[i][3]["n"] == len(ids) for i, d in zip(ids, dev)) and one[1]["identity_error"] < 1e-9


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 5), (1, [1.0, 2.0], 6), (2, None, 7), (3, [1.0, None], 8), (4, [float("nan"), 1.0], 9), (None, [3.0], 1), (6, [float("inf"), 0.0], 2), (7, [-2.5, 0.001], 3)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, deviation int").repartition(3)
    model = whitening.fit(vectors)
    got = sorted(whitening.whiten(vectors, model).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["deviation"]))
    ids, dev, y, e, _ = _whitened([(r[0], r[1]) for r in rows])
    assert [r["vec_id"] for r in got] == [1, 1, 7, None] and model.n == 4  # a shorter vector counts as if zeros followed
    assert [r["deviation"] for r in got] == [5, 6, 3, 1] and sorted(int(r["deviation_"]) for r in got) == sorted(dev)
    assert np.allclose(sorted(abs(r["whitened"][0]) for r in got), sorted(np.abs(y[:, 0] / np.sqrt(e[0]))))
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id bigint, embedding array<float>")  # no variance: nothing to scale by
    model = whitening.fit(same)
    assert model.identity_error is None and [r["whitened"] for r in whitening.whiten(same, model).collect()] == [[None, None]] * 2
    assert whitening.fit(same.limit(0)) is None and whitening.fit(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")) is None
    empty = whitening.fit(spark.createDataFrame([(1, [])], "vec_id bigint, embedding array<float>"))
    assert empty.n == 1 and len(empty.values) == 0
    with pytest.raises(Exception, match="summed exactly"):
        whitening.fit(spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>"))


def test_squares_beyond_64_bits():
    x = np.array([[0, 5], [1 << 30, 7]], np.int64)
    n, sums = 10**9, [123456789 << 20, 10**10]
    assert [int(v) for v in whitening._squares(x, sums, n).to_pylist()] == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]


# ---- chosen paths ------------------------------------------------------------------------------------------------------------------------------------


def _sets(text, width):
    w = [x.lower() if x.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in brute.words(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _near(rows, width=2):
    """doc_id, n_shingles, component_id, kept by all pairs."""
    sets, tied = [_sets(t, width) for _, t in rows], brute.Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                tied.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[tied.root(i)] = min(least.get(tied.root(i), d), d)
    return [(d, len(sets[i]), least.get(tied.root(i)), d == least.get(tied.root(i))) for i, (d, _) in enumerate(rows)]


def _copies(rng, words, groups):
    rows = []
    for many, length in groups:
        w = [rng.choice(words) for _ in range(length)]
        for _ in range(many):
            c = list(w)
            for _ in range(rng.randint(0, max(1, length // 30))):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append(" ".join(c))
    return rows


@pytest.mark.parametrize("small", [4, 64])
def test_chosen_paths_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    rng = random.Random(small)
    words = ["w%d" % i for i in range(60)]
    texts = _copies(rng, words, [(40, 200), *[(3, rng.choice([5, 40, 120])) for _ in range(40)], *[(1, 80)] * 60])
    texts += ["", None, " \n", "Ein", "EIN", "ein", "Ä ß", "ä ß", "a b c d e f", "A b c d e f g", "x " * 500, "x x"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (3, texts[3]), (3, "a b")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, fp int, node string").repartition(5)
    got = [tuple(r) for r in chosen_path.near_duplicates(docs, width=2).collect()]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=order) == sorted(_near(rows), key=order)
    assert chosen_path.near_duplicates(docs.limit(0), width=2).count() == 0


def test_pairs_at_the_bound_are_found():
    """Pairs of exactly 0.8: as many as the bits and trees ask for."""
    assert chosen_path.survival(0.8) == pytest.approx(0.9375) and chosen_path.trees_for(0.8, 0.999999) == 5
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(300):
        both, one, other = rng.integers(0, 2**63, 80, dtype=np.uint64), *rng.integers(0, 2**63, (2, 10), dtype=np.uint64)
        h = [np.unique(np.concatenate((both, x))) for x in (one, other)]
        sig = chosen_path.signatures(np.concatenate(h), np.array([0, len(h[0]), len(h[0]) + len(h[1])]))
        b = chosen_path._bits(sig)
        agree.append((int(np.bitwise_count(~(b[0] ^ b[1])).sum()), float((sig[0] == sig[1]).mean())))
    assert min(a for a, _ in agree) >= chosen_path.bits_for(0.8, 0.999999) and abs(np.mean([s for _, s in agree]) - 0.8) < 0.01


def test_a_shingle_of_very_many_classes():
    """One million classes of one shingle pass in batches: what is held is their codes."""
    n = 1_000_000
    began = time.time()
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(10_000, 7)), pa.array(np.arange(at, at + 10_000))], ["h", "fp"]) for at in range(0, n, 10_000)]
    batches.append(pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 9]), pa.array([n - 1, 1, 1, 2])], ["h", "fp"]))
    got = [tuple(map(len, x)) + (int(x[2][0]),) for x in near_copies._shared(iter(batches))]
    assert sum(x[0] for x in got) == n + 2 and got[0][3] == n and got[-1] == (2, 2, 2, 2) and time.time() - began < 5


def test_frequent_shingles_are_dealt_otherwise(spark, monkeypatch):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = [" ".join(passage + [rng.choice(words) for _ in range(8)]) for _ in range(60)] + _copies(rng, words, [(3, 100)] * 10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    monkeypatch.setattr(near_copies, "GROUP", 32)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == want


# ---- prefix trie -------------------------------------------------------------------------------------------------------------------------------------


def _trie(rows):
    """Nodes by walking every conversation, as op13 defines them."""
    chats = {}
    for c, turn, role, text in rows:
        if c is not None:
            chats.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in chats.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    out = []
    for node, m in members.items():
        below = [k for k in members if k[: len(node)] == node]
        parents = {k[:-1] for k in members if k}
        up = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        kids = sum(len(k) == len(node) + 1 for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        out.append((min(m), len(node), up, len(m), kids, sum(k not in parents for k in below), saved, sha))
    return out


@pytest.mark.parametrize("ranges", [1, 9])
def test_trie_against_walking(spark, ranges):
    rng = random.Random(ranges)
    rows = []
    for c in [*range(0, 60), *range(200, 230), -7, -150, 515, None]:
        if c in (3, 205):
            continue
        said = [rng.choice(["hi", "", None, "hällo", "x"]) for _ in range(rng.choice([1, 2, 3, 5, 9]))]
        rows += [(c, rng.choice([i, i, None]) if i < 3 else i, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", None][i % 2], t) for i, t in enumerate(said)]
    rows += [(0, 40, "user", "x")] * 3  # repeated rows are turns each
    rows += [(20, i, "user", "y" * (i % 3)) for i in range(100, 400)]  # one conversation of most rows
    rng.shuffle(rows)
    chats = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        if ranges > 1:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        turns = prefix_trie.ordered(chats)
        got = prefix_trie.trie(prefix_trie.grafted(turns), turns.filter("place = 0").select("conv_id"), ("own", "place")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    order = lambda x: (x[1], x[0])
    assert sorted(map(tuple, got), key=order) == sorted(_trie(rows), key=order)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    turns = prefix_trie.ordered(none)
    assert prefix_trie.trie(prefix_trie.grafted(turns), turns.select("conv_id"), ("own", "place")).count() == 0
    alone = spark.createDataFrame([(101, 0, "user", "x")], none.schema)  # its first turns are those of a conversation that isn't there
    turns = prefix_trie.ordered(alone)
    got = prefix_trie.trie(prefix_trie.grafted(turns), turns.filter("place = 0").select("conv_id"), ("own", "place")).collect()
    assert sorted(map(tuple, got)) == sorted(_trie([(101, 0, "user", "x")]))
