import random
import tracemalloc

import numpy as np
import pytest

from foliant.llm import decontaminate, simhash, substring
from foliant.llm.fm_index import FMIndex

from . import brute

SCHEMA = "doc_id bigint, text string, row string, fp string, kept string, gone string"


def _docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(parts)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "<", "NBSP\u00a0x"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 34, 35, 36, 80, 200]))]
        kind = rng.random()
        if rows and kind < 0.3:
            w = (rng.choice(rows)[1] or "").split(" ")
            if kind < 0.2 and w:
                w[rng.randrange(len(w))] = "changed"
        elif kind < 0.5:
            at = rng.randint(0, len(w))
            w = w[:at] + passage[rng.randint(0, 20) :] + w[at:]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(None, None), (n, ""), (n, ""), (None, "lone"), (n + 1, "loop " * 120), rows[5], rows[7]]


def test_simhash(spark):
    rows = _corpus(2)
    got = simhash.near_duplicates(_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.simhash(rows), key=str)
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0
    kept = simhash.drop_near_duplicates(_docs(spark, rows))
    assert kept.columns == _docs(spark, rows).columns
    prints = [brute.fingerprint(t) for _, t in rows]
    sets = brute.Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(sets.root(i), []).append((d is None, d or 0))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())) == sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("n,centres", [(0, 1), (1, 1), (300, 3), (1500, 1)])
def test_trie_links(n, centres):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 2**63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(5):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) * (rng.random(n) < 0.5).astype(np.uint64)
    v = np.unique(v)
    sets = brute.Sets(len(v))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 4):
            sets.join(i, int(j))
    assert simhash.trie_links(v, 0, 4).tolist() == [sets.root(i) for i in range(len(v))]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (102, 101), (200, 200)], "fp bigint, to bigint")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {k: v for k, v in got.items() if k != v} == {**{i: 0 for i in range(1, 71)}, 101: 100, 102: 100}


@pytest.mark.parametrize("hub", [2, 20])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(simhash, "_HUB", hub)
    monkeypatch.setattr(simhash, "_HUBS", 5)
    rng = random.Random(hub)
    pairs = [(0, i) for i in range(1, 60)] + [(100 + i, 99) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(59, 300), (300, 301)]
    sets = brute.Sets(400)
    for x, y in pairs:
        sets.join(x, y)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "fp bigint, to bigint")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {x: sets.root(x) for x in nodes if sets.root(x) != x}


def test_layouts_cover_every_pair():
    rng = random.Random(3)
    for _ in range(100):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        a = np.array([x, y], np.uint64)

        def together(path):
            order, n = simhash._layout(path, 6, 4)
            return len(set((simhash._permute(a, order) >> np.uint64(64 - n)).tolist())) == 1

        first = [k for k in range(15) if together((k,))]
        assert first and all(any(together((k, j)) for j in range(15)) for k in first)
    assert [simhash._path(simhash_code, 15) for simhash_code in (0, 1, 15, 16 * 3 + 7)] == [(), (0,), (14,), (2, 6)]


@pytest.mark.parametrize("dense", [16, 160])
def test_dense_groups_are_dealt_again(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(8)
    v = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 700)]
    for _ in range(6):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) * (rng.random(700) < 0.5).astype(np.uint64)
    v = np.unique(v)
    sets = brute.Sets(len(v))
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 4):
            sets.join(i, int(j))
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint"))
    got = brute.Sets(len(v))
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    for r in links.collect():
        got.join(at[r["fp"]], at[r["to"]])
    assert [got.root(i) for i in range(len(v))] == [sets.root(i) for i in range(len(v))]


def test_substring(spark):
    rows = _corpus(4)
    got = substring.repeated_windows(_docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == sorted(brute.substrings(rows), key=str)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert substring.repeated_windows(_docs(spark, [])).count() == 0
    cleaned = substring.drop_repeats(_docs(spark, rows))
    assert cleaned.columns == _docs(spark, rows).columns
    text = {(d, len(brute.words(t))): (t, n, k) for (d, t), (_, _, n, k) in zip(rows, brute.substrings(rows))}
    assert len(text) and {r["text"] for r in cleaned.collect()} == {t if n == 0 else k for t, n, k in text.values()}


def _same_as_plain(spark, rows, window=35):
    got = substring.repeated_windows(_docs(spark, rows), window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == sorted(brute.substrings(rows, window), key=str)


def test_small_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 50)
    _same_as_plain(spark, _corpus(6, 40))


@pytest.mark.parametrize("window", [1, 3, 6, 7, 64, 200, 400])
def test_other_windows(spark, window):
    rng = random.Random(window)
    passage = ["p%d" % rng.randrange(90) for _ in range(700)]
    rows = [(i, t) for i, t in _corpus(window, 20)]
    for i in range(6):
        a, b = sorted((rng.randrange(150), rng.randrange(400, 700)))
        rows.append((100 + i, " ".join(["x%d" % i, *passage[a:b], "y%d" % i])))
    rows += [(200, "a b c " * 400), (201, "a b c " * 150 + "z")]
    _same_as_plain(spark, rows, window)


@pytest.mark.parametrize("window,most", [(35, 1), (35, 4), (20, 2)])
def test_large_keys_are_continued(spark, monkeypatch, window, most):
    """A passage shorter than a window, in many surroundings, some of which repeat; and one that is periodic."""
    monkeypatch.setattr(substring, "KEY_SEGMENTS", most)
    rng = random.Random(most)
    passage = ["p%d" % i for i in range(window - 6)]
    sides = [["s%d" % rng.randrange(40) for _ in range(12)] for _ in range(8)]
    rows = []
    for i in range(60):
        before, behind = rng.choice(sides), rng.choice(sides)
        w = [f"u{i}"] + before[rng.randint(0, 11) :] + passage + behind[: rng.randint(0, 11)] + [f"v{i}"]
        rows.append((i, " ".join(w)))
    rows += [(70, "a b " * 90), (71, "c a b " * 30), (72, "a b " * 20 + "d"), (73, None)]
    _same_as_plain(spark, rows, window)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    for _ in range(25):
        segs = [rng.integers(0, 4, rng.integers(1, 20)) for _ in range(rng.integers(1, 40))]
        weight = rng.integers(1, 3, len(segs))
        seen = {}
        for s, m in zip(segs, weight):
            for i in range(len(s)):
                for n in range(1, len(s) - i + 1):
                    seen[tuple(s[i : i + n])] = seen.get(tuple(s[i : i + n]), 0) + m
        index = FMIndex(np.concatenate(segs).astype(np.uint64), np.concatenate(([0], np.cumsum([len(s) for s in segs]))), weight)
        for k, end, n in zip(*index.matching_statistics(5)):
            longest = max((x for x in range(1, end + 1) if seen[tuple(segs[k][end - x : end])] > 1), default=0)
            assert n == (longest if n > 5 else min(longest, 5))
        covered = {(k, i) for k, a, b in zip(*index.repeated(5)) for i in range(a, b)}
        assert covered == {(k, j) for k, s in enumerate(segs) for i in range(len(s) - 4) if seen[tuple(s[i : i + 5])] > 1 for j in range(i, i + 5)}


LETTERS = "abcdefgh "


def _noise(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def _planted(rng, items, n, longest=80):
    """Texts that hold an item with some edits, more or fewer than its budget."""
    rows = []
    for i in range(n):
        part = list(rng.choice(items)[1] or "")
        for _ in range(rng.randint(0, 2 + len(part) // 10)):
            at, how = rng.randrange(len(part) + 1), rng.random()
            part[at : at + (how < 0.66)] = [] if how < 0.33 else [rng.choice(LETTERS)]
        rows.append((i // 2 if i % 9 else None, _noise(rng, rng.randint(0, longest)) + "".join(part).upper() + _noise(rng, rng.randint(0, longest))))
    return rows


def _leaks(rows, items):
    found = []
    for d, t in rows:
        for i, item in items:
            if t and item and len(t) < 3000:
                e = brute.edits(item, t.lower())
                if e <= int(len(item) * 0.1 + 1e-9):
                    found.append((d, i, e))
    return sorted(found, key=str)


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontaminate(spark, monkeypatch, blocks):
    rng = random.Random(5)
    items = [(i, _noise(rng, n)) for i, n in enumerate([3, 8, 20, 30, 60, 90, 120])] + [(7, None), (8, ""), (None, _noise(rng, 50)), (1, _noise(rng, 40)), (1, None), (9, "ha " * 15)]
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 250)
    rows = [(None, None), (900, ""), (901, "For " * 2000), *_planted(rng, items, 70), (902, "ha " * 300), (902, "ha " * 300)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.contaminated(_docs(spark, rows), bench)
    want = _leaks(rows, items)
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got.collect()), key=str) == want
    bad = {t for _, t in rows if _leaks([(0, t)], items)}
    kept = decontaminate.clean(_docs(spark, rows), bench)
    assert kept.columns == _docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((r for r in rows if r[1] not in bad), key=str) and bad
    assert decontaminate.contaminated(_docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(_docs(spark, []), bench).count() == 0
    assert decontaminate.clean(_docs(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(_docs(spark, []), bench).count() == 0


def _matched(items, text, rate=0.1):
    index = decontaminate.ItemIndex([(i, decontaminate.fold(t.encode())) for i, t in items], 7, rate)
    buf = np.frombuffer(text.encode(), np.uint8)
    return {(index.items[n][0], e): at for (_, n), (e, at) in decontaminate._fewest(index, buf, np.array([0, len(buf)])).items()}


def test_items_of_every_length():
    """All budgets in full, short items included."""
    rng = random.Random(11)
    for n in range(1, 41):
        items = [(0, _noise(rng, n)), (1, ("ab" * n)[:n])]
        for _, text in _planted(rng, items, 12, 30):
            assert sorted(_matched(items, text)) == [(i, e) for _, i, e in _leaks([(0, text)], items)]


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 400)
    rng = random.Random(12)
    items = [(i, _noise(rng, n) + "é€") for i, n in enumerate([5, 25, 40])]
    for _ in range(20):
        text = "".join(rng.choice(["é", "€", *LETTERS]) for _ in range(2000))
        for _, item in items:
            at = rng.randrange(len(text))
            text = text[:at] + item + text[at:]
        got = _matched(items, text)
        assert {k for k in got if k[1] == 0} == {(i, 0) for i, t in items}
        assert all(abs(text.find(items[i][1]) - at) <= len(items[i][1]) // 10 for (i, e), at in got.items() if text.count(items[i][1]) == 1)


def test_periodic_texts_take_bounded_memory():
    """Each of 600,000 characters hits a third of the item's."""
    tracemalloc.start()
    got = _matched([(0, "ha " * 200), (1, "ha " * 50 + "x" * 40)], "ha " * 200_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {(0, 0)} and peak < 500e6
