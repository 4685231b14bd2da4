"""The near-duplicate stage of the pipeline against all pairs, with planted copies of Jaccard 0.8 to 0.95."""

import random

import corpus_pipeline
import pytest

from foliant.llm import near_copies

from . import brute


def _runs(text, width=5):
    w = [x.lower() for x in brute.words(text)]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _plain(rows, similarity=0.8):
    sets, runs = brute.Sets(len(rows)), [_runs(t) for _, t in rows]
    pairs = set()
    for i in range(len(rows)):
        for j in range(i):
            both, one = len(runs[i] & runs[j]), len(runs[i] | runs[j])
            if one == 0 or both >= similarity * one - 1e-9:
                sets.join(i, j)
                pairs.add((j, i))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = sets.root(i)
        least[r] = min(least.get(r, d), d)
    return set(least.values()), pairs


def test_planted_copies(spark):
    rng = random.Random(3)
    vocabulary = ["ba%d" % i for i in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([60, 150, 300]))]
        if i % 3 == 0:
            w = w[:20] + passage + w[20:]
        rows.append(" ".join(w))
        for _ in range(rng.choice([0, 2, 4])):
            c = list(w)
            for _ in range(rng.randint(1, 1 + len(w) // 55)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rows.append(" ".join(c))
    rows += ["", " \n", "Ein kurzer Text", "ein KURZER text", "ein kurzer Satz", rows[0].upper(), rows[1]]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want, pairs = _plain(rows)
    far = sum((brute.fingerprint(rows[a][1]) ^ brute.fingerprint(rows[b][1])).bit_count() > 4 for a, b in pairs)
    assert far > 20  # copies that four bits of 64 don't reach
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    stage = corpus_pipeline.STAGES[1][1]
    got = [r["doc_id"] for r in stage(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert stage(spark, docs.limit(0), "").count() == 0
    odd = spark.createDataFrame([(None, None), (None, ""), (7, rows[0][1]), (7, rows[0][1]), (None, rows[0][1])], "doc_id bigint, text string")
    assert sorted(map(str, (r["doc_id"] for r in stage(spark, odd, "").collect()))) == ["7", "None"]


@pytest.mark.parametrize("most", [60, 400])
def test_large_groups_are_dealt_to_several_tasks(spark, monkeypatch, most):
    """One candidate group of a large component, small ones, and documents of their own, all of which hold one passage."""
    monkeypatch.setattr(near_copies, "GROUP", most)
    rng = random.Random(most)
    vocabulary = ["ba%d" % i for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for many in (25, 6, 4, 1, 1, 1, 1):
        own = [rng.choice(vocabulary) for _ in range(14)]
        w = passage + own
        for _ in range(many):
            c = list(w)
            if many > 1:
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rows.append(" ".join(c))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    want, _ = _plain(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = [r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 1 < len(want) < len(rows)
