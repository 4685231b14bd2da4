"""Quality classifier: a weak-label model, and a hashed linear scorer that learns from it.

Overlapping heuristic labellers vote on every document: good, bad, or nothing. Their votes form one of at most 3^L patterns, which are
counted over all documents; expectation-maximisation over those counts estimates how often each labeller votes what
on good and on bad documents, and so each pattern's posterior. No label is read.

The scorer is logistic: hashed shapes of words (runs of small letters, capitals, digits and each mark), how many there are of
each, and hashed bins of length, repetition and line structure. It is fitted to the posteriors of a sample of at most `SAMPLE`
documents of `SAMPLE_CHARS` characters, in the order of a hash of id and text, in one task of an executor; its level is set so that as large a share of the sample
scores below one half as the vote model takes for bad. Whole texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, text_blocks, tidied, word_bounds, word_hashes

#: Documents that the scorer is fitted to at most, their characters, and hash buckets of its features.
SAMPLE, SAMPLE_CHARS, BUCKETS = 6000, 24_000_000, 1024

BAD, GOOD = 1, 2


LABELLERS = ("length", "marks", "capitals", "bars", "fresh", "again", "ends", "word_size", "digits", "short")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_MARKS, _ENDS, _DIGITS = _table("#$%&*!@^~_=+<>{}\\"), _table(".!?:\"')"), _table("0123456789")
_SMALL, _LARGE = _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kinds(own: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of n owners has."""
    if not len(own):
        return np.zeros(n, np.int64)
    by = np.lexsort((codes, own))
    o, c = own[by], codes[by]
    return np.bincount(o[np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))], minlength=n)


def votes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The labellers' votes on each text (text, labeller): 0 nothing, BAD or GOOD. A rule over the whole text each."""
    n = len(offs) - 1
    starts, ends, bounds = word_bounds(buf, offs)
    words, own = np.diff(bounds), np.repeat(np.arange(n), np.diff(bounds))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[offs[1:]] - total[offs[:-1]]

    chars = count((buf & 0xC0) != 0x80)
    accented = np.zeros(len(buf), bool)  # capitals of Latin-1
    accented[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    large = count(_LARGE[buf] | accented)
    letters = count(_SMALL[buf] | _LARGE[buf] | (buf >= 0xC3))
    breaks = np.flatnonzero(buf == 10)
    a = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    b = np.append(a[1:], len(buf))
    b -= (b > a) & (buf[np.maximum(b - 1, 0)] == 10) if len(buf) else 0
    full = b > a
    a, b = a[full], b[full]
    line_of = np.searchsorted(offs, a, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    closed = np.bincount(line_of, weights=_ENDS[buf[b - 1]] if len(a) else None, minlength=n)
    fresh = _kinds(own, word_hashes(_LOWER[buf], starts, ends), n)
    different = _kinds(line_of, word_hashes(buf, a, b), n)
    short = np.bincount(own, weights=(ends - starts <= 3) & (_SMALL[buf[starts]] | _LARGE[buf[starts]] | (buf[starts] >= 0xC3)), minlength=n) if len(own) else np.zeros(n)
    out = np.zeros((n, len(LABELLERS)), np.int8)

    def say(k: int, value, of, bad, good) -> None:
        """Nothing is said of texts where there is nothing to count in."""
        known = of > 0
        x = value / np.maximum(of, 1)
        out[:, k] = np.where(known & bad(x), BAD, np.where(known & good(x), GOOD, 0))

    say(0, words, np.ones(n), lambda x: x < 5, lambda x: x >= 40)
    say(1, count(_MARKS[buf]), words, lambda x: x > 0.3, lambda x: x < 0.05)
    say(2, large, letters, lambda x: x > 0.4, lambda x: x < 0.15)
    say(3, count(buf == ord("|")), words, lambda x: x > 0.15, lambda x: x < 0.02)
    say(4, fresh, np.where(words >= 20, words, 0), lambda x: x < 0.25, lambda x: x > 0.5)
    say(5, lines - different, np.where(lines >= 3, lines, 0), lambda x: x > 0.3, lambda x: x < 0.1)
    say(6, closed, lines, lambda x: x < 0.2, lambda x: x > 0.6)
    say(7, chars, words, lambda x: (x > 14) | (x < 3), lambda x: (x > 4) & (x < 9))
    say(8, count(_DIGITS[buf]), chars, lambda x: x > 0.15, lambda x: x < 0.05)
    say(9, short, words, lambda x: x < 0.08, lambda x: x > 0.15)
    return out


def pattern_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return votes(buf, offs).astype(np.int64) @ 3 ** np.arange(len(LABELLERS))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (pattern, labeller) and their counts: posterior of good by pattern, P(vote | class), P(good).

    It begins with votes weighed by how rare they are: a fault that few texts have says more than a merit of nearly all, whichever labeller sees it.
    """
    n = patterns.shape[1]
    said = np.stack([((patterns == v) * counts[:, None]).sum(0) + 1 for v in (BAD, GOOD)])
    said = np.log(said / said.sum(0))
    post = 1 / (1 + np.exp(-(1 + (patterns == BAD) @ said[0] - (patterns == GOOD) @ said[1])))
    table, prior = np.zeros((2, n, 3)), 0.5
    for _ in range(rounds):
        total = np.array([(counts * (1 - post)).sum(), (counts * post).sum()])
        prior = np.clip(total[1] / max(total.sum(), 1e-9), 0.02, 0.98)
        table[:, :, 0] = 0  # saying nothing tells nothing
        for v in (BAD, GOOD):
            hit = (patterns == v) * counts[:, None]
            table[0, :, v], table[1, :, v] = ((1 - post)[:, None] * hit).sum(0) + 1, (post[:, None] * hit).sum(0) + 1
        # a labeller is taken to be right more often than not: it may not turn its votes round
        table /= table.sum(2, keepdims=True)
        table[:, :, 0] = 1
        good, bad = np.maximum(table[1, :, GOOD], table[0, :, GOOD]), np.maximum(table[0, :, BAD], table[1, :, BAD])
        table[1, :, GOOD], table[0, :, BAD] = good, bad
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, patterns[:, j]]) - np.log(table[0, j, patterns[:, j]]) for j in range(n))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table, float(prior)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row a text: shares of hashed word shapes, and ones for the bins of size, repetition and lines."""
    n = len(offs) - 1
    starts, ends, bounds = word_bounds(buf, offs)
    own = np.repeat(np.arange(n), np.diff(bounds))
    words = np.diff(bounds)
    out = np.zeros((n, BUCKETS), np.float32)
    if len(buf):
        shape = _SHAPE[buf]
        keep = np.ones(len(buf), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[offs[:-1][offs[:-1] < len(buf)]] = True
        to = np.concatenate(([0], np.cumsum(keep)))
        short, cuts = shape[keep], to[offs]
        a, b, _ = word_bounds(short, cuts)
        code = word_hashes(short, a, b)
        half = BUCKETS // 2
        out[:, :half] = np.bincount(own * half + (code % np.uint64(half)).astype(np.int64), minlength=n * half).reshape(n, half)
        out[:, :half] /= np.maximum(words, 1)[:, None]
    whole = word_hashes(buf, starts, ends)
    kinds = _kinds(own, whole, n)
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))
    lines = breaks[offs[1:]] - breaks[offs[:-1]] + 1
    size = np.diff(offs)
    bins = (
        np.minimum(np.log2(words + 1).astype(int), 15),
        16 + np.minimum((kinds / np.maximum(words, 1) * 16).astype(int), 15) + 16 * np.minimum(np.log2(words + 1).astype(int) // 3, 4),
        112 + np.minimum((words / lines).astype(int), 31),
        144 + np.minimum((size / np.maximum(words, 1)).astype(int), 31),
    )
    for k in bins:
        out[np.arange(n), BUCKETS // 2 + k] = 1
    return out


def fit_scorer(x: np.ndarray, post: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, classes weighed alike, by Adam with a ridge."""
    w, level = np.zeros(x.shape[1], np.float32), 0.0
    if not len(x):
        return w, level
    share = np.clip(post.mean(), 0.02, 0.98)
    weight = (post * 0.5 / share + (1 - post) * 0.5 / (1 - share)).astype(np.float32) / len(x)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        miss = (1 / (1 + np.exp(-np.clip(x @ w + level, -30, 30))) - post) * weight
        g = np.append(x.T @ miss.astype(np.float32) + 1e-4 * w, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, level = w - step[:-1].astype(np.float32), level - float(step[-1])
    return w, level


def calibrated(odds: np.ndarray, post: np.ndarray) -> float:
    """What to add to the odds so that as many of them are negative as the posteriors hold bad texts."""
    if not len(odds):
        return 0.0
    bad = int(round(float((1 - post).sum())))
    by = np.sort(odds)
    edge = by[0] - 1e-3 if bad <= 0 else by[-1] + 1e-3 if bad >= len(by) else (by[bad - 1] + by[bad]) / 2
    return -float(edge)


def _fit(by_id: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [np.zeros((0, BUCKETS), np.float32)], [np.zeros(0, np.float32)]
        for batch in batches:
            for _, buf, offs in text_blocks([], batch.column(0)):
                for part in _few(buf, offs):
                    rows.append(features(*part))
                    target.append(np.array([by_id[k] for k in pattern_of(*part).tolist()], np.float32))
        x, post = np.concatenate(rows), np.concatenate(target)
        w, level = fit_scorer(x, post)
        level += calibrated(x @ w + level, post)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([level], pa.float64())], ["w", "level"])

    return run


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every row with weak_label (posterior of good), score (0 to 1) and predicted (1: keep).

    Null and empty texts are judged like any other, by what the labellers say of an empty one; equal texts are judged alike. Repeated rows stay.
    Columns named like the new ones are replaced, others stay. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("weak_label", "score", "predicted")
    text = docs.select("text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in text_blocks([], batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pattern_of(buf, offs))], ["pattern"])

    seen = text.mapInArrow(tidied(vote), "pattern bigint").groupBy("pattern").count().collect()  # 3^10 rows at most
    ids = np.array([r[0] for r in seen], np.int64)
    post, _, _ = fit_votes(ids[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, np.array([r[1] for r in seen], float))
    by_id = dict(zip(ids.tolist(), post.tolist()))
    # the sample: first hashes and lengths alone, then the texts up to the last of them
    mark = F.xxhash64("doc_id", "text").alias("h")
    first = docs.select(mark, F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy("h").limit(SAMPLE)
    last = first.withColumn("upto", F.sum("n").over(Window.orderBy("h"))).filter(F.col("upto") <= SAMPLE_CHARS).agg(F.max("h")).first()[0]
    fitted = None
    if last is not None:
        sample = docs.select(mark, "text").filter(F.col("h") <= F.lit(last)).orderBy("h").limit(SAMPLE)
        fitted = store(sample.repartition(1).sortWithinPartitions("h").select("text").mapInArrow(tidied(_fit(by_id)), "w binary, level double")).first()
    w, level = (np.frombuffer(fitted["w"], np.float32), fitted["level"]) if fitted else (np.zeros(BUCKETS, np.float32), 0.0)
    sent = spark.sparkContext.broadcast((w, level, by_id))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, level, by_id = sent.value
        for batch in batches:
            for columns, buf, offs in text_blocks(batch.columns, batch.column(at)):
                odds = np.concatenate([features(*part) @ w for part in _few(buf, offs)]) + level
                weak = [by_id[k] for k in pattern_of(buf, offs).tolist()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(weak, pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))), pa.float64())], [*batch.schema.names, "weak_label", "score"])

    out = T.StructType([*docs.schema.fields, T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidied(run), out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _few(buf: np.ndarray, offs: np.ndarray, n: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of a block of n texts at most: a row of features is wide."""
    for a in range(0, len(offs) - 1, n):
        part = offs[a : a + n + 1]
        yield buf[part[0] : part[-1]], part - part[0]
