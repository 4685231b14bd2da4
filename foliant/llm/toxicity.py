"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Input at each word: a vector of the word itself, if it is one of the vocabulary, and the mean of the vectors of its runs of three,
five and seven characters (bytes). Two gated recurrent layers read a window of words in both directions, attention pools their states, and a
logistic unit scores the window. All overlapping windows of a whole text are scored; a logistic unit over the largest, the sum and the
number of their scores, fitted to the training texts, gives the text's.

Labels are of whole texts, so training chooses windows: first those whose words tell toxic from clean texts best, then, round by
round, those that the network itself scores highest, which in clean texts are the hard ones. The training texts
are a sample of at most `Plan.toxic` and `Plan.clean` labelled rows of `Plan.chars` characters each kind, in the order of a hash of their id.
One task of an executor reads and learns from it; the driver only sees the weights. Scoring works on Arrow batches: words are hashed in blocks, each distinct one is looked up once a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, store, text_blocks, tidied, word_bounds, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class Plan:
    hidden: int = 8
    window: int = 32
    stride: int = 16
    grams: int = 16384
    words: int = 2000  # of the vocabulary at most
    sure: float = 4.0  # standard errors by which toxic texts hold a word or run of characters more often, for it to be an input
    toxic: int = 2000  # rows of each kind in the sample at most
    clean: int = 4000
    chars: int = 20_000_000  # of each kind's texts in the sample at most
    rounds: int = 3
    steps: int = 60
    batch: int = 256
    rate: float = 0.01
    seed: int = 5


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


@dataclass
class Words:
    """The words of some texts, each distinct one once: its hash, its runs of characters, and which word stands where."""

    hashes: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray


def read_words(buf: np.ndarray, offs: np.ndarray, grams: int) -> Words:
    """A-Z and the accented capitals of Latin-1 are lower-cased, and up to three ASCII marks are taken off either end of a word."""
    low = _LOW[buf]
    accented = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)  # U+00C0 to U+00DE in UTF-8
    low[1:][accented] += 32
    starts, ends, bounds = word_bounds(low, offs)
    for _ in range(3):
        if len(starts):
            starts = starts + (_MARK[low[starts]] & (ends - starts > 1))
            ends = ends - (_MARK[low[ends - 1]] & (ends - starts > 1))
    hashes, first, ids = np.unique(word_hashes(low, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    cuts = np.concatenate(([0], np.cumsum(b - a)))
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - a, b - a)
    begin, stop = np.repeat(a, b - a), np.repeat(b, b - a)
    code = [np.where((at + k >= begin) & (at + k < stop), low[np.clip(at + k, 0, max(len(low) - 1, 0))], 0).astype(np.uint64) << _U(8 * (k + 3)) for k in range(-3, 4)]
    three = code[2] | code[3] | code[4]
    five = three | code[1] | code[5]
    gram = np.stack([mix64(g + _U(n << 56)) % _U(grams) for n, g in ((3, three), (5, five), (7, five | code[0] | code[6]))], axis=1).ravel()
    cuts = cuts * 3
    return Words(hashes, gram.astype(np.int32), cuts, ids, bounds)


def read_texts(parts: Iterator[tuple[np.ndarray, np.ndarray]], grams: int) -> Words:
    """Many texts, in blocks of (bytes, offsets); of each block only what it holds of words stays."""
    read = [read_words(buf, offs, grams) for buf, offs in parts]
    hashes, first, ids = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r.hashes for r in read)]), return_index=True, return_inverse=True)
    at, words = 0, 0
    all_ids, bounds = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(r.cuts) for r in read)])
    for r in read:
        own = ids[at : at + len(r.hashes)]
        all_ids.append(own[r.ids].astype(np.int32))
        bounds.append(r.bounds[1:] + words)
        at, words = at + len(r.hashes), words + len(r.ids)
    flat, start = np.concatenate([np.zeros(0, np.int32), *(r.grams for r in read)]), np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.concatenate(([0], np.cumsum(sizes[first])))
    grams_of = np.empty(cuts[-1], np.int32)
    for a in range(0, len(hashes), 4096):
        b = min(a + 4096, len(hashes))
        grams_of[cuts[a] : cuts[b]] = flat[np.arange(cuts[a], cuts[b]) - np.repeat(cuts[a:b] - start[first[a:b]], sizes[first[a:b]])]
    return Words(hashes, grams_of, cuts, np.concatenate(all_ids), np.concatenate(bounds))


def cut_windows(bounds: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of each window; a document without words has one empty window."""
    n = np.diff(bounds)
    many = np.maximum(1, -(-(n - width) // stride) + 1)
    doc = np.repeat(np.arange(len(n)), many)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * stride
    return doc, bounds[:-1][doc] + at, np.minimum(n[doc] - at, width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(np.clip(-2 * x, -60, 60))) - 1


@dataclass
class Network:
    plan: Plan
    vocabulary: np.ndarray  # sorted hashes
    p: dict[str, np.ndarray] = field(default_factory=dict)
    pool: np.ndarray = field(default_factory=lambda: np.zeros(4))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(3))
    spread: np.ndarray = field(default_factory=lambda: np.ones(3))

    def begin(self) -> None:
        rng, h = np.random.default_rng(self.plan.seed), self.plan.hidden
        draw = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": draw(len(self.vocabulary) + 1, 6 * h),
            "gram": draw(self.plan.grams, 6 * h, scale=0.3),
            "bias": np.zeros(6 * h, np.float32),
            "ahead": draw(h, 3 * h, scale=h**-0.5),
            "back": draw(h, 3 * h, scale=h**-0.5),
            "look": draw(2 * h, h, scale=0.3),
            "ask": draw(h, scale=0.5),
            "out": draw(2 * h, scale=0.3),
            "level": np.full(1, -1.0, np.float32),
        }

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """A word's row in the vocabulary; the last row, kept at zero, is for the others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), int)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i, len(self.vocabulary))

    def inputs(self, w: Words) -> np.ndarray:
        """For each distinct word what it adds to the gates of both directions; a last row for no word."""
        out = np.zeros((len(w.hashes) + 1, 6 * self.plan.hidden), np.float32)
        for a in range(0, len(w.hashes), 4096):
            b = min(a + 4096, len(w.hashes))
            g = self.p["gram"][w.grams[w.cuts[a] : w.cuts[b]]]
            out[a:b] = np.add.reduceat(g, w.cuts[a:b] - w.cuts[a], axis=0) / np.diff(w.cuts[a : b + 1])[:, None]
            out[a:b] += self.p["word"][self.place(w.hashes[a:b])] + self.p["bias"]
        return out

    def read(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """The logits of windows ids (window, place); mask tells words from padding."""
        h, (n, width) = self.plan.hidden, ids.shape
        states = np.zeros((width, n, 2 * h), np.float32)
        for d, name in enumerate(("ahead", "back")):
            u, s = self.p[name], np.zeros((n, h), np.float32)
            gates, own = np.ascontiguousarray(x[:, 3 * h * d : 3 * h * d + 3 * h]), slice(h * d, h * d + h)
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                g, su = gates[ids[:, t]], s @ u
                zr = _sigmoid(g[:, : 2 * h] + su[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = _tanh(g[:, 2 * h :] + r * su[:, 2 * h :])
                after = new + z * (s - new)
                if not mask[:, t].all():
                    after = np.where(mask[:, t, None], after, s)
                if trace is not None:
                    trace[d, t] = s, z, r, new, su[:, 2 * h :]
                s = after
                states[t, :, own] = s
        seen = _tanh(states @ self.p["look"])
        weigh = seen @ self.p["ask"]
        weigh = np.where(mask.T, weigh, np.float32(-1e9))
        weigh = np.exp(weigh - weigh.max(0))
        weigh /= weigh.sum(0)
        pooled = (weigh[:, :, None] * states).sum(0)
        if trace is not None:
            trace |= {"states": states, "seen": seen, "weigh": weigh, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["level"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the logistic loss: by parameter, and by row of x."""
        tr: dict = {}
        h, (n, width), p = self.plan.hidden, ids.shape, self.p
        logit = self.read(x, ids, mask, tr)
        d_logit = ((_sigmoid(logit) - y) * weight / n).astype(np.float32)
        states, seen, weigh, pooled = tr["states"], tr["seen"], tr["weigh"], tr["pooled"]
        g = {"out": pooled.T @ d_logit, "level": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["out"]
        d_weigh = (states * d_pool).sum(2)
        d_ask = weigh * (d_weigh - (weigh * d_weigh).sum(0))
        d_seen = d_ask[:, :, None] * p["ask"] * (1 - seen**2)
        g["ask"] = np.einsum("tnh,tn->h", seen, d_ask)
        g["look"] = np.einsum("tna,tnb->ab", states, d_seen)
        d_states = weigh[:, :, None] * d_pool + d_seen @ p["look"].T
        d_x = np.zeros((width, n, 6 * h), np.float32)
        for d, name in enumerate(("ahead", "back")):
            u, du, ds = p[name], np.zeros_like(p[name]), np.zeros((n, h), np.float32)
            for t in range(width - 1, -1, -1) if d == 0 else range(width):
                s, z, r, new, su = tr[d, t]
                all_ = d_states[t, :, h * d : h * d + h] + ds
                on = np.where(mask[:, t, None], all_, 0)
                ds = all_ - on + on * z
                d_new = on * (1 - z) * (1 - new**2)
                d_zr = np.hstack((on * (s - new) * z * (1 - z), d_new * su * r * (1 - r)))
                d_su = np.hstack((d_zr, d_new * r))
                du += s.T @ d_su
                ds = ds + d_su @ u.T
                d_x[t, :, 3 * h * d : 3 * h * d + 3 * h] = np.hstack((d_zr, d_new))
            g[name] = du
        by_row = np.zeros_like(x)
        np.add.at(by_row, ids.T[mask.T], d_x[mask.T])
        return g, by_row

    def score_windows(self, w: Words, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        x, out, width = self.inputs(w), np.zeros(len(at), np.float32), self.plan.window
        for a in range(0, len(at), 2048):
            ids, mask = self.gather(w, at[a : a + 2048], size[a : a + 2048])
            out[a : a + 2048] = self.read(x, ids, mask)
        return _sigmoid(out)

    def score_texts(self, w: Words) -> np.ndarray:
        doc, at, size = cut_windows(w.bounds, self.plan.window, self.plan.stride)
        f = (pooled(self.score_windows(w, at, size), doc) - self.shift) / self.spread
        return _sigmoid(f @ self.pool[:3] + self.pool[3])

    def gather(self, w: Words, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(self.plan.window)
        mask = place < size[:, None]
        ids = np.full(mask.shape, len(w.hashes))
        ids[mask] = w.ids[(at[:, None] + place)[mask]]
        return ids, mask


def train(w: Words, labels: np.ndarray, plan: Plan = Plan()) -> Network:
    """labels: 1 for toxic texts. Texts of one kind alone teach nothing: each text is scored as of that kind, and without any text as clean."""
    y = np.asarray(labels, np.float32)
    if not y.any() or y.all():
        net = Network(plan, np.zeros(0, np.uint64))
        net.begin()
        net.pool = np.array([0, 0, 0, 20.0 if y.any() else -20.0])
        return net
    doc_of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(w.bounds))
    df, bad = _presence(doc_of, w.ids, y, len(w.hashes))
    spread = max(y.mean() * (1 - y.mean()), 1e-9)
    excess = lambda df, bad: (bad - df * y.mean()) / np.sqrt(np.maximum(df, 1) * spread)
    sure = excess(df, bad)
    telling = np.argsort(-sure, kind="stable")[: plan.words]
    net = Network(plan, w.hashes[np.sort(telling[sure[telling] >= plan.sure])])
    net.begin()
    net.p["word"][-1] = 0
    of_word = np.repeat(np.arange(len(w.hashes), dtype=np.int32), np.diff(w.cuts))
    pairs = np.unique(w.ids.astype(np.int64) * len(y) + doc_of)  # of word and text
    every, n_docs = (pairs % len(y)).astype(np.int32), np.bincount(pairs // len(y), minlength=len(w.hashes))
    del pairs, doc_of
    first = np.cumsum(n_docs) - n_docs
    unused = np.ones(plan.grams, bool)
    part = 64
    for a in range(0, plan.grams, part):  # pairs of text and run of characters, a part of the runs at a time
        mine = (w.grams >= a) & (w.grams < a + part)
        word, gram = of_word[mine], w.grams[mine] - a
        n = n_docs[word]
        text = every[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[word], n)]
        unused[a : a + part] = excess(*_presence(text, np.repeat(gram, n), y, part)) < plan.sure
    net.p["gram"][unused] = 0
    tell = np.log((bad / y.mean() + 8) / (df + 8))  # drawn to 0 where a word is rare
    doc, at, size = cut_windows(w.bounds, plan.window, plan.stride)
    word_tell = np.append(tell[w.ids], 0.0)
    value = np.empty(len(at))
    for a in range(0, len(at), 4096):
        span = np.minimum(at[a : a + 4096, None] + np.arange(plan.window), len(word_tell) - 1)
        value[a : a + 4096] = np.where(np.arange(plan.window) < size[a : a + 4096, None], word_tell[span], -9.0).max(1)
    rng, place = np.random.default_rng(plan.seed + 1), net.place(w.hashes)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for k in range(plan.rounds):
        top = np.lexsort((-value, doc))
        top = top[np.concatenate(([True], doc[top][1:] != doc[top][:-1]))]
        more = rng.choice(len(doc), min(len(doc), 2 * len(y)), replace=False)
        more = more[y[doc[more]] == 0]
        pool = [top[y[doc[top]] == 1], np.concatenate((top[y[doc[top]] == 0], more))]
        for step in range(k * plan.steps, (k + 1) * plan.steps):
            half = plan.batch // 2
            rows = np.concatenate([rng.choice(q, half) for q in pool])
            target = np.repeat([1.0, 0.0], half).astype(np.float32)
            weight = np.ones(len(rows), np.float32)
            ids, mask = net.gather(w, at[rows], size[rows])
            used, back = np.unique(ids[mask], return_inverse=True)
            local = np.full(ids.shape, len(used))
            local[mask] = back
            lens = w.cuts[used + 1] - w.cuts[used]
            cuts = np.concatenate(([0], np.cumsum(lens)))
            grams = w.grams[np.arange(cuts[-1]) - np.repeat(cuts[:-1] - w.cuts[used], lens)]
            shown = np.where(rng.random(len(used)) < 0.5, len(net.vocabulary), place[used])
            x = np.zeros((len(used) + 1, 6 * plan.hidden), np.float32)
            x[:-1] = np.add.reduceat(net.p["gram"][grams], cuts[:-1], axis=0) / lens[:, None] + net.p["word"][shown] + net.p["bias"]
            g, dx = net.gradients(x, local, mask, target, weight)
            g["bias"] = dx[:-1].sum(0)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], shown, dx[:-1])
            g["word"][-1] = 0
            np.add.at(g["gram"], grams, np.repeat(dx[:-1] / lens[:, None], lens, axis=0).astype(np.float32))
            g["gram"][unused] = 0
            rate = plan.rate * (1 - step / (plan.rounds * plan.steps)) + 1e-4
            for name, v in net.p.items():
                m1, m2 = moments[name]
                grad = g[name] + (1e-4 * v if name in ("word", "gram") else 0)
                m1 += 0.1 * (grad - m1)
                m2 += 0.005 * (grad * grad - m2)
                v -= rate * (m1 / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2 / (1 - 0.995 ** (step + 1))) + 1e-6)
            net.p["word"][-1] = 0
        value = net.score_windows(w, at, size)
    f = pooled(value, doc)
    net.shift, net.spread = f.mean(0), f.std(0) + 1e-6
    f = np.hstack(((f - net.shift) / net.spread, np.ones((len(f), 1))))
    for _ in range(25):  # Newton's method with a small ridge
        q = _sigmoid(f @ net.pool)
        grad = f.T @ (q - y) + 0.1 * net.pool
        net.pool = net.pool - np.linalg.solve((f * (q * (1 - q))[:, None]).T @ f + 0.1 * np.eye(f.shape[1]), grad)
    return net


def _presence(doc: np.ndarray, item: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each of n items occurs, and in how many toxic ones."""
    pairs = np.unique(doc.astype(np.int64) * n + item)
    return np.bincount(pairs % n, minlength=n), np.bincount(pairs % n, weights=y[pairs // n], minlength=n)


def pooled(value: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each document's window scores (in order of documents): the largest as a logit, the root of their sum, and the logarithm of their number."""
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    top = np.clip(np.maximum.reduceat(value.astype(np.float64), head), 1e-5, 1 - 1e-5)
    many = np.diff(np.append(head, len(doc)))
    return np.stack((np.log(top / (1 - top)), np.sqrt(np.add.reduceat(value.astype(np.float64), head)), np.log(many)), axis=1)


def training_sample(docs: DataFrame, labels: DataFrame, plan: Plan, usable) -> DataFrame:
    """doc_id, text, toxic (0 or 1) and at (its order) of the rows that the sample is read from, a bounded number. A document with several labels counts as toxic if one says so; of several texts under one id the least counts."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).cast("int").alias("toxic")).filter(usable)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marked.filter("toxic = 1").orderBy(*order).limit(plan.toxic).unionAll(marked.filter("toxic = 0").orderBy(*order).limit(plan.clean))
    one = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("doc_id"))
    return one.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("doc_id"))


def _weights(net: Network) -> tuple:
    return net.vocabulary, net.p, net.pool, net.shift, net.spread


def _learn(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, read = [np.zeros(0, np.int32)], np.zeros(2, np.int64)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                kind = batch.column(1).to_numpy(zero_copy_only=False)
                size = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
                keep = np.zeros(len(kind), bool)
                for k in (0, 1):  # of each kind as many texts as have their characters
                    mine = kind == k
                    upto = read[k] + np.cumsum(size[mine])
                    keep[mine] = upto <= plan.chars
                    read[k] = upto[-1] if len(upto) else read[k]
                y.append(kind[keep])
                for _, buf, offs in text_blocks([], batch.column(0).filter(pa.array(keep))):
                    yield buf, offs

        words = read_texts(parts(), plan.grams)
        learned = pickle.dumps(_weights(train(words, np.concatenate(y), plan)))
        yield pa.RecordBatch.from_arrays([pa.array([learned], pa.binary())], ["learned"])

    return run


def learn(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> tuple:
    """The weights, learned in one task from the sample and kept in the shared folder, so that a lost executor costs no second training."""
    sample = training_sample(docs, labels, plan, ~held_out(F.col("doc_id")))
    told = store(sample.repartition(1).sortWithinPartitions("at", "doc_id").select("text", "toxic").mapInArrow(tidied(_learn(plan)), "learned binary"))
    row = told.first()  # some MB, however many documents there are; no row if there is no labelled text
    return pickle.loads(row["learned"]) if row else _weights(train(read_texts(iter(()), plan.grams), np.zeros(0), plan))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), threshold: float = 0.7) -> DataFrame:
    """Every row with held_out, score (0 to 1) and predicted (1 from `threshold` on).

    Only the text goes into a score. Labels of held-out rows (crc32 of the id modulo 3 is 1) and null labels aren't learned from.
    Null and empty texts are scored as one empty window. Rows with a null id are scored, and not held out. Equal
    texts have equal scores. Without labels of both kinds all scores are alike, near 0 (near 1 if only toxic ones are known).
    Columns named like the three new ones are replaced, others stay. An empty table gives an empty one.
    """
    learned = learn(docs, labels, plan)
    docs = docs.drop("held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast((asdict(plan), *learned))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, *learned = sent.value
        model = Network(Plan(**sizes), *learned)
        for batch in batches:
            for columns, buf, offs in text_blocks(batch.columns, batch.column(at)):
                w = read_words(buf, offs, model.plan.grams)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score_texts(w))], [*batch.schema.names, "score"])

    scored = docs.mapInArrow(tidied(run), _with_score(docs))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def _with_score(docs: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
