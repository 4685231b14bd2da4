"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text, width=4, seed=42):
    low = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not low:
        return 0
    shingles = [" ".join(low[i : i + width]) for i in range(max(1, len(low) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, max_bits=4):
    """(doc_id, text) rows to (doc_id, fingerprint, component_id) rows."""
    prints = [fingerprint(t) for _, t in rows]
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                sets.join(i, j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[sets.root(i)].append(d)
    return [(d, f"{prints[i]:016x}", min(ids[sets.root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def substrings(rows, window=35):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, kept) rows."""
    split = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return out


def edits(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (c != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes, weights=(5, 2, 1), share=1.5, at_most=2.0):
    """{source: size} to {source: target}, by rounds of resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > at_most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = at_most * sizes[s]
            rest -= out[s]
        free -= over
    return out


def edits_of(item, text):
    """`edits` over code points, a row of the table at a time."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, c in enumerate(item.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
        new[0] = i + 1
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def near_groups(rows, width=5, similarity=0.8):
    """(doc_id, text) rows to the smallest id of each component of texts that share so much of their word runs."""
    sets, runs = Sets(len(rows)), []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        runs.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            one = len(runs[i] | runs[j])
            if one == 0 or len(runs[i] & runs[j]) >= similarity * one - 1e-9:
                sets.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[sets.root(i)] = min(least.get(sets.root(i), key), key)
    return sorted(None if none else d for none, d in least.values())


_MARKS = set("#$%&*!@^~_=+<>{}\\")


def votes(text):
    """The labellers' votes on one text: 1 bad, 2 good, 0 nothing."""
    text = text or ""
    w, chars = words(text), len(text)
    small = [x for x in text if "a" <= x <= "z"]
    large = [x for x in text if "A" <= x <= "Z"]
    accented = [x for x in text if "\u00c0" <= x <= "\u00de"]
    letters = len(small) + len(large) + sum(ord(x) >= 0xC0 for x in text)
    lines = [x for x in text.split("\n") if x]
    ascii_low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    begins = lambda x: x[:1].isascii() and x[:1].isalpha() or ord(x[0]) >= 0xC0

    def say(value, of, bad, good):
        if of <= 0:
            return 0
        x = value / of
        return 1 if bad(x) else 2 if good(x) else 0

    n = len(w)
    return [
        say(n, 1, lambda x: x < 5, lambda x: x >= 40),
        say(sum(x in _MARKS for x in text), n, lambda x: x > 0.3, lambda x: x < 0.05),
        say(len(large) + len(accented), letters, lambda x: x > 0.4, lambda x: x < 0.15),
        say(text.count("|"), n, lambda x: x > 0.15, lambda x: x < 0.02),
        say(len({ascii_low(x) for x in w}), n if n >= 20 else 0, lambda x: x < 0.25, lambda x: x > 0.5),
        say(len(lines) - len(set(lines)), len(lines) if len(lines) >= 3 else 0, lambda x: x > 0.3, lambda x: x < 0.1),
        say(sum(x[-1] in ".!?:\"')" for x in lines), len(lines), lambda x: x < 0.2, lambda x: x > 0.6),
        say(chars, n, lambda x: x > 14 or x < 3, lambda x: 4 < x < 9),
        say(sum("0" <= x <= "9" for x in text), chars, lambda x: x > 0.15, lambda x: x < 0.05),
        say(sum(len(x.encode()) <= 3 and begins(x) for x in w), n, lambda x: x < 0.08, lambda x: x > 0.15),
    ]


def weak_labels(votes, rounds=60):
    """Expectation-maximisation row by row: each row's posterior of good."""
    n = len(votes[0])
    rare = {(j, v): math.log((sum(r[j] == v for r in votes) + 1) / (sum(r[j] != 0 for r in votes) + 2)) for j in range(n) for v in (1, 2)}
    post = [1 / (1 + math.exp(-(1 + sum(rare[j, 1] if v == 1 else -rare[j, 2] for j, v in enumerate(r) if v)))) for r in votes]
    for _ in range(rounds):
        good, bad = sum(post), sum(1 - p for p in post)
        prior = min(max(good / (good + bad), 0.02), 0.98)
        table = {}
        for j in range(n):
            for cls in (0, 1):
                weigh = [p if cls else 1 - p for p in post]
                count = {v: sum(w for w, r in zip(weigh, votes) if r[j] == v) + 1 for v in (1, 2)}
                for v in (1, 2):
                    table[cls, j, v] = count[v] / (count[1] + count[2])
            up, down = max(table[1, j, 2], table[0, j, 2]), max(table[0, j, 1], table[1, j, 1])
            table[1, j, 2], table[0, j, 1] = up, down
        new = []
        for r in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[1, j, v] / table[0, j, v]) for j, v in enumerate(r) if v)
            new.append(1 / (1 + math.exp(-min(max(odds, -30), 30))))
        post = new
    return post


def toxic(net, text):
    """One text's score, window by window and word by word, with the weights of a trained network."""
    from foliant.llm import toxicity

    h, p, plan = net.plan.hidden, net.p, net.plan
    raw = (text or "").encode()
    w = toxicity.read_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), plan.grams)
    x = []
    for k in range(len(w.hashes)):
        grams = p["gram"][w.grams[w.cuts[k] : w.cuts[k + 1]]]
        known = np.flatnonzero(net.vocabulary == w.hashes[k])
        x.append(grams.mean(0) + (p["word"][known[0]] if len(known) else p["word"][-1]) + p["bias"])
    sig = lambda v: 1 / (1 + np.exp(-v))

    def logit(ids):
        both = []
        for d, name in enumerate(("ahead", "back")):
            s, states = np.zeros(h), []
            for i in ids if d == 0 else ids[::-1]:
                g, su = x[i][3 * h * d : 3 * h * d + 3 * h], s @ p[name]
                z, r = sig(g[:h] + su[:h]), sig(g[h : 2 * h] + su[h : 2 * h])
                s = (1 - z) * np.tanh(g[2 * h :] + r * su[2 * h :]) + z * s
                states.append(s)
            both.append(states if d == 0 else states[::-1])
        states = [np.concatenate((a, b)) for a, b in zip(*both)]
        if not states:
            return float(p["level"][0])
        weigh = np.array([np.tanh(s @ p["look"]) @ p["ask"] for s in states])
        weigh = np.exp(weigh - weigh.max())
        return float(sum(a * s for a, s in zip(weigh / weigh.sum(), states)) @ p["out"] + p["level"][0])

    ids, scores, at = w.ids.tolist(), [], 0
    while True:
        scores.append(sig(logit(ids[at : at + plan.window])))
        if at + plan.window >= len(ids):
            break
        at += plan.stride
    top = min(max(max(scores), 1e-5), 1 - 1e-5)
    f = (np.array([math.log(top / (1 - top)), math.sqrt(sum(scores)), math.log(len(scores))]) - net.shift) / net.spread
    return float(sig(f @ net.pool[:3] + net.pool[3]))
