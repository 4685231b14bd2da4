"""MinHash near-dedup: a chosen-path similarity join of shingle sets.

Every distinct set of shingles has a signature of minwise values. In each of several independent trees a node chooses two places of the signature, and a set goes to the child of each place's
value, so a pair of similarity s shares a child with probability 1 - (1 - s)**2 and, by the theory of branching processes, some node of every depth with a probability that
`survival` gives; the number of trees follows from the recall that is asked for. A node of few sets is compared exhaustively, by one bit of every minwise value, and what is near
enough there, but for a chance that the recall allows, is a candidate. A larger node branches again, unless its own branching shows that its sets are alike on average:
then further branching would only copy them, and all of its sets are candidates by one link each to the first of them. Candidates make groups, and the links are told on full sets inside of them.

Sets that are equal are one from the start, so exact copies cost nothing. Counts of nodes are combined where rows are read, and nodes of very many sets look up what is known of them by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import look_up, mix64, row_key, sieved, store, tidied
from .near_copies import _batch, _sets_of, confirmed, set_keys
from .simhash import _roots, components

_U = np.uint64
#: Minwise values of a signature; those of the first two levels of each tree come first, and a level below has _LEVEL of the others for its own.
PLACES, _LEVEL = 128, 14
#: Sets of a node that are compared exhaustively, and agreeing bits from which on a node's sets are alike on average: a similarity of a half.
SMALL, _ALIKE = 64, 0.75
#: Rows of a node that a task holds, or is dealt where a node has more, as one of _TAKEN sets tells; only the work depends on it. Of n rows, nodes of more than n / _HUBS are told so, which are few.
_HELD, _TAKEN, _HUBS = 4096, 16, 10_000
#: Pairs that a task compares at a time.
_PAIRS = 1 << 16
_STEPS = mix64(np.arange(1, PLACES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def survival(s: float) -> float:
    """The chance that a pair of similarity s stays together in one tree to any depth: 1 - q for the smaller q with q = (1 - s * (1 - q))**2."""
    q = 0.0
    for _ in range(1000):
        q = (1 - s * (1 - q)) ** 2
    return 1 - q


def trees_for(s: float, recall: float) -> int:
    """Trees that find a pair of similarity s with a probability of `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(s)))) if s < 1 else 1


def bits_for(s: float, recall: float) -> int:
    """Bits of PLACES that a pair of similarity s has in common but for a chance of 1 - recall: places agree in s of all cases, and by chance in half of the others."""
    p, below = (1 + s) / 2, 0.0
    for k in range(PLACES + 1):
        below += math.comb(PLACES, k) * p**k * (1 - p) ** (PLACES - k)
        if below > 1 - recall:
            return k
    return PLACES


def signatures(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(sets, PLACES) minwise values of 16 bits; zeros for an empty set."""
    n = np.diff(cuts)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), PLACES), np.uint16)
    if len(full):
        starts = cuts[:-1][full]
        for k in range(PLACES):
            out[full, k] = mix64(np.minimum.reduceat(h * _STEPS[k], starts)) >> _U(48)
    return out


def _bits(sig: np.ndarray) -> np.ndarray:
    """One bit of each value, as two words."""
    return np.packbits((sig & 1).astype(bool), axis=1).view(np.uint64)


def _children(node: np.ndarray, sig: np.ndarray, first: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rows for each: its place among the rows, and the child of its node. A node chooses among `many` places from `first` on."""
    at = (node >> _U(8)) % _U(many)
    step = _U(1) + (node >> _U(40)) % _U(many - 1)
    rows, ids = [], []
    for b in range(2):
        place = first + ((at + _U(b) * step) % _U(many)).astype(np.int64)
        value = sig[np.arange(len(sig)), place].astype(np.uint64)
        rows.append(np.arange(len(sig)))
        ids.append(mix64(mix64(node + _U(b + 1)) ^ (value * _U(0xD1342543DE82EF95) + place.astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(ids)


_ROWS = "node bigint, fp bigint, size int, b0 bigint, b1 bigint"


def _rows(node: np.ndarray, fp: np.ndarray, size: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return _batch(node=node, fp=fp, size=size.astype(np.int32), b0=bits[:, 0].copy(), b1=bits[:, 1].copy())


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fp, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, PLACES)
    return fp, size, sig, _bits(sig)


def _begin(trees: int):
    """fp, size, sig to the nodes of the second level. Each tree has places of its own there: two for its root, four for the next level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, size, sig, bits = _read(batch)
            for t in range(trees):
                root = np.full(len(fp), mix64(np.array([t + 1], np.uint64))[0])
                for b in range(2):
                    up = mix64(mix64(root + _U(b + 1)) ^ sig[:, 6 * t + b].astype(np.uint64))
                    for c in range(2):
                        yield _rows(mix64(mix64(up + _U(c + 1)) ^ sig[:, 6 * t + 2 + 2 * b + c].astype(np.uint64)), fp, size, bits)

    return run


def _branch(level: int, trees: int):
    """fp, size, sig, node to the children of each node."""
    first = 6 * trees + (level - 3) * _LEVEL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, size, sig, bits = _read(batch)
            row, child = _children(batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64), sig, first, _LEVEL)
            yield _rows(child, fp[row], size[row], bits[row])

    return run


def _pairs_of(node: np.ndarray, fp: np.ndarray, size: np.ndarray, b0: np.ndarray, b1: np.ndarray, least_bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places a, b of rows, in the order of nodes: links that join what is near in a node, fewer than its sets."""
    n = len(node)
    after = np.searchsorted(node, node, "right") - np.arange(n) - 1  # rows behind it in its node
    upto = np.concatenate(([0], np.cumsum(after)))
    found, at = [(np.zeros(0, np.int64),) * 2], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _PAIRS, "right")) - 1)
        a = np.repeat(np.arange(at, to), after[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[at:to] - upto[at], after[at:to])
        fit = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[fit], b[fit]
        near = np.bitwise_count(~(b0[a] ^ b0[b])).astype(np.int64) + np.bitwise_count(~(b1[a] ^ b1[b])) >= least_bits
        found.append((a[near], b[near]))
        at = to
    root = _roots(n, *(np.concatenate(x) for x in zip(*found)), np.arange(n))
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


_LINK, _BIG, _TOLD = 0, 1, 2
_OUT = "kind int, a bigint, b bigint, n bigint, share double"


def _out(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, share: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(a))
    return _batch(kind=np.full(len(a), kind, np.int32), a=a, b=b, n=zero.astype(np.int64) if n is None else n, share=zero if share is None else share)


def _visit(least_bits: int, similarity: float):
    """Rows (node, part, fp, size, b0, b1) in that order, all of a node and part in one task. What is near in a small node comes out as links (a, b); rows of a larger one, or of a part, pass on (node, fp), and with
    them (node, least fp, rows, share): how many bits the first of them have in common."""

    def visit(cols: list[np.ndarray], goes_on: bool) -> Iterator[pa.RecordBatch]:
        """Whole nodes, but for the first if it goes on one that was too large to hold."""
        node, part, fp, size, b0, b1 = cols
        if not len(node):
            return
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (part[1:] != part[:-1])))
        n = np.diff(np.append(first, len(node)))
        large = (n > SMALL) | (part[first] >= 0)
        large[0] |= goes_on
        big = np.repeat(large, n)
        if large.any():
            yield _out(_BIG, node[big], fp[big])
            share = []
            for i, many in zip(first[large].tolist(), n[large].tolist()):
                j = i + min(many, SMALL)
                same = np.bitwise_count(~(b0[i:j, None] ^ b0[None, i:j])).astype(np.int64) + np.bitwise_count(~(b1[i:j, None] ^ b1[None, i:j]))
                m = j - i
                share.append((int(same.sum()) - PLACES * m) / (PLACES * m * (m - 1)) if m > 1 else 1.0)
            yield _out(_TOLD, node[first[large]], np.minimum.reduceat(fp, first)[large], n[large], np.array(share))
        small = np.flatnonzero(~big)
        if len(small):
            a, b = _pairs_of(*(x[small] for x in (node, fp, size, b0, b1)), least_bits, similarity)
            if len(a):
                yield _out(_LINK, fp[small][a], fp[small][b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over = None  # a node whose rows were too many to hold, and some of which have passed on
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[4:] = [c.view(np.uint64) for c in cols[4:]]
            if not len(cols[0]):
                continue
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.flatnonzero(np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])))[-1])
            goes_on = over == (cols[0][0], cols[1][0])
            end = (cols[0][-1], cols[1][-1])
            if len(cols[0]) - last > _HELD or (goes_on and last == 0):
                yield from visit(cols, goes_on)
                held, over = None, end
            else:
                yield from visit([c[:last] for c in cols], goes_on)
                held, over = [c[last:].copy() for c in cols], None
        if held:
            yield from visit(held, False)

    return run


def candidates(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """sets (fp, size, sig: one row a distinct set that isn't empty) to links (fp, to): pairs of at least `similarity` are in one component with a probability of `recall` or more, estimates by bits included."""
    half = 1 - (1 - recall) / 2
    trees, bits = trees_for(similarity, half), bits_for(similarity, half)
    if 6 * trees + 2 * _LEVEL > PLACES:
        raise ValueError("a signature holds no trees for that recall")
    grow = lambda s: s.select("fp", "size", "sig").mapInArrow(tidied(_begin(trees)), _ROWS)
    many, largest, links, level = sets.count() * 4 * trees, None, [], 2
    while many:
        rows = grow(sets)
        part = F.lit(-1)
        if largest is None or largest > _HELD:  # nodes of very many rows are dealt to several tasks
            taken = grow(sets.filter(F.pmod("fp", F.lit(_TAKEN)) == 0)).groupBy("node").agg((F.count("*") * _TAKEN).alias("n"))
            hubs = store(taken.filter(F.col("n") > max(_HELD, many // _HUBS)).select("node", F.ceil(F.col("n") / _HELD).alias("parts")))
            if not hubs.isEmpty():
                rows = rows.join(F.broadcast(hubs), "node", "left")
                part = F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod("fp", F.col("parts")).cast("int"))
        dealt = rows.select("node", part.alias("part"), "fp", "size", "b0", "b1").repartition("node", "part").sortWithinPartitions("node", "part", "fp")
        out = store(dealt.mapInArrow(tidied(_visit(bits, similarity)), _OUT))
        links.append(out.filter(F.col("kind") == _LINK).select(F.col("a").alias("fp"), F.col("b").alias("to")))
        told = out.filter(F.col("kind") == _TOLD).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"), F.min("b").alias("least"), (F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("share"))
        told = store(told)
        big = out.filter(F.col("kind") == _BIG).select(F.col("a").alias("node"), F.col("b").alias("fp"))
        level += 1
        over = 6 * trees + (level - 2) * _LEVEL > PLACES  # no places are left: such nodes are groups, too
        alike = F.lit(True) if over else F.col("share") >= _ALIKE
        links.append(look_up(big, told.filter(alike).select("node", "n", "least"), ["node"], "n").filter("fp <> least").select("fp", F.col("least").alias("to")))
        apart = told.filter(~alike)
        many, largest = apart.agg(F.coalesce(F.sum("n"), F.lit(0)) * 2, F.max("n")).first()
        if many:
            on = store(look_up(big, apart.select("node", "n"), ["node"], "n").select("node", "fp"))
            grow = lambda s, on=on, level=level: s.join(on, "fp").select("fp", "size", "sig", "node").mapInArrow(tidied(_branch(level, trees)), _ROWS)
    return reduce(DataFrame.unionAll, links).distinct() if links else sets.select("fp", F.col("fp").alias("to")).limit(0)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.99999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, null last), kept (whether it is its component's smallest), for every row.

    A document's set is its distinct runs of `width` words, A-Z lower-cased; with fewer words the whole sequence is its one run. Null, empty and wordless texts have no set and are linked with nothing:
    each is its own component. Links are sets with a Jaccard similarity of `similarity` or more, each found with a probability of at least `recall`. Repeated rows stay, and so do rows of null
    ids, whose component may have a null id. Other columns are left out. An empty table gives an empty one.
    """
    keyed = docs.select(F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row")).alias("doc_id"), F.col(text).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def keys(signed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, h, cuts in _sets_of(batch.column(1), [batch.column(0)], width):
                    found = [ids, pa.array(set_keys(h, cuts).view(np.int64)), pa.array(np.diff(cuts))]
                    if signed:
                        found.append(pa.array([x.tobytes() for x in signatures(h, cuts)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(found, ["doc_id", "fp", "size", "sig"][: len(found)])

        return tidied(run)

    # shingles are cheaper made twice than kept: rows of documents are narrow, and a signature is written once for each distinct set
    prints = store(keyed.mapInArrow(keys(False), f"doc_id {kind}, fp bigint, size bigint"))
    sets = keyed.mapInArrow(keys(True), f"doc_id {kind}, fp bigint, size bigint, sig binary").filter("size > 0")
    sets = store(sets.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.count("*").alias("n")))
    groups = components(candidates(sets.select("fp", "size", "sig"), similarity, recall))
    groups = store(groups)
    member = groups.select(F.col("node").alias("fp")).unionByName(groups.select(F.col("root").alias("fp"))).distinct()
    left = store(sets.join(member, "fp").select("fp", "size", "least"))
    texts = store(sieved(keyed, "doc_id.row.a", left.select("least.row.a")).join(left, (F.col("doc_id.row") == F.col("least.row")) & F.col("doc_id.id").eqNullSafe(F.col("least.id"))).select("fp", "text").dropDuplicates(["fp"]))
    tied = store(confirmed(texts, groups, left.select("fp", "size"), width, similarity))
    named = store(sets.join(tied, sets["fp"] == tied["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("classes"))
    named = look_up(named, best, ["root"], "classes").select("fp", "n", F.col("best.id").alias("component_id"))
    full = look_up(prints.filter("size > 0").select("doc_id.id", "fp", "size"), named, ["fp"], "n").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")
    none = prints.filter("size = 0").select(F.col("doc_id.id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("doc_id.id").alias("component_id"))
    return full.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
