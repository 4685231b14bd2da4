"""Exact top-k search by inner product: a pivot-distance index.

Inner products become distances by one more component: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the largest product. Every vector is keyed by its nearest pivot
and its distance to it; the index is range-partitioned and sorted by that key and so is a sequence of annuli. For a
query at distance d from a pivot, the triangle inequality says that an annulus [a, b] holds nothing nearer than
max(d - b, a - d, 0). A task gathers its annuli, goes through them from the nearest bound outwards and stops, for each query, where the bound
can't reach the query's k-th best score; products that are computed are exact integers.

Queries go round in blocks of a bounded size, by their nearest pivot, which are broadcast; the index never moves. The first k-th best comes from the
sample that gave the pivots. It says how far from each pivot a block can find anything, and rows outside of that are filtered where the
index is read: it is stored in the order of pivot and distance, so whole parts of its files are skipped. All scores are merged by (score, id) at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, store, tidied

#: Rows of the sample that pivots and first bounds come from, and pivots.
SAMPLE, PIVOTS = 2048, 48
#: Queries that are broadcast at a time, vectors in an annulus, and vectors that a task gathers before it orders their annuli.
QUERY_BLOCK, ANNULUS, GATHERED = 8192, 1024, 1 << 16
#: Scores that a task holds at a time, about.
_HELD = 1 << 20


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, with zeros behind the shorter ones."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))[:, None]))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T), 0.0))


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal: rows that are far from one another."""
    chosen, near = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of each q, ties to the smaller id."""
    by = np.lexsort((ids, -score, q))
    head = np.concatenate(([True], q[by][1:] != q[by][:-1])) if len(by) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


class Searcher:
    """The k + 1 best of a block of queries, their own rows included, among the annuli that pass by."""

    def __init__(self, q_ids, q, pivots, top, bound, k):
        self.q_ids, self.q, self.pivots, self.top, self.bound, self.k = q_ids, q, pivots, top, bound.copy(), k + 1
        self.norm = (q * q).sum(1)
        self.dist = _distances(np.hstack((q, np.zeros((len(q), 1)))), pivots)
        self.kept = [np.zeros(0, np.int64)] * 4  # query, id, score, whether it equals the query's row
        self.found, self.n, self.products, self.pairs = [], 0, 0, 0

    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.top))

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """For each pivot the least and the largest distance from it at which some query can still find one of its best."""
        radius = np.sqrt(np.maximum(self.norm + self.top - 2 * self.bound + 1 + 2e-9 * self.top, 0))[:, None] + self.slack()
        return (self.dist - radius).min(0), (self.dist + radius).max(0)

    def annuli(self, ids, pivot, dist, x):
        """Rows sorted by (pivot, dist)."""
        if not len(ids):
            return
        cuts = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        cuts = np.unique(np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(cuts, np.append(cuts[1:], len(ids)))] + [[len(ids)]]))
        parts = list(zip(cuts[:-1], cuts[1:]))
        near = np.stack([np.maximum(np.maximum(self.dist[:, pivot[a]] - dist[b - 1], dist[a] - self.dist[:, pivot[a]]) - self.slack(), 0.0) for a, b in parts])
        reach = (self.norm + self.top - near**2) / 2 + 0.5 + 1e-9 * self.top  # no product in the annulus is larger
        self.pairs += len(ids) * len(self.q)
        for i in np.argsort(near.min(1), kind="stable"):
            a, b = parts[i]
            live = np.flatnonzero(reach[i] >= self.bound)
            for j in range(0, len(live), 1024):
                rows = live[j : j + 1024]
                score = self.q[rows] @ x[a:b].T
                self.products += score.size
                at, col = np.nonzero(score >= self.bound[rows, None])
                at_q, at_x = rows[at], a + col
                own = self.q_ids[at_q] == ids[at_x]
                own[own] = (self.q[at_q[own]] == x[at_x[own]]).all(1)
                self.found.append((at_q, ids[at_x], score[at, col].astype(np.int64), own.astype(np.int64)))
                self.n += len(at)
                if self.n > min(_HELD, 8 * self.k * len(self.q) + 4096):
                    self.settle()
        self.settle()

    def settle(self):
        q, ids, score, own = (np.concatenate([old, *(f[i] for f in self.found)]) for i, old in enumerate(self.kept))
        keep = _best(q, ids, score, self.k)
        self.kept, self.found, self.n = [q[keep], ids[keep], score[keep], own[keep]], [], 0
        count = np.bincount(self.kept[0], minlength=len(self.q))
        full = np.flatnonzero(count >= self.k)
        last = np.cumsum(count)[full] - 1
        self.bound[full] = np.maximum(self.bound[full], self.kept[2][last])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query row's k largest inner products of floor(scale * x), ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part, on either side. A query's candidates are all
    rows but its own: of the rows of its id and vector one is left out, and others of its id are candidates. Repeated query rows are queries each; fewer than k candidates
    give fewer rows. A shorter vector counts as if zeros followed. Exact while products stay below 2**53; where norms don't rule larger ones out that is an error. Other columns are left out. Empty tables give an empty one.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    def clean(df: DataFrame) -> DataFrame:
        sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.filter(F.col(vec_id).isNotNull() & F.col(vec).isNotNull() & sound).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("v"))

    rows = clean(vectors)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    stats = rows.agg(F.max(square).alias("top"), F.max(F.size("v")).alias("width")).first()
    if stats["width"] is None:
        return nothing
    top, width = float(stats["top"]), int(stats["width"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    s_ids = np.array([r["vec_id"] for r in sample], np.int64)
    s = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.int64())), width)
    pivots = _far_apart(_lifted(s, top), PIVOTS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(_matrix(batch.column(1), width), top), pivots)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "dist"])

    index = rows.mapInArrow(tidied(key), "vec_id bigint, v array<bigint>, pivot int, dist double")
    index = store(index.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist"))
    told = row_key("vec_id", "v")  # of a query row: its id and vector
    asked = store(clean(queries).select("vec_id", "v", told.alias("row")))
    most = asked.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0.0
    if top * most >= float(2**106):  # the square of the largest product that two of the rows can have
        raise ValueError("inner products of 2**53 and more aren't exact; take a smaller scale")
    kinds = asked.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("v").alias("v"))
    kinds = store(kinds.mapInArrow(_nearest(pivots, width), "a bigint, b bigint, vec_id bigint, v array<bigint>, pivot int, block_key bigint"))
    blocks = _blocks(kinds)
    parts = []
    for chosen in blocks:
        block = kinds.filter(chosen).collect()  # a bounded number of queries
        keys = np.array([(r["a"], r["b"]) for r in block], np.int64)
        q_ids = np.array([r["vec_id"] for r in block], np.int64)
        q = _matrix(pa.array([r["v"] for r in block], pa.list_(pa.int64())), max(width, max(len(r["v"]) for r in block)))[:, :width]
        first = Searcher(q_ids, q, pivots, top, np.full(len(q), -np.inf), k)
        near = _distances(_lifted(s, top), pivots[:1])[:, 0]
        by = np.argsort(near)
        first.annuli(s_ids[by], np.zeros(len(by), int), near[by], s[by])
        low, high = first.reach()
        within = F.element_at(F.array(*map(F.lit, low.tolist())), F.col("pivot") + 1), F.element_at(F.array(*map(F.lit, high.tolist())), F.col("pivot") + 1)
        widest = F.col("dist").between(float(low.min()), float(high.max()))  # what file statistics can tell
        sent = spark.sparkContext.broadcast((keys, q_ids, q, first.bound))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, q_ids, q, bound = sent.value
            task = Searcher(q_ids, q, pivots, top, bound, k)
            for ids, pivot, dist, x in _gathered(batches, width):
                task.annuli(ids, pivot, dist, x)
            at, ids, score, own = task.kept
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(ids), pa.array(score), pa.array(own)], ["a", "b", "vec_id", "score", "own"])

        found = index.filter(widest & F.col("dist").between(*within)).mapInArrow(tidied(search), "a bigint, b bigint, vec_id bigint, score bigint, own bigint")
        if len(blocks) > 1:
            found = store(found)
            sent.destroy()
        parts.append(found)
    if not parts:
        return nothing
    of_query = Window.partitionBy("a", "b")
    order = of_query.orderBy(F.desc("score"), "vec_id", F.desc("own"))
    merged = reduce(DataFrame.unionAll, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    # the query's own row is the first of its equals; those behind it move up
    place = F.min(F.when(F.col("own") == 1, F.col("rank"))).over(of_query)
    merged = merged.withColumn("place", F.coalesce(place, F.lit(k + 2))).filter(F.col("rank") != F.col("place"))
    merged = merged.withColumn("rank", F.col("rank") - (F.col("rank") > F.col("place")).cast("int")).filter(F.col("rank") <= k)
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("row.a").alias("a"), F.col("row.b").alias("b"))
    return each.join(merged, ["a", "b"]).select("query_id", "rank", "vec_id", "score")


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, pivots, distances and vectors of about GATHERED rows at a time."""
    held, n = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held))

    for batch in batches:
        if len(batch):
            ids, pivot, dist = (batch.column(j).to_numpy(zero_copy_only=False) for j in (0, 2, 3))
            held.append((ids, pivot, dist, _matrix(batch.column(1), width)))
            n += len(ids)
            if n >= GATHERED:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _nearest(pivots: np.ndarray, width: int):
    """Distinct query rows with the pivot they are nearest to, so that a block's queries look for the same annuli."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, v = batch.columns
            longest = max(width, max((x or 0 for x in v.value_lengths().to_pylist()), default=0))
            x = _matrix(v, longest)[:, :width]
            near = _distances(np.hstack((x, np.zeros((len(x), 1)))), pivots).argmin(1).astype(np.int32)
            a, b = row.field(0), row.field(1)
            yield pa.RecordBatch.from_arrays([a, b, ids, v, pa.array(near), pa.array(b.to_numpy(zero_copy_only=False) & 0xFFFF)], ["a", "b", "vec_id", "v", "pivot", "block_key"])

    return run


def _blocks(kinds: DataFrame) -> list:
    """Filters of blocks of at most about QUERY_BLOCK queries: pivots that are neighbours together, a pivot of very many queries in parts by hash."""
    counts = {r[0]: r[1] for r in kinds.groupBy("pivot").count().collect()}  # one row a pivot
    found, now, n = [], [], 0
    for pivot, many in sorted(counts.items()):
        if many > QUERY_BLOCK:
            parts = 2 * (many // QUERY_BLOCK) + 1
            found += [(F.col("pivot") == pivot) & (F.col("block_key") % parts == i) for i in range(parts)]
            continue
        if now and n + many > QUERY_BLOCK:
            found.append(F.col("pivot").isin(now))
            now, n = [], 0
        now, n = [*now, pivot], n + many
    return found + ([F.col("pivot").isin(now)] if now else [])
