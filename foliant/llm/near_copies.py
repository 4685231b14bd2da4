"""Near copies: documents whose sets of word runs have a Jaccard similarity of at least `similarity`, all of them.

SimHash distances of such pairs spread too far for a bit budget to hold them all, so sets are joined exactly (by 64-bit hashes
of their shingles). Documents of one set are one class. Of each class the shingles of smallest hash are dealt by
hash: a pair above the threshold shares at least `_spare` of those, so classes that share fewer leave here.
The rest order their shingles from rare to frequent; a pair must share one of the few rarest, so a passage that very many
documents hold joins them only where it is most of their text. What such shingles join is a candidate group; it
goes to one task as its texts, and a breadth-first walk with exact counts of common shingles finds its components: a document
that is reached is not compared again, and no table of pairs is made.

A group of more than `GROUP` shingles is dealt to several tasks by hash. Most of its members turn up in one component there; the others then visit
every part of the group, in blocks, so that no pair but those within the largest component is left out, and no task holds more than a part and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, row_key, small_batches, store, text_blocks, tidied, word_bounds, word_hashes
from .simhash import components, keep_rows

_U = np.uint64
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


#: Shingles of a group, or of the documents that visit its parts, that a task holds, about.
GROUP = 1 << 20


def _common(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that a set of n shares with any set as similar as that, at least."""
    return np.ceil(n * similarity - 1e-9).astype(np.int64)


def _spare(n: np.ndarray) -> np.ndarray:
    """Shared shingles that are asked for among the smallest hashes."""
    return n // 10 + 1


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct runs of `width` words, ascending, and where each document's begin (one entry more). A shorter text is one run; A-Z are lower-cased."""
    low = _LOW[buf]
    starts, ends, bounds = word_bounds(low, offs)
    words, n = word_hashes(low, starts, ends), np.diff(bounds)
    many = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    doc = np.repeat(np.arange(len(n)), many)
    at = bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    long = np.minimum(n[doc], width)
    h = long.astype(np.uint64)
    for k in range(width):
        h = np.where(k < long, mix64(h * _U(0x9E3779B97F4A7C15) + words[np.minimum(at + k, max(len(words) - 1, 0))]), h) if len(words) else h
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_keys(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """64 bits that tell sets apart; 0 for the empty one."""
    n = np.diff(cuts)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        out[full] = mix64(np.add.reduceat(mix64(h ^ _U(0xA24BAED4963EE407)), cuts[:-1][full], dtype=np.uint64) + n[full].astype(np.uint64))
    return out


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()], list(columns))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, cls) rows in order to (h, cls, classes that hold h), each once, for h of two classes or more. What is held is the classes of one h."""
    now, parts = 0, []  # an h whose classes may go on in the next batch

    def held() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = sum(map(len, parts))
        if n > 1:
            for c in parts:
                yield np.full(len(c), now), c, np.full(len(c), n)

    for batch in batches:
        h, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if not len(h):
            continue
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        new[0] = not (parts and h[0] == now and c[0] == parts[-1][-1])
        h, c = h[new], c[new]
        if not len(h):
            continue
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        if h[0] != now or not parts:
            yield from held()
            now, parts = h[0], []
        parts.append(c[: first[1]] if len(first) > 1 else c)
        if len(first) > 1:
            yield from held()
            size = np.diff(first)[1:]
            df = np.repeat(size, size)
            mid, more = slice(first[1], first[-1]), df > 1
            if more.any():
                yield h[mid][more], c[mid][more], df[more]
            now, parts = h[first[-1]], [c[first[-1] :]]
    yield from held()


def linked(h: np.ndarray, cuts: np.ndarray, similarity: float) -> np.ndarray:
    """For each set the first set of its component, over all pairs at least that similar."""
    m, n = len(cuts) - 1, np.diff(cuts)
    _, ids, often = np.unique(h, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    order = np.lexsort((ids, often[ids], owner))
    rare = ids[order]
    head = np.arange(len(h)) - cuts[:-1][owner] <= (n - _common(n, similarity))[owner]
    tok, who = rare[head], owner[head]
    first = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=m))))
    by = np.argsort(tok, kind="stable")
    post, starts = who[by], np.concatenate(([0], np.cumsum(np.bincount(tok, minlength=len(often)))))
    root, mark = np.full(m, -1), np.zeros(len(often), bool)
    for seed in range(m):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            a = queue.pop()
            mine = tok[first[a] : first[a + 1]]
            near = np.unique(np.concatenate([post[starts[t] : starts[t + 1]] for t in mine.tolist()])) if len(mine) else np.zeros(0, int)
            near = near[root[near] < 0]
            near = near[np.minimum(n[near], n[a]) >= similarity * np.maximum(n[near], n[a]) - 1e-9]
            if not len(near):
                continue
            mark[ids[cuts[a] : cuts[a + 1]]] = True
            for b in np.array_split(near, -(-len(near) // 1024)):
                at = np.repeat(cuts[b] - np.cumsum(n[b]) + n[b], n[b]) + np.arange(n[b].sum())
                inter = np.add.reduceat(mark[ids[at]], np.cumsum(n[b]) - n[b], dtype=np.int64)
                good = b[inter >= similarity * (n[a] + n[b] - inter) - 1e-9]
                root[good] = seed
                queue += good.tolist()
            mark[ids[cuts[a] : cuts[a + 1]]] = False
    return root


def _sets_of(batch_text: pa.Array, ids: list[pa.Array], width: int):
    for (key,), buf, offs in text_blocks(ids, batch_text):
        h, cuts = shingle_sets(buf, offs, width)
        yield key, h, cuts


#: One of so many texts tells which shingles are frequent; only the work depends on it.
_TAKEN = 16


def shared(texts: DataFrame, shingles) -> DataFrame:
    """h, fp, df: the shingles that `shingles` finds in texts (rows h, fp), each once a class, with the number of classes that hold it, for those of two classes or more.

    Classes of one shingle meet in one task. Shingles of more than about `GROUP` classes don't: they are counted where they are read, and so are a few beside the others.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, df in _shared(batches):
            yield _batch(h=h, fp=c, df=df)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("h").sortWithinPartitions("h", "fp").mapInArrow(tidied(held), "h bigint, fp bigint, df bigint")

    kind = "h bigint, fp bigint"
    rows = texts.mapInArrow(shingles, kind)
    taken = texts.filter(F.pmod(F.xxhash64("text"), F.lit(_TAKEN)) == 0).mapInArrow(shingles, kind)
    hot = store(taken.groupBy("h").count().filter(F.col("count") > GROUP // _TAKEN).select("h"))
    if hot.isEmpty():
        return dealt(rows)
    many = store(rows.join(hot, "h", "left_semi").distinct())
    often = many.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    return dealt(rows.join(hot, "h", "left_anti")).unionByName(many.join(often, "h").select("h", "fp", "df"))


def confirmed(texts: DataFrame, groups: DataFrame, sizes: DataFrame, width: int, similarity: float) -> DataFrame:
    """node, root: links that join what full sets join inside of candidate groups.

    texts: fp, text, one row a class; groups: node, root, for all classes that a candidate links but roots; sizes: fp, size. Every pair of a group that is similar enough is
    joined, if by others, whether it was a candidate or not.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(fps: list[np.ndarray], hs: list[np.ndarray]) -> pa.RecordBatch:
            fp, one = np.unique(np.array(fps, np.int64), return_index=True)
            sets = [hs[i] for i in one.tolist()]
            root = linked(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))), similarity)
            tied = np.flatnonzero(root != np.arange(len(fp)))
            return _batch(node=fp[tied], root=fp[root[tied]])

        now, fps, hs = None, [], []
        for batch in batches:  # in the order of groups, which may go on in the next batch
            at = 0
            roots = batch.column(0).to_numpy(zero_copy_only=False)
            for fp, h, cuts in _sets_of(batch.column(2), [batch.column(1)], width):
                for i, f in enumerate(fp.to_pylist()):
                    if roots[at] != now:
                        if fps:
                            yield group(fps, hs)
                        now, fps, hs = roots[at], [], []
                    fps.append(f)
                    hs.append(h[cuts[i] : cuts[i + 1]].copy())
                    at += 1
        if fps:
            yield group(fps, hs)

    both = groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct().join(sizes.select(F.col("fp").alias("node"), "size"), "node")
    parts = both.groupBy("root").agg(F.ceil(F.sum("size") / GROUP).alias("parts"))
    member = store(both.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))

    def walked(dealt: DataFrame) -> DataFrame:
        """dealt: node, g. Links of all the documents that meet in a group g; two groups of one hash only meet for nothing."""
        rows = texts.join(dealt, texts["fp"] == dealt["node"]).select("g", "fp", "text").repartition("g").sortWithinPartitions("g")
        return store(rows.mapInArrow(tidied(walk), "node bigint, root bigint"))

    tied = walked(member.select("node", F.xxhash64("root", "part").alias("g")))
    large = member.filter("parts > 1")
    if not large.isEmpty():
        of = large.join(tied.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        most = of.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
        of = store(of.join(most, "root"))
        guests = of.filter("label <> most")
        blocks = guests.groupBy("root").agg(F.ceil(F.sum("size") / GROUP).alias("blocks"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        stay = of.join(blocks, "root").withColumn("block", every("blocks"))
        visit = guests.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).drop("part").withColumn("part", every("parts"))
        meet = [x.select("node", F.xxhash64("root", "part", "block").alias("g")) for x in (stay, visit)]
        links = tied.unionByName(walked(meet[0].unionByName(meet[1]).distinct()))
        tied = components(links, "node", "root")
    return tied


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows, one of each component of near copies: the one of the smallest id (null last), then of the smallest hash of its text; of rows equal in both, the one of the smallest hash of all columns.

    Null, empty and wordless texts are one component. A text of fewer than `width` words is near to its equals only.
    Other columns stay, whatever their names. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    who = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row"))
    keyed = docs.select(who.alias("doc_id"), F.col(text).alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, h, cuts in _sets_of(batch.column(1), [batch.column(0)], width):
                yield pa.RecordBatch.from_arrays([ids, pa.array(set_keys(h, cuts).view(np.int64)), pa.array(np.diff(cuts))], ["doc_id", "fp", "size"])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, cuts in _sets_of(batch.column(0), [batch.column(0)], width):
                n = np.diff(cuts)
                key, one = np.unique(set_keys(h, cuts), return_index=True)
                take = np.where(n > 0, n - _common(n, similarity) + _spare(n), 0)[one]
                at = np.repeat(cuts[:-1][one] - np.cumsum(take) + take, take) + np.arange(take.sum())
                yield _batch(h=h[at], fp=np.repeat(key, take))

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, h, cuts in _sets_of(batch.column(1), [batch.column(0)], width):
                yield _batch(h=h, fp=np.repeat(fp.to_numpy(zero_copy_only=False), np.diff(cuts)))

    prints = store(keyed.mapInArrow(tidied(keys), f"doc_id {kind}, fp bigint, size bigint"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"))
    counts = shared(docs.select(F.col(text).alias("text")), tidied(smallest)).groupBy("fp").agg(F.count("*").alias("n"))
    common = F.ceil(F.col("size") * F.lit(float(similarity)) - F.lit(1e-9))
    left = store(least.join(counts, "fp").filter(F.col("n") >= F.floor(common / 10) + 1).select("fp", "size", "least"))
    texts = store(keyed.join(left, (F.col("doc_id.row") == F.col("least.row")) & F.col("doc_id.id").eqNullSafe(F.col("least.id"))).select("fp", "text"))
    often = shared(texts, tidied(all_of))
    mine = Window.partitionBy("fp")
    # shingles of one class alone are the rarest
    ranked = often.withColumns({"_at": F.row_number().over(mine.orderBy("df", "h")), "_n": F.count("*").over(mine)}).join(left.select("fp", "size"), "fp")
    rare = store(ranked.filter(F.col("size") - F.col("_n") + F.col("_at") <= F.col("size") - common + 1).select("h", "fp"))
    to = rare.groupBy("h").agg(F.min("fp").alias("to"))
    groups = components(rare.join(to, "h").filter("fp <> to").select("fp", "to"))
    tied = confirmed(texts, groups, left.select("fp", "size"), width, similarity)
    named = least.join(tied, least["fp"] == tied["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    return keep_rows(docs, named.select("least.id", "least.row"), doc_id, text)
