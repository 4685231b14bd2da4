"""Mixing sources to target weights [native]: pivotal dependent rounding over a reduction tree.

Every document of a source should be taken target / source size times. The whole part of that number
is taken as it is; the fraction is a copy probability. Two documents with fractions are paired and
move words from one to the other, the direction drawn so that no expectation changes, until one of
them is integral; the other goes on. The sum of expected words never changes, so a source misses its
target by no more than the last document that is left over.

Documents are dealt to nodes of a bounded number of documents, by source, size class and hash. Each node is
reduced within one row; what is left over of some dozens of nodes meets in a node of the next level. One node of
every size class is held back for the root, which works from large documents to small ones: the last one left is small. There draws are turned round, and a pair exchanged, where that brings the source nearer to its target.
A hot source only has more nodes; no task ever holds a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

#: Documents in a node of the tree, about.
FANOUT = 48
#: Weights that sources get in turn, by code point.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) gets weight, target: `share` of all sizes by weight, none above `at_most` times its size.

    What is above a source's limit goes to the others by weight, until none is above. In the order of
    limit / weight the capped sources come first, so one pass of running sums finds the level.
    Works on one row a source. An empty source has target 0.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * at_most
    by_level = Window.partitionBy(F.lit(0)).orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_level.rowsBetween(Window.unboundedPreceding, -1)
    free = F.sum(F.col("source_size")).over(every) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("_level", free / open_weight).withColumn("_limit", limit)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct((F.col("_limit") / F.col("weight")).alias("a"), F.col("_level").alias("level")))).over(Window.partitionBy(F.lit(0)))
    return w.withColumn("target", F.least("_limit", F.coalesce(level["level"] * F.col("weight"), F.col("_limit")))).select("source", "source_size", "weight", "target")


def _uniform(*cols) -> Column:
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


_ITEM = "struct<h:bigint,doc_id:{id},size:bigint,p:double,m:bigint,w:bigint>"
_DONE = "struct<doc_id:{id},size:bigint,m:bigint,w:bigint,took:bigint>"


def _reduce(df: DataFrame, id_type: str, seed: int) -> DataFrame:
    """Rows of one document each (source, node, it) to one row a node: left (one document), done (settled ones, w final)."""
    item, done = _ITEM.format(id=id_type), _DONE.format(id=id_type)

    def settle(it: Column, take) -> Column:
        return F.array(F.struct(it.doc_id, it["size"], it.m, (it.w + take).alias("w"), take).cast(done))

    def left(it: Column, p: Column) -> Column:
        return F.struct(it.h, it.doc_id, it["size"], F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"), it.m, it.w).cast(item)

    def step(acc: Column, x: Column) -> Column:
        c, out = acc["left"], acc["done"]
        rise, fall = F.least((1 - c.p) * c["size"], x.p * x["size"]), F.least(c.p * c["size"], (1 - x.p) * x["size"])
        up = _uniform(F.lit(seed), c.h, x.h) * (rise + fall) <= fall
        c_ends = F.when(up, (1 - c.p) * c["size"] <= x.p * x["size"]).otherwise(c.p * c["size"] <= (1 - x.p) * x["size"])
        moved = F.when(up, rise).otherwise(-fall)
        goes_on = F.when(c_ends, left(x, x.p - moved / x["size"])).otherwise(left(c, c.p + moved / c["size"]))
        ended = F.when(c_ends, settle(c, F.when(up, 1).otherwise(0))).otherwise(settle(x, F.when(up, 0).otherwise(1)))
        return F.struct(goes_on.alias("left"), F.concat(out, ended).alias("done"))

    rows = F.array_sort(F.collect_list(F.struct((-F.col("it.size")).alias("a"), F.col("it.h").alias("b"), F.col("it"))))
    nodes = df.groupBy("source", "node").agg(F.transform(rows, lambda r: r.it).alias("items"))
    start = F.struct(F.element_at("items", 1).cast(item).alias("left"), F.array().cast(f"array<{done}>").alias("done"))
    return nodes.select("source", "node", F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, step).alias("r")).select("source", "node", "r.left", "r.done")


def _even_out(root: DataFrame, id_type: str, seed: int) -> DataFrame:
    """source, d: the root's documents, all settled.

    The last one is drawn, and then, from large to small, a document's draw is turned round wherever that brings the source's words nearer to
    the target; at the end the one pair of a taken and another document is exchanged that brings them nearest, if any does.
    """
    done, last = _DONE.format(id=id_type), F.col("left")
    drawn = F.when(_uniform(last.h, F.lit(seed)) < last.p, 1).otherwise(0)
    end = F.struct(last.doc_id, last["size"], last.m, last.w + drawn, drawn).cast(done)

    def turned(x: Column) -> Column:
        turn = 1 - 2 * x.took
        return F.struct(x.doc_id, x["size"], x.m, x.w + turn, x.took + turn).cast(done)

    def step(acc: Column, x: Column) -> Column:
        off = acc["off"] + (1 - 2 * x.took) * x["size"]
        better = F.abs(off) < F.abs(acc["off"])
        return F.struct(F.when(better, off).otherwise(acc["off"]).alias("off"), F.concat(acc["done"], F.array(F.when(better, turned(x)).otherwise(x))).alias("done"))

    by_size = F.transform(F.array_sort(F.transform(F.concat("done", F.array(end)), lambda x: F.struct((-x["size"]).alias("a"), x.alias("x")))), lambda s: s.x)
    state = F.aggregate(by_size, F.struct(((drawn - last.p) * last["size"]).alias("off"), F.array().cast(f"array<{done}>").alias("done")), step)
    rows = root.select("source", state.alias("s")).select("source", "s.off", "s.done")
    places = F.sequence(F.lit(0), F.size("done") - 1)
    of = lambda took: F.filter(places, lambda i: F.get("done", i).took == took)
    size = lambda i: F.get("done", i)["size"]
    pairs = F.transform(F.col("taken"), lambda i: F.array_min(F.transform(F.col("others"), lambda j: F.struct(F.abs(F.col("off") + size(j) - size(i)).alias("off"), i.alias("i"), j.alias("j")))))
    rows = rows.withColumns({"taken": of(1), "others": of(0)}).withColumn("best", F.array_min(pairs))
    swap = F.coalesce(F.col("best.off") < F.abs("off"), F.lit(False))
    settled = F.transform("done", lambda x, n: F.when(swap & ((n == F.col("best.i")) | (n == F.col("best.j"))), turned(x)).otherwise(x))
    return rows.select("source", F.explode(settled).alias("d"))


def plan_mix(docs: DataFrame, seed: int = 7, text: str = "text", **targets) -> DataFrame:
    """One row a document row: doc_id, source, size, source_size, target, copies, taken (copies * size).

    Null and empty texts have size 0 and are taken as often as the whole part of their share says. Rows
    without a source are a source of their own, the last. Null ids are allowed; other columns are left out; an empty table gives an empty one. Rows equal in doc_id, source and size are counted before they
    are dealt, and settle together: as many of them take one more copy as their common share says. The
    draws hash doc_id, source and size, so reruns agree. A document is taken at most `at_most` times, rounded up.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", word_count(F.col(text)).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("m"))
    rows = cut(rows)
    goal = cut(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), **targets))
    kind = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    share = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    goal_of = goal.select(F.col("source").alias("_source"), "source_size", "target", share.alias("share"))
    part = rows.join(goal_of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("kind", kind)
    more = F.col("m") * (F.col("share") - F.floor("share"))
    part = part.withColumns({"w": F.floor(more), "p": F.when(F.col("size") > 0, more - F.floor(more)).otherwise(0.0), "h": F.xxhash64("doc_id", "source", "size", F.lit(seed))})
    open_ = part.filter("p > 0")
    cells = open_.groupBy("source", "kind").agg(F.ceil(F.count("*") / FANOUT).alias("nodes")).select(F.col("source").alias("_s"), F.col("kind").alias("_k"), "nodes")
    dealt = open_.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k")))
    it = F.struct("h", "doc_id", "size", "p", "m", "w").cast(_ITEM.format(id=id_type)).alias("it")
    dealt = cut(dealt.select("source", F.pmod(F.xxhash64("h"), F.col("nodes")).alias("slot"), F.xxhash64("kind", F.pmod(F.xxhash64("h"), F.col("nodes"))).alias("node"), it))
    held, level, settled = dealt.filter("slot = 0").drop("slot"), dealt.filter("slot > 0").drop("slot"), []
    while True:  # each round leaves one document of FANOUT; the count is of one row a source
        most = level.groupBy("source").agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 0
        if not most:
            break
        level = cut(_reduce(level, id_type, seed))
        settled.append(level)
        width = max(1, most // FANOUT)
        level = level.select("source", F.pmod(F.xxhash64("node", F.lit(most)), F.lit(width)).alias("node"), F.col("left").alias("it"))
        if most <= FANOUT:
            break
    root = _reduce(held.unionByName(level).withColumn("node", F.lit(0)), id_type, seed)
    ends = [x.select("source", F.explode("done").alias("d")) for x in settled] + [_even_out(root, id_type, seed)]
    done = reduce(DataFrame.unionAll, ends).select("source", "d.doc_id", "d.size", "d.m", "d.w").unionByName(part.filter("p <= 0").select("source", "doc_id", "size", "m", "w"))
    each = _singly(done.join(goal_of, F.col("source").eqNullSafe(F.col("_source"))))
    copies = (F.floor("share") + F.when(F.col("i") <= F.col("w"), 1).otherwise(0)).cast("long")
    return each.withColumn("copies", copies).select("doc_id", "source", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "i")


#: Repeats of a row that one array counts at most.
_REPEATS = 4096


def _singly(rows: DataFrame) -> DataFrame:
    """A row of m repeats becomes m rows, i from 1; very many repeats are dealt out in parts before they are counted."""
    count = lambda a, b: F.explode(F.sequence(a, b))
    few = rows.filter(F.col("m") <= _REPEATS).withColumn("i", count(F.lit(1).cast("long"), F.col("m")))
    parts = rows.filter(F.col("m") > _REPEATS).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"), F.lit(_REPEATS).cast("long"))))
    many = parts.repartition("doc_id", "from").withColumn("i", count(F.col("from"), F.least(F.col("m"), F.col("from") + _REPEATS - 1)))
    return few.unionByName(many.drop("from"))


def mix(docs: DataFrame, seed: int = 7, text: str = "text", **targets) -> DataFrame:
    """The documents that the mix takes, whole rows with `copies` (at least 1; a column of that name is replaced).

    Null and empty texts have size 0 and are taken as often as the whole part of their source's share says; so not at all from a source of less than 1.
    Null sources and ids are values like others. Of rows equal in id, source and size, those of the smaller hash of the text are taken more often.
    Other columns stay, whatever their names. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c.lower() != "copies"]
    plan = cut(plan_mix(docs, seed, text, **targets).filter("copies > 0").select("doc_id", "source", "size", "i", "copies"))
    rows = docs.select(F.struct(*kept).alias("rest"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), word_count(F.col(text)).alias("own_size"), F.xxhash64(F.col(text)).alias("hash"))
    on = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("source").eqNullSafe(F.col("own_source")) & (F.col("size") == F.col("own_size"))
    if not plan.filter("i > 1").isEmpty():  # rows equal in id, source and size: which of them is which
        one_of = Window.partitionBy("own_id", "own_source", "own_size").orderBy("hash")
        rows = rows.withColumn("own_i", F.row_number().over(one_of))
        on &= F.col("own_i") == F.col("i")
    return rows.join(plan, on).select("rest.*", "copies")
