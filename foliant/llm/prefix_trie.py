"""Prefix trie of conversations, summed along heavy paths.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits: every turn is hashed with its place, and a prefix is the exclusive or of its turns,
so all prefixes of all conversations are one running value over the rows in order, and a node is a group of rows.

Of a node's children the one that most conversations go through is heavy; a chain of heavy children is a path. Any other child has at most half of its parent's conversations, so
the paths that hang from a path have a smaller binary logarithm than it: in as many rounds as there are such logarithms, from the smallest on, each path's total is put to the
node that it hangs from. With what hangs from it each node then has a value of its own, and what its subtree sums to is the suffix sum along its path.

No group is held by a task: numbers, prefixes and path sums are running values over ranges of the rows (`operators.order`), so one conversation, one turn or one path may be any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import Laid, lay, running
from .common import look_up, store, tidied

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"

def ordered(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0), a, b, chars for each row: its place in its conversation, 128 bits of role and text, and the text's code points.

    Rows are ordered by turn (null first), then role, then text; a null role or text is empty. Repeated rows are turns each. Rows without a conversation's id are left out, and so are other columns.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = chats.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "role", "text"), "chars": F.length("text").cast("long")})
    begin = (F.substring("role", 1, 16), F.substring("text", 1, 16))  # sampled for the ranges; inside of them whole texts are compared
    laid = lay(rows, "conv_id", "turn", *begin, within=("conv_id", "turn", "role", "text"), keep=store)
    laid.rows = laid.rows.drop("turn", "role", "text")  # the order is told by part and at
    placed = running(laid, ["conv_id"], {"place": ("sum", F.lit(1).cast("long"))}).rows
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "a", "b", "chars")


def grafted(turns: DataFrame, group: int = 100, choices: int = 6) -> DataFrame:
    """turns (as `ordered` gives them) with the first h turns of conversation c - c % group in place of the first h of each conversation c, for h = crc32(c) % choices; adds own, 0 for turns of the other conversation. Places keep their order."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % choices
    convs = turns.filter("place = 0").select(F.col("conv_id").alias("to"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("conv_id"))
    starts = turns.filter((F.col("place") < choices - 1) & (F.col("conv_id") % group == 0))
    first = starts.join(convs, "conv_id").filter("place < h").select(F.col("to").alias("conv_id"), F.lit(0).alias("own"), "place", "a", "b", "chars")
    return first.unionByName(turns.filter(F.col("place") >= h).select("conv_id", F.lit(1).alias("own"), "place", "a", "b", "chars"))


def trie(turns: DataFrame, convs: DataFrame, order: tuple[str, ...] = ("place",)) -> DataFrame:
    """The nodes of the prefix trie of `turns` (conv_id, a, b, chars and the columns of `order`), over all conversations of `convs` (conv_id, distinct): those without turns are members of the root.

    conv_id (the smallest member), depth, parent_conv_id (of the parent; null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (sum over the subtree of
    n_convs - 1 times the code points of a node's last text), ends_sha256 (of the ids of conversations that end there, ascending, joined by commas). A node's own subtree includes it. Ids are not null. Without conversations there is no node.
    """
    spark = turns.sparkSession
    root = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODES)
    least, key = F.lit(root["least"]).cast("long"), ["depth", "k1", "k2"]

    laid = lay(turns.select("conv_id", *order, "a", "b", "chars"), "conv_id", *order, keep=store)
    placed = running(laid, ["conv_id"], {"depth": ("sum", F.lit(1).cast("long"))})
    coded = placed.rows.select("conv_id", "depth", "chars", F.xxhash64(F.lit(1), "depth", "a", "b").alias("c1"), F.xxhash64(F.lit(2), "depth", "a", "b").alias("c2"), laid.part, laid.at)
    coded = Laid(coded, laid.part, laid.at, coded.columns, store)
    rows = running(coded, ["conv_id"], {"k1": ("xor", F.col("c1")), "k2": ("xor", F.col("c2"))}).rows

    found = rows.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.first("c1").alias("c1"), F.first("c2").alias("c2"), F.first("chars").alias("chars"))
    found = store(found)
    best = F.max_by(F.struct("k1", "k2"), F.struct("n_convs", -F.col("rep"))).alias("best")
    kids = store(found.groupBy((F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("c1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("c2")).alias("k2")).agg(F.count("*").alias("n_children"), best))
    # a node's own values, the number of its children, and whether it is its parent's heavy child, put together by its key
    none = F.lit(None).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    said = found.select(*key, "rep", "n_convs", "chars", zero.alias("n_children"), zero.alias("heavy"))
    said = said.unionAll(kids.select(*key, none, none, none, "n_children", zero)).unionAll(kids.select(F.col("depth") + 1, "best.k1", "best.k2", none, none, none, zero, one))
    nodes = said.groupBy(*key).agg(*(F.max(c).alias(c) for c in ("rep", "n_convs", "chars", "n_children", "heavy"))).filter("rep is not null")
    nodes = store(nodes)

    # every row learns its node's representative; along a conversation the last child that isn't heavy begins the path, and the row before is the parent
    met = store(look_up(rows.select("conv_id", *key, laid.part, laid.at), nodes, key, "n_convs").drop("k1", "k2"))
    met = Laid(met, laid.part, laid.at, met.columns, store)
    begun = F.when(F.col("heavy") == 0, F.struct(F.col("depth").alias("d"), F.col("rep").alias("c")))
    of_path = running(met, ["conv_id"], {"head": ("last", begun), "up": ("last", F.col("rep"))}, before=("up",)).rows.filter("conv_id = rep")
    top_kids = kids.filter("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"))
    head = F.coalesce("head", F.struct(F.lit(0).cast("long").alias("d"), least.alias("c")))
    value = [F.col("n_convs"), F.col("n_children"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")]
    each = of_path.select("conv_id", "depth", F.coalesce("up", least).alias("up"), head["c"].alias("hc"), head["d"].alias("hd"), *value)
    top = top_kids.withColumns({"n_convs": F.lit(root["n"]).cast("long"), "chars": zero}).select(least.alias("conv_id"), zero.alias("depth"), none.alias("up"), least.alias("hc"), zero.alias("hd"), *value)
    each = store(each.unionByName(top))

    # what hangs from a node stands before it in its path, so that the node's own sum holds it
    hung = _hung(each)
    laid = each.withColumns({"from_end": -F.col("depth"), "own": F.lit(1)})
    laid = laid.unionByName(hung.withColumns({"from_end": -F.col("depth"), "own": F.lit(0)}), allowMissingColumns=True) if hung is not None else laid
    path = lay(laid, "hc", "hd", "from_end", "own", keep=store)
    summed = running(path, ["hc", "hd"], {"n_leaves": ("sum", F.col("leaves")), "saved_tokens": ("sum", F.col("saved"))}).rows.filter("own = 1")

    last = met.rows.select("conv_id", F.struct("depth", "rep").alias("x")).unionByName(convs.select("conv_id", F.struct(zero.alias("depth"), least.alias("rep")).alias("x")))
    last = last.groupBy("conv_id").agg(F.max("x").alias("x")).select("conv_id", "x.rep", "x.depth")
    told = summed.join(_ends(last).withColumnRenamed("rep", "conv_id"), ["conv_id", "depth"], "left")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return told.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def _hung(each: DataFrame) -> DataFrame | None:
    """conv_id, depth, hc, hd, leaves, saved: what hangs from a node by light children of one size, their paths summed up; None where nothing does. hc, hd is the node's own path."""
    top = F.col("depth") == F.col("hd")
    paths = each.groupBy("hc", "hd").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(top, F.col("up"))).alias("up"), F.max(F.when(top, F.col("n_convs"))).alias("n"))
    paths = store(paths.withColumn("level", F.length(F.bin("n"))))
    levels = sorted(r[0] for r in paths.select("level").distinct().collect())[:-1]  # 63 at most; the last is the root's path alone
    # each path learns the path that it hangs from, and that one's level
    feet = each.filter("n_children > 1").select(F.col("conv_id").alias("up"), F.col("depth").alias("at"), F.col("hc").alias("pc"), F.col("hd").alias("pd"), "n_children")
    tied = look_up(paths.filter("up is not null").withColumn("at", F.col("hd") - 1), store(feet), ["up", "at"], "n_children")
    tied = store(tied.select("hc", "hd", "leaves", "saved", "level", "up", "at", "pc", "pd"))
    gifts: list[DataFrame] = []
    none = F.lit(None).cast("long")
    for level in levels:
        total = tied.filter(F.col("level") == level).drop("level")
        for gift in gifts:  # of levels below; those for paths of this level count
            total = total.unionAll(gift.select("hc", "hd", "leaves", "saved", none, none, none, none))
        if gifts:
            total = total.groupBy("hc", "hd").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *(F.max(c).alias(c) for c in ("up", "at", "pc", "pd"))).filter("up is not null")
        given = total.groupBy("up", "at", "pc", "pd").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        gifts.append(store(given.select(F.col("up").alias("conv_id"), F.col("at").alias("depth"), F.col("pc").alias("hc"), F.col("pd").alias("hd"), "leaves", "saved")))
    return reduce(DataFrame.unionAll, gifts) if gifts else None


def _ends(last: DataFrame) -> DataFrame:
    """last (conv_id, rep, depth) to rep, depth, ends_sha256. Ids are joined to texts a batch long where they lie in order; a digest takes them one after the other, so a node's texts go through one task, which holds one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, rep, depth = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.concatenate(([True], (rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1]))))
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(conv)))]
            yield pa.RecordBatch.from_arrays([pa.array(rep[cuts]), pa.array(depth[cuts]), pa.array(conv[cuts]), pa.array(text, pa.string())], ["rep", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["rep", "depth", "ends_sha256"])

        for batch in batches:
            for rep, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if now == (rep, depth):
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (rep, depth), hashlib.sha256(ids.encode())
            if len(out) > 4096:
                yield batch_of()
                out = []
        if now:
            out.append((*now, sha.hexdigest()))
        if out:
            yield batch_of()

    texts = last.select("conv_id", "rep", "depth").repartitionByRange("rep", "depth", "conv_id").sortWithinPartitions("rep", "depth", "conv_id").mapInArrow(tidied(join), "rep bigint, depth bigint, first bigint, ids string")
    return texts.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(tidied(digest), "rep bigint, depth bigint, ends_sha256 string")
