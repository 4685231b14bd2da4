"""SimHash near-dedup: a binary trie joined with itself.

Fingerprints are made in Arrow batches. Two of them that differ in at most `max_bits` of 64 bits agree in at least
`blocks - max_bits` of `blocks` bit blocks, so for every choice of that many blocks the distinct fingerprints are dealt
by those blocks' bits. Written with the chosen blocks first and sorted, each group is a subtree of a binary trie.
A group of very many fingerprints is dealt again by blocks of the bits that are left, so no group is without a bound.
Node pairs of the trie are walked together, level by level; the bits in which the two sides differ add up, and a pair
goes as soon as its errors exceed the budget. A node pair whose leaves are linked already goes too, and budgets
are spent from small to large, so that a dense group costs no more than its links need. What leaves a task is one
link a fingerprint to its group's root, never all pairs. Components come from rounds of smallest neighbours.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_key, store, text_blocks, tidied

_U = np.uint64


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    """XXH64 of every run of `width` words joined by spaces; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16


def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each range of hashes the bits that more than half of them have; 0 for an empty range."""
    ones = np.zeros((len(bounds) - 1, 64), np.int64)
    for a in range(0, len(hashes), _CHUNK):
        b = min(a + _CHUNK, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        i, j = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, b, "left")
        cuts = np.clip(bounds[i : j + 1], a, b) - a
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        ones[i + full] += np.add.reduceat(bits, cuts[:-1][full], axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(bounds)[:, None], axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long): A-Z are lower-cased, words parted by ASCII whitespace. Null and empty texts have fingerprint 0."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids,), buf, offs in text_blocks([batch.column(0)], batch.column(1)):
                raw, found, n = buf.tobytes(), [], [0]
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    found += shingle_hashes(raw[a:b], width, seed)
                    n.append(len(found))
                fp = _majority(np.array(found, np.uint64), np.array(n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, fp bigint")


def _layout(path: tuple[int, ...], blocks: int, max_bits: int) -> tuple[tuple[int, ...], int]:
    """For choices of blocks that may agree, one after the other: the order of bits (from the top), chosen blocks first, and how many bits those have."""
    order, known = list(range(64)), 0
    for choice in path:
        rest = order[known:]
        edges = np.linspace(0, len(rest), blocks + 1).round().astype(int)
        same = list(itertools.combinations(range(blocks), blocks - max_bits))[choice]
        spans = [rest[a:b] for a, b in itertools.pairwise(edges)]
        chosen = [b for i in same for b in spans[i]]
        order = order[:known] + chosen + [b for i in range(blocks) if i not in same for b in spans[i]]
        known += len(chosen)
    return tuple(order), known


def _path(code: int, choices: int) -> tuple[int, ...]:
    """The choices that a number stands for; 0 for none."""
    found = []
    while code:
        code, digit = divmod(code, choices + 1)
        found.append(digit - 1)
    return tuple(reversed(found))


def _permute(x: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """Bits of x (counted from the top) in another order; runs of neighbouring bits move together."""
    out, at, i = np.zeros_like(x), 0, 0
    while i < 64:
        j = i + 1
        while j < 64 and order[j] == order[j - 1] + 1:
            j += 1
        n = j - i
        part = (x >> _U(64 - order[i] - n)) & _U((1 << n) - 1)
        out |= part << _U(64 - at - n)
        at, i = at + n, j
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The smallest index that each index is linked with, given earlier roots and more links."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = a[open_], b[open_]
    return root


#: Node pairs that a walk holds at a time; what is above waits on a stack.
_FRONT = 1 << 18


def trie_links(values: np.ndarray, depth: int, max_bits: int) -> np.ndarray:
    """values: sorted, distinct 64-bit words. The smallest index in each one's component, over all pairs that share the first `depth` bits and differ in at most `max_bits` bits."""
    n = len(values)
    root = np.arange(n)
    top = values >> _U(64 - depth) if depth else np.zeros(n, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if n else np.zeros(0, int)
    last = np.append(first[1:], n)[: len(first)]
    many = last - first > 1
    first, last = first[many], last[many]
    for budget in range(1, max_bits + 1):
        # the next index whose root differs: a node is uniform if it ends before
        step = np.flatnonzero(root[1:] != root[:-1]) + 1
        stop = np.append(step, n)[np.searchsorted(step, np.arange(n), "right")] if n else step
        zero = np.zeros(len(first), int)
        stack = [(depth, first, last, first, last, zero)]
        found_a, found_b, held = [], [], 0
        while stack:
            at, al, ar, bl, br, err = stack.pop()
            if len(al) > _FRONT:
                half = len(al) // 2
                stack += [(at, *(x[half:] for x in (al, ar, bl, br, err))), (at, *(x[:half] for x in (al, ar, bl, br, err)))]
                continue
            one = (stop[al] >= ar) & (stop[bl] >= br) & (root[al] == root[bl])
            alone = (ar - al == 1) & (br - bl == 1)
            go = ~one & ~alone
            if (pair := alone & ~one & (al != bl)).any():
                i, j = al[pair], bl[pair]
                near = np.bitwise_count(values[i] ^ values[j]) <= budget
                found_a.append(i[near])
                found_b.append(j[near])
                held += int(near.sum())
                if held > _FRONT:
                    root = _roots(n, np.concatenate(found_a), np.concatenate(found_b), root)
                    found_a, found_b, held = [], [], 0
                    step = np.flatnonzero(root[1:] != root[:-1]) + 1
                    stop = np.append(step, n)[np.searchsorted(step, np.arange(n), "right")]
            if at == 64 or not go.any():
                continue
            al, ar, bl, br, err = (x[go] for x in (al, ar, bl, br, err))
            # where bit `at` turns to 1 within each node
            bit = _U(1) << _U(63 - at)
            ma, mb = _middle(values, al, ar, bit), _middle(values, bl, br, bit)
            self_ = al == bl
            kids = [(al, ma, bl, mb, err), (ma, ar, mb, br, err), (al, ma, mb, br, err + 1)]
            parts = [tuple(x[keep] for x in kid) for kid in kids for keep in [(kid[1] > kid[0]) & (kid[3] > kid[2]) & (kid[4] <= budget)]]
            keep = ~self_ & (ar > ma) & (mb > bl) & (err + 1 <= budget)
            parts.append(tuple(x[keep] for x in (ma, ar, bl, mb, err + 1)))
            stack.append((at + 1, *(np.concatenate(x) for x in zip(*parts))))
        if found_a:
            root = _roots(n, np.concatenate(found_a), np.concatenate(found_b), root)
    return root


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index in [lo, hi) whose `bit` is set; the bits above it are one prefix there."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = lo < hi
        if not live.any():
            return lo
        mid = (lo + hi) >> 1
        one = live & ((values[np.minimum(mid, len(values) - 1)] & bit) != 0)
        hi = np.where(one, mid, hi)
        lo = np.where(live & ~one, mid + 1, lo)


#: Fingerprints of a group beyond which it is dealt again, as long as `_LEFT` bits are left; estimated by one of `_TAKEN` fingerprints, and only the work depends on it.
DENSE, _LEFT, _TAKEN = 1 << 18, 16, 16


def fingerprint_links(distinct: DataFrame, max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """distinct (fp) to links (fp, to): enough of them to join what a chain of near fingerprints joins."""
    choices = len(list(itertools.combinations(range(blocks), blocks - max_bits)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(layout, fp) to one row for each choice among the bits that the layout leaves."""
        for batch in batches:
            layout, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for code in np.unique(layout).tolist():
                mine = x[layout == code]
                for k in range(choices):
                    longer = code * (choices + 1) + k + 1
                    order, known = _layout(_path(longer, choices), blocks, max_bits)
                    key = _permute(mine, order) >> _U(64 - known)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), longer)), pa.array(key.view(np.int64)), pa.array(mine.view(np.int64))], ["layout", "key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(code: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            order, known = _layout(_path(code, choices), blocks, max_bits)
            bits = np.sort(_permute(np.concatenate(parts).view(np.uint64), order))
            root = trie_links(bits, known, max_bits)
            tied = np.flatnonzero(root != np.arange(len(bits)))
            back = np.argsort(order).tolist()
            a, b = _permute(bits[tied], back), _permute(bits[root[tied]], back)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["fp", "to"])

        now, last, held = None, None, []  # the layout and key of a group that may go on in the next batch, and its parts
        for batch in batches:  # sorted by layout and key
            layout, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for code in np.unique(layout).tolist():
                keys, mine = key[layout == code], fp[layout == code]
                if code != now:
                    if held:
                        yield links(now, held)
                    now, last, held = code, keys[0], []
                if keys[-1] != last:
                    end = int(np.count_nonzero(keys != keys[-1]))
                    if held or end:
                        yield links(code, [*held, mine[:end]])
                    last, held, mine = keys[-1], [], mine[end:]
                held.append(mine)
        if held:
            yield links(now, held)

    kind, parts = "layout bigint, key bigint, fp bigint", []
    rows = distinct.select(F.lit(0).cast("long").alias("layout"), "fp")
    for depth in itertools.count(1):
        taken = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(_TAKEN)) == 0).mapInArrow(tidied(deal), kind)
        rows = rows.mapInArrow(tidied(deal), kind)
        if 64 - _layout((0,) * depth, blocks, max_bits)[1] <= _LEFT:
            parts.append(rows)
            break
        dense = store(taken.groupBy("layout", "key").count().filter(F.col("count") > DENSE // _TAKEN).select("layout", "key"))
        if dense.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(dense, ["layout", "key"], "left_anti").select("layout", "key", "fp"))
        rows = store(rows.join(dense, ["layout", "key"], "left_semi").select("layout", "fp"))
    dealt = functools.reduce(DataFrame.unionAll, parts)
    return dealt.repartition("layout", "key").sortWithinPartitions("layout", "key").mapInArrow(tidied(join), "fp bigint, to bigint").distinct()


#: Links of a node beyond which it is a hub, at least. Of n links so many go to it as bound the number of hubs.
_HUB, _HUBS = 256, 10_000


def _to_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the least that u is linked with (low: u, m, n). Hubs, of which there are 2 * _HUBS at most, are broadcast, so that no task gets all the links of one."""
    if n > _HUB:
        hubs = cut(low.filter(F.col("n") > max(_HUB, n // _HUBS)).select("u", "m"))
        if not hubs.isEmpty():
            known = F.broadcast(hubs)
            rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
            return edges.join(known, "u").unionByName(rest.join(low.select("u", "m"), "u"))
    return edges.join(low.select("u", "m"), "u")


def components(links: DataFrame, a: str = "fp", b: str = "to") -> DataFrame:
    """links to (node, root): the smallest node that each is linked with. Nodes without links are left out.

    Large-star and small-star by turns, each round one written table: a node with very many neighbours is only the
    smallest label of its group's aggregate, and rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    seen, n = None, edges.count()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _to_least(both.filter("v > u"), low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen, n = tuple(state), state[0]


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, max_bits: int = 4, blocks: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), for every row.

    Rows of one fingerprint are counted once before the join, so exact copies cost nothing there. Null, empty
    and wordless texts share fingerprint 0 and are one component. A null doc_id is larger than any other; a
    component of only such rows has a null component_id. Repeated rows stay. Other columns are left out. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, width, seed, doc_id, text))
    tied = _tied(prints, F.col("doc_id").isNull().alias("none"), max_bits, blocks)
    named = tied.select("fp", F.col("least.id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _tied(prints: DataFrame, none, max_bits: int, blocks: int) -> DataFrame:
    """fp, least: the smallest (none, id) of the rows of every fingerprint that its component holds.

    Nodes of the contraction are these smallest rows themselves, so the component's answer is its root: no component meets in one task.
    """
    least = cut(prints.groupBy("fp").agg(F.min(F.struct(none, F.col("doc_id").alias("id"), "fp")).alias("least")))
    links = fingerprint_links(least, max_bits, blocks)
    u, v = least.select("fp", F.col("least").alias("u")), least.select(F.col("fp").alias("to"), F.col("least").alias("v"))
    root = components(links.join(u, "fp").join(v, "to"), "u", "v")
    return least.join(root, F.col("least") == F.col("node"), "left").select("fp", F.coalesce("root", "least").alias("least"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, max_bits: int = 4, blocks: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows, one of each component: the one of the smallest id (null last), then of the smallest hash of its text; of rows equal in both, the one of the smallest hash of all columns.

    Null, empty and wordless texts are one component. Other columns stay, whatever their names. An empty table gives an empty one.
    """
    who = F.struct(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("row"))
    prints = cut(fingerprints(docs.select(who.alias("doc_id"), F.col(text).alias("text")), width, seed))
    tied = _tied(prints, F.col("doc_id.id").isNull().alias("none"), max_bits, blocks)
    return keep_rows(docs, tied.select("least.id.id", "least.id.row").distinct(), doc_id, text)


def keep_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` that `chosen` (id, row key) names; of rows equal in id and text, the one of the smallest hash of all columns."""
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*docs.columns).alias("rest"), F.col(doc_id).alias("rest_id"), row_key(doc_id, text).alias("rest_row"), F.xxhash64(*hashed).alias("rest_hash"))
    kept = keyed.join(chosen, (F.col("rest_row.a") == F.col("row.a")) & (F.col("rest_row.b") == F.col("row.b")) & F.col("rest_id").eqNullSafe(F.col("id")))
    one_of = Window.partitionBy("row.a", "row.b", "id").orderBy("rest_hash")
    return kept.withColumn("n", F.row_number().over(one_of)).filter("n = 1").select("rest.*")
