"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

An item of m characters that occurs in a text with at most k edits shares at least m - q + 1 - k * q of its q-grams with
it, all within k diagonals (place in the text less place in the item). Every q-gram of every text is looked up
in an index of the items' q-grams; the places that hit are counted by text, item and diagonal band. Bands are 2k wide and overlap by
half, so that one holds all the diagonals of an occurrence. Bands that reach the bound are verified by
alignment: edit distance of the whole item against the text, free at both ends of the text, within the band.

Short items, of which an occurrence need not share a run of `q` characters, have shorter grams: of m // (k + 1), which it must share.
Of the places of one gram in an item, only those are kept that reach every band the others reach (a place between two
that lie no further apart than a band is wide reaches none of its own), so a periodic item costs no more than another; hits are spread out a bounded number
at a time, and very long texts are read in pieces that overlap by an occurrence. So memory depends neither on a text's length nor on its contents.

The filter is exact in one direction: no occurrence within the budget is missed. The items are broadcast, in
blocks of at most `BLOCK_CHARS` characters; a larger benchmark takes one pass over the texts a block, and each block goes before the next comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mix64, powers, store, text_blocks, tidied

_U = np.uint64
#: Characters of the items that are broadcast at a time.
BLOCK_CHARS = 2_000_000
_BINS, _FILTER = 1 << 18, 1 << 22
#: Hits that are spread out at a time, diagonals that are aligned at a time, and bytes of a piece of a long text.
_SPREAD, _LANES, PIECE = 1 << 19, 1 << 14, 1 << 21

# Letters A-Z and Latin-1 capitals become small, ASCII whitespace and no-break space become a space; one character stays one.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7
_FOLD[[9, 10, 11, 12, 13, 0xA0]] = 32


def fold(text: bytes) -> np.ndarray:
    """UTF-8 to folded code points."""
    cp = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    return np.where(cp < 256, _FOLD[np.minimum(cp, 255)], cp)


def gram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """Of all runs of q code points; a polynomial by prefix sums."""
    n = len(cp)
    if n < q:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((cp + _U(1)) * powers(n)[:n], out=total[1:])
    return mix64((total[q:] - total[:-q]) * powers(n, inverse=True)[: n - q + 1])


def banded(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Over the diagonals low .. low + width - 1: the fewest edits that turn the item into a part of the text, and on which diagonal it ends.

    Row i of the recurrence has, for every diagonal d, the edits of item[:i] against a part that ends before text[d + i].
    """
    lane = np.arange(width, dtype=np.int32)
    d = np.zeros(width, np.int32)
    m = len(item)
    padded = np.full(width + m, -1, np.int64)  # text[low : low + width + m], with what no item holds beyond its ends
    a, b = max(low, 0), min(low + width + m, len(text))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i, c in enumerate(item.tolist()):
        step = d + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], d[1:] + 1)
        d = np.minimum.accumulate(step - lane) + lane
    return int(d.min()), int(d.argmin())


def gram_length(size: int, edits: int, q: int) -> int:
    """The longest gram, up to q, of which an occurrence with so many edits shares one at least."""
    return max(1, min(q, size // (edits + 1)))


class Grams:
    """The index of the items of one gram length."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], budget: np.ndarray, q: int):
        self.q, own, at, hashes = q, [], [], []
        for n in numbers:
            h = gram_hashes(items[n], q)
            keep = _reaching(h, max(int(budget[n]), 1))
            hashes.append(h[keep])
            at.append(keep)
            own.append(np.full(len(keep), n))
        h = np.concatenate(hashes)
        by = np.argsort(h, kind="stable")  # of one gram: by item, then by place
        self.grams, first = np.unique(h[by], return_index=True)
        self.first = np.append(first, len(h))
        self.own, self.at = np.concatenate(own)[by].astype(np.int32), np.concatenate(at)[by].astype(np.int32)
        self.filter = np.zeros(_FILTER, bool)
        self.filter[self.grams & _U(_FILTER - 1)] = True

    def hits(self, cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in it, gram) of every run of q characters that some item holds."""
        h = gram_hashes(cp, self.q)
        place = np.flatnonzero(self.filter[h & _U(_FILTER - 1)])
        g = np.minimum(np.searchsorted(self.grams, h[place]), len(self.grams) - 1)
        doc = np.searchsorted(offs, place, "right") - 1
        good = (self.grams[g] == h[place]) & (place + self.q <= offs[doc + 1])
        place, doc = place[good], doc[good]
        return doc, place - offs[doc], g[good]

    def spread(self, doc: np.ndarray, place: np.ndarray, g: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(hit, document, item, diagonal) of the hits against each of their places in items, about `most` at a time."""
        count = self.first[g + 1] - self.first[g]
        cuts = np.flatnonzero(np.diff((np.cumsum(count) - count) // most, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)]):
            n = count[a:b]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[g[a:b]], n)
            yield np.repeat(np.arange(a, b), n), np.repeat(doc[a:b], n), self.own[entry], np.repeat(place[a:b], n) - self.at[entry]


def _reaching(h: np.ndarray, band: int) -> np.ndarray:
    """Places in an item that reach all the bands which its grams h reach."""
    if not len(h) or np.unique(h, return_counts=True)[1].max() < 3:
        return np.arange(len(h))
    by = np.argsort(h, kind="stable")
    keep, same = [], np.append(h[by][1:] == h[by][:-1], False)
    last = None
    for i, p in enumerate(by.tolist()):
        # `last` is the last kept place of this gram; p can go if the next one lies within a band of it
        if last is not None and same[i] and by[i + 1] - last <= band:
            continue
        keep.append(p)
        last = p if same[i] else None
    return np.sort(np.array(keep, np.int64))


def _sums(pair: np.ndarray, band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((band, pair))
    pair, band, n = pair[by], band[by], n[by]
    head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]))[: len(pair)])
    return pair[head], band[head], np.add.reduceat(n, head) if len(head) else n


class ItemIndex:
    def __init__(self, items: list[tuple[object, np.ndarray]], q: int, rate: float):
        self.items = [(i, t) for i, t in items if len(t)]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.k = np.floor(self.size * rate + 1e-9).astype(np.int64)
        self.band = np.maximum(self.k, 1)
        self.reach = int((self.size + self.k).max(initial=0))
        own_q = np.array([gram_length(m, k, q) for m, k in zip(self.size.tolist(), self.k.tolist())], np.int64)
        self.least = self.size - own_q + 1 - self.k * own_q
        texts = [t for _, t in self.items]
        self.grams = [Grams(texts, np.flatnonzero(own_q == x).tolist(), self.k, x) for x in np.unique(own_q).tolist()]
        self.whole = (self.k == 0) & (self.size == own_q)  # a hit is an occurrence

    def matches(self, cp: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item place in self.items, edits, about where it begins), the best of every document and item that has an occurrence."""
        return [found for grams in self.grams for found in self._matches(grams, cp, offs)]

    def _matches(self, grams: Grams, cp: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Some documents at a time, as many as have about _SPREAD hits."""
        doc, place, g = grams.hits(cp, offs)
        if not len(doc):
            return
        count = grams.first[g + 1] - grams.first[g]
        heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        cuts = heads[np.flatnonzero(np.diff((np.cumsum(count) - count)[heads] // _SPREAD, prepend=-1))]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
            yield from self._of_documents(grams, (doc[a:b], place[a:b], g[a:b]), cp, offs)

    def _of_documents(self, grams: Grams, hits: tuple, cp: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        many, base = len(self.items), int(hits[0][0])
        entries = int((grams.first[hits[2] + 1] - grams.first[hits[2]]).sum())
        held = list(grams.spread(*hits, _SPREAD)) if entries <= 3 * _SPREAD else None  # a document of very many hits is spread out once more for each pass
        spread = lambda: held if held is not None else grams.spread(*hits, _SPREAD)
        # first whole documents: what holds too few places of an item's grams holds no occurrence
        space = min((int(hits[0][-1]) - base + 1) * many, _BINS)
        seen = np.zeros(space, np.int64)
        for _, doc, item, _ in spread():
            seen += np.bincount(((doc - base) * many + item) % space, minlength=space)
        bins = np.zeros(_BINS, np.int64)
        exact: dict[int, int] = {}
        kept, n = [], 0
        for part in spread():
            pair, band, item, code = self._bands(part, seen, base, exact)
            bins += np.bincount(code, minlength=_BINS)
            n += len(pair)
            kept = [*kept, (pair, band, item, code)] if n <= 4 * _SPREAD else []
        parts = [(np.zeros(0, np.int64),) * 3]
        for pair, band, item, code in kept if n <= 4 * _SPREAD else (self._bands(part, seen, base, exact) for part in spread()):
            full = bins[code] >= self.least[item]
            parts.append(_sums(pair[full], band[full], np.ones(int(full.sum()), np.int64)))
        pair, band, count = _sums(*map(np.concatenate, zip(*parts)))
        good = count >= self.least[pair % many]
        pair, band = pair[good], band[good]
        for p, at in exact.items():
            yield p // many, p % many, 0, at
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(pair)]):
            doc, n = divmod(int(pair[a]), many)
            if best := self._align(cp[offs[doc] : offs[doc + 1]], n, band[a:b]):
                yield doc, n, *best

    def _bands(self, part: tuple, seen: np.ndarray, base: int, exact: dict[int, int]) -> tuple[np.ndarray, ...]:
        """(document and item, band, item, bin) of hits that `seen` lets pass, each band once a place; items that a gram holds whole go to `exact` with their first place."""
        many = len(self.items)
        hit, doc, item, diag = part
        near = np.flatnonzero(seen[((doc - base) * many + item) % len(seen)] >= self.least[item])
        hit, item, diag, pair = hit[near], item[near], diag[near], doc[near] * many + item[near]
        if self.whole[item].any():
            full = np.flatnonzero(self.whole[item])
            found, first = np.unique(pair[full], return_index=True)
            for p, at in zip(found.tolist(), diag[full[first]].tolist()):
                exact[p] = min(exact.get(p, at), at)
            rest = ~self.whole[item]
            hit, pair, item, diag = hit[rest], pair[rest], item[rest], diag[rest]
        band = diag // self.band[item]
        # of one hit and item diagonals fall, so equal bands are neighbours
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (pair[1:] != pair[:-1]) | (hit[1:] != hit[:-1])
        hit, pair, item, band = hit[new], pair[new], item[new], band[new]
        # a diagonal lies in two bands: the one that begins with its stripe, and the one before
        before = np.ones(len(band), bool)
        before[:-1] = (band[1:] != band[:-1] - 1) | (pair[1:] != pair[:-1]) | (hit[1:] != hit[:-1])
        pair, item, band = (np.concatenate((x, y[before])) for x, y in ((pair, pair), (item, item), (band, band - 1)))
        code = (mix64(pair.astype(np.uint64) * _U(0x9E3779B97F4A7C15) ^ band.astype(np.uint64)) & _U(_BINS - 1)).astype(np.int64)
        return pair, band, item, code

    def _align(self, text: np.ndarray, n: int, bands: np.ndarray) -> tuple[int, int] | None:
        """(fewest edits, about where), over the bands; neighbouring ones are aligned as one."""
        item, k, width = self.items[n][1], int(self.k[n]), int(self.band[n])
        best: tuple[int, int] | None = None
        apart = np.flatnonzero(np.append(True, (np.diff(bands) > 1) | (np.diff(bands // (_LANES // width + 1)) > 0)))
        for a, b in zip(apart.tolist(), [*apart[1:].tolist(), len(bands)]):
            low = int(bands[a]) * width - k
            edits, lane = banded(item, text, low, int(bands[b - 1] - bands[a] + 2) * width + 2 * k)
            if edits <= k and (best is None or edits < best[0]):
                best = edits, max(low + lane, 0)
            if best and not best[0]:
                break
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 7, rate: float = 0.1, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, edits, place: every item that occurs in a document with at most `rate` edits a character (rounded down); the fewest edits, and about where.

    Case of Latin letters and kinds of ASCII whitespace don't count. Null and empty items occur nowhere, null and
    empty texts hold nothing. Repeated rows, of either table, give rows of their own; null ids are allowed. Other columns are left out.
    Empty tables give an empty one.
    """
    if not 0 <= rate < 0.5:
        raise ValueError(f"rate: {rate!r} is not below a half")
    kinds = [docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    return _over_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, q, rate, item_id, text, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, place bigint", to_arrow_type(benchmark.schema[item_id].dataType))


def _over_blocks(rows: DataFrame, benchmark: DataFrame, q: int, rate: float, item_id: str, text: str, kind: str, item_type) -> DataFrame:
    """rows (an id, text) to what `contaminated` tells of them. One block of items is looked for as the rows are read; of several, each one's hits are stored and its broadcast goes."""
    parts, items, blocks = [], *_item_blocks(benchmark, item_id, text)
    for block in range(blocks):
        sent = _sent(items, block, blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, q, rate)
            for batch in batches:
                for (ids,), buf, offs in text_blocks([batch.column(0)], batch.column(1)):
                    best = _fewest(index, buf, offs)
                    item = pa.array([index.items[n][0] for _, n in best], item_type)
                    columns = [ids.take(pa.array([doc for doc, _ in best], pa.int64())), item, pa.array([e for e, _ in best.values()], pa.int32()), pa.array([a for _, a in best.values()], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "place"])

        found = rows.mapInArrow(tidied(run), kind)
        if blocks > 1:
            found = store(found)
            sent.destroy()
        parts.append(found)
    return reduce(DataFrame.unionAll, parts)


def _item_blocks(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    items = benchmark.filter(F.length(text) > 0).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, 1 if chars <= BLOCK_CHARS else 2 * (chars // BLOCK_CHARS) + 1


def _sent(items: DataFrame, block: int, blocks: int) -> Broadcast:
    """A broadcast of (item, folded text): of all items, or of those whose hash falls to the block."""
    mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    rows = sorted(mine.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
    return items.sparkSession.sparkContext.broadcast([(r["item_id"], fold(r["text"].encode())) for r in rows])


def _pieces(buf: np.ndarray, offs: np.ndarray, overlap: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, folded characters, where each begins, characters of it before) of a block; a long document comes in pieces that share `overlap` characters."""
    step = max(PIECE, 8 * overlap)
    if len(offs) > 2 or offs[-1] <= 2 * step:
        before = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        yield list(range(len(offs) - 1)), fold(buf.tobytes()), before[offs], np.zeros(len(offs) - 1, np.int64)
        return
    at, chars = 0, 0
    while at < len(buf):
        to = min(at + step, len(buf))
        while to < len(buf) and buf[to] & 0xC0 == 0x80:
            to += 1
        cp = fold(buf[at:to].tobytes())
        yield [0], cp, np.array([0, len(cp)]), np.array([chars])
        if to == len(buf):
            return
        back = to
        for _ in range(min(overlap, len(cp) - 1)):
            back -= 1
            while buf[back] & 0xC0 == 0x80:
                back -= 1
        chars += len(cp) - min(overlap, len(cp) - 1)
        at = back


def _fewest(index: ItemIndex, buf: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, item) of a block of texts to (edits, place)."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for docs, cp, at, before in _pieces(buf, offs, index.reach):
        for doc, n, edits, place in index.matches(cp, at):
            best[docs[doc], n] = min(best.get((docs[doc], n), (1 << 30, 0)), (edits, place + int(before[doc])))
    return best


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 7, rate: float = 0.1, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows whose text holds no item within its budget; each row is judged by itself.

    Null and empty texts stay, as do repeated rows and columns of any name; an empty benchmark or table changes nothing. With a benchmark of one block no row is moved;
    beyond that the hits of all blocks are joined by a hash of the text.
    """
    items, blocks = _item_blocks(benchmark, item_id, text)
    if blocks > 1:
        mark = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(29), text).alias("b"))
        rows = docs.select(mark.alias("doc_id"), text)
        kind = "doc_id struct<a:bigint,b:bigint>, item_id string, edits int, place bigint"
        told = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias(text))
        bad = _over_blocks(rows, told, q, rate, "item_id", text, kind, pa.string()).select("doc_id").distinct()
        kept = docs.select(F.struct(*docs.columns).alias("rest"), mark.alias("doc_id")).join(bad, "doc_id", "left_anti")
        return kept.select("rest.*")
    at, sent = docs.columns.index(text), _sent(items, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(sent.value, q, rate)
        for batch in batches:
            for columns, buf, offs in text_blocks(batch.columns, batch.column(at)):
                good = np.ones(len(offs) - 1, bool)
                good[[doc for doc, _ in _fewest(index, buf, offs)]] = False
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(good))

    return docs.mapInArrow(tidied(run), docs.schema)
