"""Substring dedup: compressed FM-indexes, one a shard, give the matching statistics of what is streamed through them.

Equal windows of words have equal contents, so they can be brought together by content and not by document: the
smallest hash of a six-word run in a window is its anchor, and the anchor with the words before or behind it that
the window holds for sure is its key. Neighbouring windows of one key form a segment of the document. Only keys that turn up twice
matter; their distinct segments, each with its number of copies, are fetched from the texts and dealt to shards
by key. A shard is an FM-index over its segments. They are streamed through it: backward search on the
wavelet matrix gives matching statistics, and the stretches where these reach the window are reported as intervals, for every copy of the segment.

A key of very many distinct segments would make one shard large. Its segments are cut again: the key is continued by all
the words that its windows have besides, so that every window is a segment and a key of its own, equal ones are one, and what a shard finds goes back to the segments they came from.
The work grows with the words, not with shards times documents, and a shard's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, row_key, small_batches, span_hash, store, text_blocks, tidied, word_bounds, word_hashes
from .fm_index import FMIndex

_U = np.uint64
#: Words of an anchor at most.
_RUN = 6
#: Words of the segments in one index, about, and distinct segments of a key beyond which it is continued.
SHARD_WORDS, KEY_SEGMENTS = 600_000, 512


def _leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the first smallest value in x[i : i + width]."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        other = np.append(at[step:], np.full(min(step, len(at)), len(x) - 1))
        at = np.where(x[other] < x[at], other, at)
        have += step
    return at


def segments(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """hashes of the words of several documents, parted at bounds: (document, start, length, key, content, step, times) of each segment, or run of equal ones."""
    n, width = len(hashes), min(_RUN, window)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    side = window - width - (window - width) // 2  # so many words of a window lie before its anchor, or else behind it
    reach = (window - width) // 2
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    run = span_hash(hashes, np.arange(n - width + 1), np.arange(width, n + 1))
    anchor = _leftmost_min(run, window - width + 1)[: n - window + 1]
    inside = doc[: n - window + 1] == doc[window - 1 :]
    before = anchor - np.arange(len(anchor)) >= side
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (before[1:] != before[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new | ~inside), len(anchor))
    last = ends[np.searchsorted(ends, first, "right")] - 1
    a = np.where(before[first], anchor[first] - reach, anchor[first])
    key = span_hash(hashes, a, a + width + reach) ^ np.where(before[first], _U(0x5851F42D4C957F2D), _U(0))
    length = last - first + window
    content = span_hash(hashes, first, first + length)
    # in periodic text one segment follows another of its kind at an even step: such a run is one row
    step = np.diff(first, prepend=-1)
    alike = np.zeros(len(first), bool)
    alike[1:] = (content[1:] == content[:-1]) & (doc[first[1:]] == doc[first[:-1]]) & (step[1:] < window)
    run_on = alike.copy()
    run_on[2:] &= ~alike[1:-1] | (step[2:] == step[1:-1])
    head = np.flatnonzero(~run_on)
    times = np.diff(np.append(head, len(first)))
    step = np.append(step, 0)[np.minimum(head + 1, len(first))] * (times > 1)
    return doc[first[head]], first[head] - bounds[doc[first[head]]], length[head], key[head], content[head], step, times


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_WORDS = "key bigint, content bigint, copies bigint, words binary"
_SEGMENT = "key bigint, content bigint, row struct<a:bigint,b:bigint>, place bigint, length bigint, times bigint"


def _cut_segments(window: int):
    """place: start and step, 32 bits each; a text of 2**31 words would not fit one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rows,), buf, offs in text_blocks([batch.column(0)], batch.column(1)):
                starts, ends, bounds = word_bounds(buf, offs)
                doc, at, length, key, content, step, times = segments(word_hashes(buf, starts, ends), bounds, window)
                columns = [_i64(key), _i64(content), rows.take(pa.array(doc)), _i64(at << 32 | step), _i64(length), _i64(times)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "content", "row", "place", "length", "times"])

    return run


def _flat(lists: pa.Array, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(n)]


def _windows_of(window: int):
    """Texts with the places of segments to all the windows of these, with the segment that each came from and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lists,), buf, offs in text_blocks([batch.column(0)], batch.column(1)):
                starts, ends, bounds = word_bounds(buf, offs)
                hashes = word_hashes(buf, starts, ends)
                doc, (key, content, place, length, copies) = _flat(lists, 5)
                again = mix64(hashes ^ _U(0xA24BAED4963EE407))
                many = length - window + 1
                for a, b in _parts(many * window):
                    n = many[a:b]
                    of = np.repeat(np.arange(a, b), n)
                    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    first = bounds[doc[of]] + (place[of] >> 32) + at
                    own = [span_hash(x, first, first + window) for x in (hashes, again)]
                    words = _words(hashes, first, np.full(len(first), window))
                    yield pa.RecordBatch.from_arrays([_i64(own[0]), _i64(own[1]), _i64(copies[of]), words, _i64(key[of]), _i64(content[of]), _i64(at)], ["key", "content", "copies", "words", "of_key", "of_content", "at"])

    return run


def _parts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to _FETCHED about."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // _FETCHED, prepend=-1)).tolist()
    yield from zip(cuts, [*cuts[1:], len(size)])


def _words(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    to = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(to[-1]) - np.repeat(to[:-1] - first, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((to * 8).astype(np.int32).tobytes()), pa.py_buffer(hashes[take].tobytes())])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their segments to the segments' words, 64 bits each."""
    for batch in batches:
        for (lists,), buf, offs in text_blocks([batch.column(0)], batch.column(1)):
            starts, ends, bounds = word_bounds(buf, offs)
            hashes = word_hashes(buf, starts, ends)
            doc, (key, content, place, size, copies) = _flat(lists, 5)
            first = bounds[doc] + (place >> 32)
            for a, b in _parts(size):
                yield pa.RecordBatch.from_arrays([_i64(key[a:b]), _i64(content[a:b]), _i64(copies[a:b]), _words(hashes, first[a:b], size[a:b])], ["key", "content", "copies", "words"])


#: Tasks that the segments of a large key are dealt to where they are told from the others.
_PARTS = 16
#: Words that are fetched into one batch, about.
_FETCHED = 1 << 19


def _search(window: int, shard_words: int):
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        if not len(t):
            return pa.RecordBatch.from_arrays([_i64(np.zeros(0, np.int64))] * 4, ["key", "content", "a", "b"])
        key, content, copies = (t.column(i).to_numpy() for i in range(3))
        words = t.column(3).combine_chunks()
        offs = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :] // 8
        data = np.frombuffer(words.buffers()[2], np.uint64)[offs[0] : offs[-1]]
        seg, a, b = FMIndex(data, (offs - offs[0]).astype(np.int64), copies).repeated(window)
        return pa.RecordBatch.from_arrays([_i64(key[seg]), _i64(content[seg]), _i64(a), _i64(b)], ["key", "content", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, (None, None)
        for batch in batches:  # sorted by key and content
            key, content = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            fresh[0] = (key[0], content[0]) != last
            words_to = np.frombuffer(batch.column(3).buffers()[1], np.int32, len(key) + 1 + batch.column(3).offset)[batch.column(3).offset :] // 8
            new_key = np.flatnonzero(np.concatenate(([key[0] != last[0]], key[1:] != key[:-1])))
            at = 0
            for i in new_key.tolist():
                words = int(words_to[i] - words_to[at])
                if n + words >= shard_words and (held or i > at):
                    held.append(batch.slice(at, i - at).filter(pa.array(fresh[at:i])))
                    yield shard(held)
                    held, n, at = [], 0, i
            held.append(batch.slice(at).filter(pa.array(fresh[at:])))
            n += int(words_to[-1] - words_to[at])
            last = (key[-1], content[-1])
        if sum(map(len, held)):
            yield shard(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, spans = [], [], [], []
        flat = batch.column(1).flatten()
        a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        at = np.concatenate(([0], np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        for i, text in enumerate(batch.column(0)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            gone = []
            for x, y in sorted(zip(a[at[i] : at[i + 1]].tolist(), b[at[i] : at[i + 1]].tolist())):
                if gone and x <= gone[-1][1]:
                    gone[-1][1] = max(y, gone[-1][1])
                else:
                    gone.append([x, y])
            n_words.append(len(words))
            n_removed.append(sum(y - x for x, y in gone))
            for x, y in reversed(gone):
                del words[x:y]
            kept.append(b" ".join(words).decode())
            spans.append([{"start": x, "end": y} for x, y in gone])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], ["rest", "n_words", "n_removed", "kept", "spans"])


def repeated_windows(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row doc_id, n_words, n_removed, kept (the words outside, joined by one space), spans (removed word ranges).

    A word is removed if a window of `window` words (1 or more) that holds it begins at two places or more, in one document or
    several. Null texts have no words. Rows are told apart by 128 bits of hashes of id and text: rows equal in both are
    copies of each other like any others, and null ids are allowed. Words are compared by 64-bit hashes.
    Other columns are left out. An empty table gives an empty one.
    """
    return _windows(docs, window, doc_id, text, F.struct(F.col(doc_id).alias("doc_id"))).select("rest.*", "n_words", "n_removed", "kept", "spans")


def _twice(cut: DataFrame) -> DataFrame:
    """Segments of the keys that turn up twice. Counted before they are dealt, and joined: a hot key is summed where it is read, and its rows can be split."""
    often = cut.groupBy("key").agg(F.sum("times").alias("n")).filter("n > 1").select("key")
    return cut.join(often, "key")


def _lists(distinct: DataFrame) -> DataFrame:
    """The segments that are fetched from each row, as a list."""
    one = F.struct("key", "content", F.col("one.place").alias("place"), F.col("one.length").alias("length"), "copies")
    return distinct.groupBy(F.col("one.row").alias("row")).agg(F.collect_list(one).alias("list"))


def _searched(fetched: DataFrame, window: int) -> DataFrame:
    """key, content, a, b: the intervals of distinct segments (key, content, copies, words) that repeat."""
    dealt = fetched.select("key", "content", "copies", "words").repartition("key").sortWithinPartitions("key", "content")
    return dealt.mapInArrow(tidied(_search(window, SHARD_WORDS)), "key bigint, content bigint, a bigint, b bigint")


def _merged(spans):
    """Sorted (a, b) without those that touch."""
    join = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).b >= x.a), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).a.alias("a"), F.greatest(F.element_at(acc, -1).b, x.b).alias("b"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<a:bigint,b:bigint>>"), join)


def _windows(docs: DataFrame, window: int, doc_id: str, text: str, rest: Column) -> DataFrame:
    small_batches(docs.sparkSession)
    keyed = docs.select(row_key(doc_id, text).alias("row"), rest.alias("rest"), F.col(text).alias("text"))
    seen = store(_twice(keyed.select("row", "text").mapInArrow(tidied(_cut_segments(window)), _SEGMENT)))
    distinct = seen.groupBy("key", "content").agg(F.sum("times").alias("copies"), F.min(F.struct("row", "place", "length")).alias("one"))
    kinds = seen.groupBy("key", "content").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("n"))
    large = kinds.filter(F.col("n") > KEY_SEGMENTS).select("key")
    # the segments of a large key are many: they meet it in several tasks
    distinct = distinct.withColumn("part", F.pmod(F.hash("content"), F.lit(_PARTS)))
    dealt = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))

    def of_texts(lists: DataFrame) -> DataFrame:
        # with `rest`, which isn't needed: so the texts are dealt once for all the joins
        return keyed.join(lists, "row").select("list", "text", "rest")

    if large.isEmpty():
        found = _searched(of_texts(_lists(distinct)).mapInArrow(tidied(_fetch), _WORDS), window)
    else:
        found = _searched(of_texts(_lists(distinct.join(dealt, ["key", "part"], "left_anti"))).mapInArrow(tidied(_fetch), _WORDS), window)
        pieces = of_texts(_lists(distinct.join(dealt, ["key", "part"], "left_semi"))).mapInArrow(tidied(_windows_of(window)), _WORDS + ", of_key bigint, of_content bigint, at bigint")
        kinds = pieces.groupBy("key", "content").agg(F.sum("copies").alias("copies"), F.first("words").alias("words")).filter("copies > 1")
        hits = pieces.select("key", "content", "of_key", "of_content", "at").join(_searched(kinds, window), ["key", "content"])
        spans = hits.groupBy(F.col("of_key").alias("key"), F.col("of_content").alias("content")).agg(_merged(F.collect_list(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))).alias("spans"))
        found = found.unionByName(spans.select("key", "content", F.explode("spans").alias("s")).select("key", "content", "s.a", "s.b"))
    at = F.shiftright("place", 32)
    more = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) * (F.col("times") - 1)
    spans = seen.join(found, ["key", "content"]).select("row", F.struct((at + F.col("a")).alias("a"), (at + more + F.col("b")).alias("b")).alias("s"))
    gone = spans.groupBy("row").agg(F.collect_set("s").alias("gone"))
    out = T.StructType([keyed.schema["rest"], *T._parse_datatype_string("n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>").fields])
    return keyed.join(gone, "row", "left").select("text", "gone", "rest").mapInArrow(tidied(_remove), out)


def drop_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows without the repeated words; a text that loses none stays as it is, and null stays null.

    Repeated rows are copies of each other, so their common windows go from all of them; every row stays, if without words.
    Other columns stay, whatever their names. An empty table gives an empty one.
    """
    found = _windows(docs, window, doc_id, text, F.struct(*docs.columns))
    left = F.when(F.col("n_removed") == 0, F.col("rest")[text]).otherwise(F.col("kept"))
    return found.select(*(left.alias(c) if c == text else F.col("rest")[c].alias(c) for c in docs.columns))
