"""What several operators of this package share: words, keys, lineage cuts, vectorised bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII whitespace characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Text bytes that the vectorised helpers hold at a time; one longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session on one machine (master local) gets a temporary one; on a cluster, where executors
    would each write to a disk of their own, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialises `df` in the shared checkpoint folder and drops its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: str = "16m") -> None:
    """Batches of at most so many bytes go to Python workers of this session, unless it says how many itself.

    The default is 64 MB or 10,000 rows. A worker holds a batch of whole texts several times over, as Arrow has it, as words and as what comes out, and the executor holds two more beside its heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == "67108864b":
        spark.conf.set(name, most)


_stored: list[str] = []


def store(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet into the shared checkpoint folder and reads it back.

    The table goes with the next `release` that covers it, and with the driver at the latest.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _stored.append(path)
    return spark.read.parquet(path)


def stored() -> list[str]:
    """Paths of the tables that `store` wrote and `release` has not removed."""
    return list(_stored)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes stored tables that nothing reads any more."""
    for path in paths:
        if path in _stored:
            _stored.remove(path)
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Two 64-bit hashes (a, b) that tell rows with one id apart; rows equal in both columns share them and are interchangeable."""
    return F.struct(F.xxhash64(F.col(text_col), F.col(id_col)).alias("a"), F.xxhash64(F.lit(29), F.col(id_col), F.col(text_col)).alias("b"))


def tidied(run):
    """`run`, which turns batches into batches; at its end the memory that it let go is given back.

    Python workers are kept for later tasks, and C's allocator and Arrow's keep what was freed, beside an executor that wants it.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def fresh(columns: list[str], *names: str) -> list[str]:
    """Each name, or the first variant of it that no column has, as Spark compares names."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


#: Keys of so many rows look up by broadcast; of n rows those of more than n / _HUBS, of which there are fewer than _HUBS.
_HUB, _HUBS = 256, 10_000


def look_up(rows: DataFrame, known: DataFrame, on: list[str], many: str) -> DataFrame:
    """rows joined with the one row of `known` that agrees in `on`, where there is one. `many` is a column of `known`: how many rows it meets, about. Keys of very many rows are broadcast, so that none of them is one task's."""
    n = known.agg(F.sum(many)).first()[0] or 0
    if n <= _HUB:
        return rows.join(known, on)
    hub = F.col(many) > max(_HUB, n // _HUBS)
    hubs = store(known.filter(hub))
    if hubs.isEmpty():
        return rows.join(known, on)
    few = rows.join(F.broadcast(hubs.select(*on)), on, "left_anti").join(known.filter(~hub), on)
    return few.unionByName(rows.join(F.broadcast(hubs), on))


#: Bits of a sieve for each key, and bits of a sieve at most.
_SIEVE, _SIEVES = 16, 1 << 26


def sieved(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose `key`, 64 well mixed bits in a field of a column, isn't among the one column of `keys`: what is left is joined.

    A bit map tells them, of _SIEVE bits a key and 8 MB at most, so it is broadcast; where keys are too many for it, all rows stay.
    """
    (name,) = keys.columns
    n = keys.count()
    bits = 1 << max(6, (n * _SIEVE - 1).bit_length())
    if bits > _SIEVES:
        return rows
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("m")).toArrow()  # bits / 64 rows at most, as two columns of numbers
    mask = np.zeros(bits >> 6, np.int64)
    mask[words.column("w").to_numpy()] = words.column("m").to_numpy()
    sent, path = rows.sparkSession.sparkContext.broadcast(mask), key.split(".")
    place, names = rows.columns.index(path[0]), rows.columns

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = sent.value
        for batch in batches:
            k = batch.column(place)
            for field in path[1:]:
                k = k.field(field)
            k = k.to_numpy(zero_copy_only=False) & (bits - 1)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array((mask[k >> 6] >> (k & 63)) & 1 == 1)).columns, names)

    return rows.mapInArrow(tidied(sieve), rows.schema)


def text_blocks(ids: list[pa.Array], text: pa.Array) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Slices a batch to about BLOCK_BYTES: (id columns, bytes, offsets); a null text has no bytes."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if len(text) == 0:
        return
    offs = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(text))
        yield [c.slice(at, to - at) for c in ids], whole[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document where its words begin (one entry more)."""
    n = len(buf)
    solid = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    if n:
        last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words with good avalanche (xor-shift and odd multipliers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**n (or of its inverse) modulo 2**64, kept and grown."""
    key = pow(base, -1, 1 << 64) if inverse else base
    if key not in _powers or len(_powers[key]) <= n:
        p = np.full(max(n, 1 << 16) + 1, _U(key))
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers[key]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:end] of 64-bit codes: a polynomial by prefix sums, then mixed."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * powers(len(values), inverse=True)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(_BYTE_CODES[buf], starts, ends)
