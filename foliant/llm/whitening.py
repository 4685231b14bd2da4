"""Whitening of embeddings: two-pass covariance, symmetric eigenvectors, projection.

The first pass sums integer components exactly, which gives the mean. The second subtracts it and multiplies what is left, a block of rows at a time, as one
matrix product; partitions hand on one matrix each, and treeAggregate merges them. LAPACK's symmetric solver takes the merged matrix on the driver: its size is that of
the vectors' dimension squared, whatever the number of rows. Mean and projection, a few vectors, are broadcast. A third pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from .common import fresh, tidied

#: Rows that a task holds as a matrix at a time.
_BLOCK = 8192
#: What integer components may reach, so that sums and products of doubles can tell them apart.
_MOST = 1 << 53


@dataclass
class Whitening:
    """n rows with column sums; eigenvalues and unit eigenvectors (columns) of the covariance, by falling eigenvalue; how far the whitened rows' covariance is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def scales(self, components: int) -> np.ndarray:
        """Vectors over the roots of their eigenvalues; nan for those without variance beyond rounding."""
        e = self.values[:components]
        sound = e > max(self.trace, 0.0) * len(self.values) * 1e-15
        return np.where(sound, self.vectors[:, :components] / np.sqrt(np.where(sound, e, 1.0)), np.nan)


def sound(vec: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(lists: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift by rows; components that a shorter vector lacks count as zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() + abs(shift) >= _MOST:
        raise ValueError(f"components beyond {_MOST // scale} can't be summed exactly")
    out = np.full((len(size), width), shift, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = whole.astype(np.int64) + shift
    return out


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as its whole part and the rest, so that subtracting both loses no digits."""
    low = [s // n for s in sums]
    return np.array(low, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, low)])


def _merged(parts: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, matrix) rows of partitions to those of all rows, by treeAggregate: centred matrices are put together by the distance of their means."""

    def both(a, b):
        if a is None or b is None:
            return b if a is None else a
        n = a[0] + b[0]
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    def put(had, row):
        return both(had, (row[0], np.frombuffer(row[1]), np.frombuffer(row[2]).reshape(width, width)))

    return parts.rdd.treeAggregate(None, put, both, depth=2)


def _products(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """n, mean and sum of centred outer products of the matrices that `of` makes of a partition's batches: one row."""
    n, mean, total = 0, None, None
    for batch in batches:
        for x in of(batch):
            if not len(x):
                continue
            m = x.mean(0)
            c = x - m
            if mean is None:
                n, mean, total = len(x), m, c.T @ c
            else:
                d, many = m - mean, n + len(x)
                total += c.T @ c + np.outer(d, d) * (n * len(x) / many)
                mean, n = mean + d * (len(x) / many), many
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["n", "mean", "total"])


_PRODUCTS = "n bigint, mean binary, total binary"


def fit(vectors: DataFrame, vec: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Mean and principal axes of x = floor(scale * component) + shift over all sound vectors; None without any.

    Vectors that are null or hold null or non-finite components take no part. A shorter vector counts as if zeros followed. Repeated rows count each. Components of
    2**53 / scale and more are an error, as their sums would not be exact.
    """
    rows = vectors.filter(sound(vec)).select(F.col(vec).alias("v"))
    width = rows.agg(F.max(F.size("v")).alias("width")).first()["width"]
    if width is None:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _integers(batch.column(0), width, scale, shift)
            n += len(x)
            high += (x >> 26).sum(0)  # halves, so that no sum of a partition leaves 64 bits
            low += (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], ["n", "high", "low"])

    both = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])])
    halves = rows.mapInArrow(tidied(add), "n bigint, high array<bigint>, low array<bigint>").rdd
    n, sums = halves.treeAggregate(None, lambda had, r: both(had, (r[0], [(h << 26) + x for h, x in zip(r[1], r[2])])), both, depth=2)
    if not width:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    whole, rest = _centre(sums, n)

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for at in range(0, batch.num_rows, _BLOCK):
            yield (_integers(batch.column(0).slice(at, _BLOCK), width, scale, shift) - whole) - rest

    _, _, total = _merged(rows.mapInArrow(tidied(lambda batches: _products(batches, centred)), _PRODUCTS), width)
    values, axes = np.linalg.eigh(total / n)
    values, axes = values[::-1], axes[:, ::-1]
    found = Whitening(n, sums, values, axes, float(np.trace(total) / n))
    to = found.scales(components)
    to = to[:, ~np.isnan(to).any(0)]
    if to.shape[1]:

        def turned(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for x in centred(batch):
                yield x @ to

        m, _, spread = _merged(rows.mapInArrow(tidied(lambda batches: _products(batches, turned)), _PRODUCTS), to.shape[1])
        found.identity_error = float(np.abs(spread / m - np.eye(to.shape[1])).max())
    return found


def whiten(vectors: DataFrame, model: Whitening, vec: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """The sound rows with all their columns, and deviation decimal(38,0): sum over dimensions of (n * x - S)**2, exact; whitened array<double>: one value a component, null for one without variance.

    New columns whose name a column has get another, as `fresh` names them: they are the last two. A vector longer than those of the model is an error.
    """
    deviation, whitened = fresh(vectors.columns, "deviation", "whitened")
    rows = vectors.filter(sound(vec))
    width, n = len(model.sums), model.n
    whole, rest = _centre(model.sums, n)
    sent = vectors.sparkSession.sparkContext.broadcast((model.sums, whole, rest, model.scales(components)))
    place, names = rows.columns.index(vec), [*rows.columns, deviation, whitened]
    kinds = StructType([*rows.schema.fields, StructField(deviation, DecimalType(38, 0)), StructField(whitened, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, whole, rest, to = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = _integers(part.column(place), width, scale, shift)
                far = _squares(x, sums, n)
                y = ((x - whole) - rest) @ to
                flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * to.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, far, lists], names)

    return rows.mapInArrow(tidied(run), kinds)


def _squares(x: np.ndarray, sums: list[int], n: int) -> pa.Array:
    """sum over columns of (n * x - sums)**2, in 64 bits where they suffice."""
    whole = [s // n for s in sums]
    far = int(np.abs(x - np.array(whole, np.int64)).max(initial=0)) + 1
    if len(sums) * (far * n) ** 2 < 1 << 62:
        d = (x - np.array(whole, np.int64)) * n - np.array([s - n * m for s, m in zip(sums, whole)], np.int64)
        return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
    d = x.astype(object) * n - np.array(sums, object)
    return pa.array([int(v) for v in (d * d).sum(1)], pa.decimal128(38, 0))
