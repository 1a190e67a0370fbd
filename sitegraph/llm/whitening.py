"""Operator 11: whitening of embeddings, with covariances by polarisation.

The entries become integers x = floor(64 c) + 1000000.  For every dimension and
every sum of two dimensions the squared centred values are summed up exactly; the
variance of a sum less the variances of its parts is twice the covariance.  The
matrix of covariances is assembled on the driver (its size depends on the number
of dimensions alone), and its eigenvectors whiten every row.

* Exactness: a value is centred by the integer part q of the mean before it is
  squared, so block sums fit 64 bits (Python integers where they would not); what
  is left of the mean, r / n, enters as an exact correction, since the values
  centred by q add up to r.  Sums over tasks are DECIMAL(38).
* Four scans of the vector column: length, sums, squares, result (one more for
  the error).  A task sends a row for each pair of dimensions, whatever its rows.

Defined results: rows whose vector is null, or holds a null, an infinite or NaN
entry (or one of 2^40 or more in size) are left out, as are vectors of another
length than the most frequent one (of equally frequent ones the longest); rows
with a null id count like others; repeated rows count each time; components
whose eigenvalue is not above 1e-12 of the largest have no variance and are left
out, so equal vectors, a single row and an empty table give no rows; other columns
are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import read, slices
from sitegraph.llm.vectors import fits, integers, largest, of_one_length, usable

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
_NO_VARIANCE = 1e-12
_EXACT = pa.decimal128(38, 0)


class Whitening(NamedTuple):
    """What a fit learns; of the size of the covariance matrix."""

    n: int
    sums: list[int]             # of x, by dimension
    trace: float                # of the covariances
    eigenvalues: np.ndarray     # falling, one for each component
    components: np.ndarray      # unit eigenvectors as columns

    @property
    def base(self) -> np.ndarray:
        """Integer part of the mean, by dimension."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """What the values centred by ``base`` add up to, by dimension."""
        return [s % self.n for s in self.sums]


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], type=_EXACT)


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of x in every dimension."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for part in (s for whole in parts for s in slices(whole)):
            x = integers(part.column(0), d, SCALE, SHIFT)
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), type=pa.int32()), pa.array([n] * d, type=pa.int64()),
                                              _decimals(total)], names=["dim", "n", "total"])

    found = vectors.select("v").mapInArrow(run, "dim int, n bigint, total decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row for each dimension
    total = {r.dim: int(r.total) for r in found}
    return (found[0].n if found else 0), [total[k] for k in range(d)] if found else []


def _squares(u: np.ndarray) -> list[np.ndarray]:
    """Sums over the rows of u_i^2 and of (u_i + u_j)^2 for j > i, by i."""
    if not fits(4, max(len(u), 1), largest(u), largest(u)):
        u = u.astype(object)
    out = []
    for i in range(u.shape[1]):
        both = u[:, i:] + u[:, i:i + 1]
        both[:, 0] = u[:, i]
        out.append((both * both).sum(axis=0))
    return out


def pair_squares(vectors: DataFrame, d: int, base: np.ndarray) -> dict[tuple[int, int], int]:
    """(i, j) -> exact sum of the squares of u_i + u_j (of u_i, if i = j), with u = x - base."""
    first = np.concatenate([np.full(d - i, i) for i in range(d)])
    second = np.concatenate([np.arange(i, d) for i in range(d)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(len(first), dtype=object), False
        for part in (s for whole in parts for s in slices(whole)):
            total, some = total + np.concatenate(_squares(integers(part.column(0), d, SCALE, SHIFT) - base)), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(first, type=pa.int32()), pa.array(second, type=pa.int32()),
                                              _decimals(total)], names=["i", "j", "total"])

    found = vectors.select("v").mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()  # a row for each pair of dimensions
    return {(r.i, r.j): int(r.total) for r in found}


def covariances(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """Covariances (divisor n) by polarisation, each rounded once.

    The squares of the fully centred values, times n^2, are n^2 * square - n * rest^2;
    of a pair, less those of its parts, this is twice n^3 times the covariance."""
    d = len(rest)
    def centred(i: int, j: int) -> int:
        return n * n * squares[i, j] - n * (rest[i] if i == j else rest[i] + rest[j]) ** 2

    own = [centred(i, i) for i in range(d)]
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (centred(i, j) - own[i] - own[j]) / (2 * n ** 3)
    return out


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors (all of them are the fit list); None if there are none."""
    n, total = sums(vectors, d) if d else (0, [])
    if not n:
        return None
    bare = Whitening(n, total, 0.0, np.empty(0), np.empty((d, 0)))
    cov = covariances(n, bare.rest, pair_squares(vectors, d, bare.base))
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > _NO_VARIANCE * max(values.max(), 0.0)]
    return bare._replace(trace=float(np.trace(cov)), eigenvalues=values[order], components=axes[:, order])


def whiten(vectors: DataFrame, d: int, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of every vector: the exact sum of (n x - S)^2 over the
    dimensions, and the values of the components, the first one first."""
    n, base, rest = model.n, model.base, model.rest
    axes = model.components / np.sqrt(model.eigenvalues)
    mean = np.array([r / n for r in rest])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for whole in parts for s in slices(whole)):
            u = integers(part.column(1), d, SCALE, SHIFT) - base
            exact = u if fits(d, largest(u), max(largest(u), n)) else u.astype(object)
            square, cross = (exact * exact).sum(axis=1), (exact * np.array(rest, dtype=exact.dtype)).sum(axis=1)
            deviation = n * n * square.astype(object) - 2 * n * cross.astype(object) + sum(r * r for r in rest)
            white = (u - mean) @ axes
            offsets = pa.array(np.arange(0, white.size + 1, max(white.shape[1], 1))[:len(u) + 1], type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), _decimals(deviation), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))],
                names=["id", "deviation", "whitened"])

    return vectors.select("id", "v").mapInArrow(run, "id bigint, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""
    first, second = np.triu_indices(k)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, plain = np.zeros((k, k)), np.zeros(k)
        for part in (s for whole in parts for s in slices(whole)):
            w = part.column(0).flatten().to_numpy().reshape(-1, k)
            products, plain = products + w.T @ w, plain + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(first, np.arange(k)), type=pa.int32()), pa.array(np.append(second, np.full(k, -1)), type=pa.int32()),
             pa.array(np.append(products[first, second], plain))], names=["i", "j", "total"])

    found = whitened.select("whitened").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(
        (F.sum("total") / n).alias("mean")).collect()  # a row for each pair of components
    mean = {(r.i, r.j): r.mean for r in found}
    return max(abs(mean[i, j] - mean[i, -1] * mean[j, -1] - (i == j)) for i, j in zip(first.tolist(), second.tolist()))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's rows by component (``deviation`` is null where a long cannot hold it)."""
    vectors, d = of_one_length(usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    model = fit(vectors, d)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                                         "explained double, identity_error double")
    white = whiten(vectors, d, model)
    error = identity_error(white, model.n, len(model.eigenvalues))
    shares = F.array(*[F.lit(float(e) / model.trace) for e in model.eigenvalues])
    rows = white.select("id", F.col("deviation").try_cast("bigint").alias("deviation"),
                        F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(F.col("id").alias("vec_id"), (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                       "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"),
                       F.lit(error).alias("identity_error"))
