"""Embedding columns as matrices, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries from this size on are treated like infinite ones, so that sums of integers stay exact
LARGEST = 2.0 ** 40


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows whose vector is there and has only finite entries, as doubles."""
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # a comparison with NaN or null does not hold here
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda e: F.coalesce(F.abs(e) < LARGEST, F.lit(False))))


def of_one_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length (of equally frequent ones the
    largest), and this length; 0 if there is no such row."""
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    return rows.where(F.size("v") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles, a row for each list."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def integers(column: pa.Array, d: int, scale: float, shift: int = 0) -> np.ndarray:
    """floor(scale * entry) + shift as 64-bit integers."""
    return np.floor(scale * matrix(column, d)).astype(np.int64) + shift


def fits(*factors: int) -> bool:
    """Whether a product of these sizes stays within 62 bits."""
    product = 1
    for f in factors:
        product *= int(f)
    return product < 1 << 62


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0
