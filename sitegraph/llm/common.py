"""Helpers shared by the text operators: tables, Arrow columns."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.session import Scratch  # noqa: F401 - its users import it from here


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver
    has it.  On a cluster it is installed or shipped with the job, and this path is
    one more that leads nowhere."""
    import sitegraph
    root = os.path.dirname(os.path.dirname(os.path.abspath(sitegraph.__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def utf8(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b or b"" for b in texts.cast(pa.binary()).to_pylist()]


def slices(part: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many rows, so that what a worker holds besides
    the batch is small."""
    for k in range(0, part.num_rows, rows):
        yield part.slice(k, rows)


def release() -> None:
    """Give freed memory of this worker back to the machine: workers live on for later
    tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n (null id: remainder of the empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n
