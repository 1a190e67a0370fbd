"""Runs that can be taken up again: a ledger of finished stages (PIP1).

A stage's table is written under ``root/<stage>/<key>``.  The key is a digest of the
stage's name, its parameters and its inputs: an input table counts by its content, an
earlier stage by its own key.  A stage that has finished for a key is read, not
computed; one that was broken off is written again.  Nothing else is kept, so there is
no file that two stages write, and stages of other inputs lie side by side.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> str:
    """Digest of the rows of a table with its column names and types, whatever their order,
    files and partitions.  Repeated rows count.  One pass, a row of sums for each task."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    seeds = [F.xxhash64(F.lit(k), F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in df.columns]))
             for k in range(3)]
    sums = df.agg(F.count(F.lit(1)), *[F.sum(h.cast("decimal(38,0)")) for h in seeds]).first()
    return hashlib.sha256(json.dumps([fields, [str(v) for v in sums]]).encode()).hexdigest()


class Stage:
    """A finished stage: its key and its table."""

    def __init__(self, key: str, table: DataFrame):
        self.key, self.table = key, table


class Ledger:
    """The finished stages below ``root`` (a folder that driver and executors share).  One run
    at a time may use a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.computed: list[str] = []  # names of the stages that were not taken from the ledger

    def _finished(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def stage(self, name: str, compute: Callable[..., DataFrame], inputs: dict[str, DataFrame | Stage | str | None],
              **parameters) -> Stage:
        """``compute(**tables)`` of the inputs, or what the ledger has of it.  An input is a
        table, an earlier stage, or the digest of a table that ``compute`` has on its own
        (it is not passed on then).  Parameters must be JSON values."""
        parts = {k: v.key if isinstance(v, Stage) else content_digest(v) if isinstance(v, DataFrame) else v
                 for k, v in inputs.items()}
        spelled = json.dumps([name, parts, parameters], sort_keys=True)
        key = hashlib.sha256(spelled.encode()).hexdigest()[:32]
        path = f"{self.root}/{name}/{key}"
        if not self._finished(path):
            tables = {k: v.table if isinstance(v, Stage) else v for k, v in inputs.items()
                      if isinstance(v, (Stage, DataFrame))}
            # the marker is the last file of a finished write
            compute(**tables).write.mode("overwrite").option(
                "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
            self.computed.append(name)
        return Stage(key, self.spark.read.parquet(path))
