"""Spark session, checkpoint directory and scratch tables in it.

The library never creates its own cluster resources: it reads the session it
is given.  ``get_spark`` is only a convenience for tests, the bench and local
runs.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on.  AQE re-plans joins at run time
# (broadcast when a side turns out small, split skewed partitions of hot hosts
# and hot pages, coalesce tiny shuffle partitions).
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "sitegraph",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is
    used as is.  Only a local-mode session (tests, bench) without the setting
    gets a fresh scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the directory
        if configured:
            return configured
        raise RuntimeError("spark.checkpoint.dir is not set") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative jobs need a shared "
            "folder for reliable checkpoints on a cluster")
    path = tempfile.mkdtemp(prefix="sitegraph-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


class Scratch:
    """Intermediate tables in the shared folder ``spark.checkpoint.dir``.

    A table written here cuts the lineage: what follows reads files that every
    executor sees, so a lost executor only repeats its own tasks.  It cuts the planner's
    estimate too: a checkpoint keeps that of the plan it came from, where a join has the product
    of its sides; a table read again has the size of its files.  ``drop``
    deletes a table that no later step reads; the tables behind a returned
    DataFrame stay until ``purge``, at the latest until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._purge_at_exit)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table of this name and read it back."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")

    def purge(self) -> None:
        self._delete(self.base)

    def _purge_at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # else the session has been stopped
            self.purge()

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
