"""Access to the driver tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of ``pages`` over so many tasks.  Unset (the
#: default), scans are left as they are.  For inputs of a single row group,
#: which Spark reads in one task whatever its settings.
DEAL = "spark.sitegraph.dealPages"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    tasks = spark.conf.get(DEAL, None) if name == "pages" else None
    return df.repartition(int(tasks)) if tasks else df
