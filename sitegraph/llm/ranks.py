"""Row numbers within keys, without putting a key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch


def ranked(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch, name: str, rank: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row among those of its key.

    Rows are range-partitioned by key and order, so a large key spans many
    partitions; each (key, partition) starts where the counts of the partitions
    before it end.  There are at most as many such pairs as partitions and keys
    together, so ``keys`` must have few values."""
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = scratch.save(d.withColumn("piece_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id()), name)
    pieces = d.groupBy(*keys, "piece_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("piece_").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    starts = pieces.withColumn("start_", before).drop("n_")
    return (d.join(F.broadcast(starts), [*keys, "piece_"])
            .withColumn(rank, F.col("start_") + F.col("place_") - F.col("first_"))
            .drop("piece_", "place_", "first_", "start_"))
