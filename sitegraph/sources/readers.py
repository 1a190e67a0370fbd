"""File sources (SRC1-4): pages, an archive tree, manifests and seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WS = r"[ \t]+"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: pages(page_id, url, html) from parquet."""
    return spark.read.parquet(path)


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """SRC2: a saved tree of files -> (save_path, host, body, fetched_at, size).

    ``save_path`` is the file path below ``root``; its first segment is the
    host; the modification time is the cache clock.  Files are read in
    parallel by the binaryFile source, one row per file.

    The folders are listed by a few tasks a core: Spark's own setting allows 10,000 tasks
    for every folder with subfolders, and in a tree with a folder a page each of them starts up
    to list a page or a dozen."""
    root_uri = root.rstrip("/")
    allowed = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(allowed), 4 * spark.sparkContext.defaultParallelism)))
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root_uri)
    finally:
        spark.conf.set(_LISTING, allowed)
    rel = F.substring(F.col("path"), F.length(F.lit(_absolute(spark, root_uri))) + 2, F.length("path"))
    return df.select(rel.alias("save_path"),
                     F.regexp_extract(rel, r"^([^/]*)", 1).alias("host"),
                     F.col("content").alias("body"),
                     F.col("modificationTime").alias("fetched_at"),
                     F.col("length").alias("size"))


def _absolute(spark: SparkSession, root: str) -> str:
    """The root as the file source writes it (scheme and absolute path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def parse_manifest_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC3: ``TYPE<ws>URL`` lines -> (link_type, url); blanks around the line
    are ignored and a line without a URL is skipped, like the shell loop."""
    fields = F.split(F.regexp_replace(F.col(col), r"^[ \t]+|[ \t]+$", ""), _WS)
    out = lines.select(F.get(fields, 0).alias("link_type"), F.get(fields, 1).alias("url"))
    return out.filter(F.col("url").isNotNull() & (F.col("url") != ""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest_lines(spark.read.text(path))


def parse_seed_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC4: one URL per line; blank lines skipped."""
    u = F.regexp_replace(F.col(col), r"^[ \t]+|[ \t]+$", "")
    return lines.select(u.alias("url")).filter(F.col("url") != "")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_seed_lines(spark.read.text(path))
