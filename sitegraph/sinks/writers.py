"""Sinks (SNK1-4): manifest text, URL list, archive table, failed responses.

Writers never funnel data through one task: text outputs are written by
every partition (a range-partitioned sort keeps a global order across the
part files), the archive is a snapshot table in hash buckets of the save path.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sitegraph.sinks import snapshots as S


def manifest_text(df: DataFrame) -> DataFrame:
    """SNK1 lines: ``TYPE\\tURL``."""
    return df.select(F.concat_ws("\t", "link_type", "url").alias("value"))


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    manifest_text(df).write.mode(mode).text(path)


def url_list(df: DataFrame, url_col: str = "url") -> DataFrame:
    """SNK2 lines: distinct URLs sorted by (scheme, netloc, path, url)."""
    from sitegraph.functions import urls as U
    u = df.select(F.col(url_col).alias("value")).distinct()
    return u.orderBy(U.url_protocol("value"), U.url_host("value"), U.url_path("value"), "value")


def write_url_list(df: DataFrame, path: str, url_col: str = "url", mode: str = "overwrite") -> None:
    url_list(df, url_col).write.mode(mode).text(path)


ARCHIVE_COLUMNS = ("page_key", "save_path", "host", "body", "fetched_at")


def write_archive(rows: DataFrame, root: str, key: str = "save_path", ts: str = "fetched_at",
                  buckets: int = S.BUCKETS, writer: str | None = None, batch: int | None = None) -> None:
    """SNK3, STR4: merge archive rows into the snapshot table at ``root``; per save
    path the newest copy stays (of equally new ones the largest), and no other path is
    touched.  Rows with other columns than the table's are refused.

    A write costs its own rows: they are appended as a delta and committed by one
    manifest (``sinks.snapshots``).  A write that breaks off changes nothing and can be
    repeated; ``compact_archive`` folds deltas in where they have become a
    large share, ``snapshots.clean`` removes what no manifest names."""
    S.append(rows, root, key, ts, buckets, writer, batch)


def compact_archive(spark: SparkSession, root: str, share: float = S.DELTA_SHARE) -> list[str]:
    """Rewrite the buckets whose deltas exceed ``share`` of them; returns their names."""
    return S.compact(spark, root, share)


def read_saved(spark: SparkSession, root: str) -> DataFrame:
    """The rows of an archive table: the newest copy of each save path."""
    return S.read(spark, root)


def write_tree(rows: DataFrame, root: str, folder: str = "folder", body: str = "body", end: bytes = b"") -> int:
    """A saved tree: the file ``part-0`` in every ``folder`` below ``root``, with the bodies of the rows
    of that folder one after the other, each followed by ``end`` (a null body is empty).  Returns
    the number of files.

    A job of a file a page is bound by what a file costs: Spark's file writers make, rename
    twice and check a file and its folders, and the driver takes part in each.  Here the tasks write the
    files themselves, in parallel, through pyarrow's file systems.  A file gets its name when it is
    whole, so a repeated or speculative attempt replaces it by the same bytes."""
    def write(part: Iterator[Row]) -> Iterator[int]:
        from pyarrow import fs
        at = "/" + root[len("file:"):].lstrip("/") if root.startswith("file:") else root
        files, base = fs.FileSystem.from_uri(at)
        attempt, done, held, out = uuid.uuid4().hex, 0, None, None

        def close() -> None:
            out.close()
            files.move(f"{base}/{held}/.{attempt}", f"{base}/{held}/part-0")

        for name, data in part:
            if name != held:
                if out is not None:
                    close()
                files.create_dir(f"{base}/{name}")
                held, done = name, done + 1
                out = files.open_output_stream(f"{base}/{name}/.{attempt}")
            out.write(bytes(data or b"") + end)
        if out is not None:
            close()
        yield done

    bodies = rows.select(F.col(folder).alias("folder"), F.col(body).cast("binary").alias("body"))
    return bodies.repartition("folder").sortWithinPartitions("folder").rdd.mapPartitions(write).sum()


def failures(parsed: DataFrame) -> DataFrame:
    """SNK4: the responses kept for inspection: every bad status, throttled
    ones (429) included."""
    return parsed.filter(F.col("outcome").isin("error", "throttled"))


def write_failures(parsed: DataFrame, path: str) -> None:
    failures(parsed).select("request_url", "status", "head", "body").write.mode("append").parquet(path)
