"""Lookups of the fetch step as joins (JN1-3, JN5, SET2).

A "download" is a join with a corpus or an archive table; freshness is a
column comparison.  No side is broadcast by hint: AQE turns a join into a
broadcast join at run time only when the measured side is small, and splits
skewed partitions (a hot page requested a third of the time) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import urls as U


def pages_by_key(pages: DataFrame, url_col: str = "url", key: str = "page_key") -> DataFrame:
    """One page per key (AGG3): the lowest page_id wins when several URLs
    share a save path.  Aggregated with partial (map-side) combine."""
    p = pages.withColumn(key, U.page_key(url_col))
    cols = [c for c in p.columns if c not in (key,)]
    order = "page_id" if "page_id" in p.columns else url_col
    best = p.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("p"))
    return best.select(key, "p.*")


def expand(frontier: DataFrame, pages: DataFrame, key: str = "page_key") -> DataFrame:
    """JN1: the page of each frontier row (inner join on the page key); a URL
    with no page gives no row, so it is simply not expanded."""
    return frontier.join(pages, key, "inner")


def _seconds(c: Column) -> Column:
    """Whole seconds since the epoch of a wall-clock time (time-zone free,
    like the file clock it models)."""
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c.cast("timestamp_ntz"))


def cache_lookup(requests: DataFrame, archive: DataFrame, ttl_min: int | None = None,
                 as_of: Column | str | None = None, url_col: str = "url",
                 type_col: str = "link_type") -> DataFrame:
    """JN2: ``hit`` iff a copy exists under the save path and
    ``ttl*60 >= as_of - fetched_at`` (whole seconds); ``stale`` if older;
    ``miss`` if absent.  ``ttl_min=None`` means existence only.
    ``as_of`` defaults to the request's ``ts``."""
    as_of_c = F.col("ts") if as_of is None else (F.to_timestamp_ntz(F.lit(as_of)) if isinstance(as_of, str) else as_of)
    req = requests.withColumn("save_path", U.save_path(url_col, F.col(type_col))) \
        .withColumn("_as_of", as_of_c)
    arc = archive.select(F.col("save_path").alias("_sp"), F.col("fetched_at").alias("_fetched_at"))
    j = req.join(arc, req["save_path"] == arc["_sp"], "left")
    age = _seconds(F.col("_as_of")) - _seconds(F.col("_fetched_at"))
    fresh = F.lit(True) if ttl_min is None else (F.lit(ttl_min * 60) >= age)
    status = (F.when(F.col("_sp").isNull(), F.lit("miss"))
              .when(fresh, F.lit("hit")).otherwise(F.lit("stale")))
    return j.withColumn("cache_status", status).withColumn("age_s", age) \
        .drop("_sp", "_fetched_at", "_as_of")


def fresh_copies(archive: DataFrame, ttl_min: int | None, as_of: str) -> DataFrame:
    if ttl_min is None:
        return archive
    age = _seconds(F.to_timestamp_ntz(F.lit(as_of))) - _seconds(F.col("fetched_at"))
    return archive.filter(F.lit(ttl_min * 60) >= age)


def fetch_list(manifest: DataFrame, archive: DataFrame, ttl_min: int | None, as_of: str,
               force: bool = False) -> DataFrame:
    """JN3: distinct save paths of a manifest with no fresh copy (all of them
    when ``force``), each with the smallest (url, link_type) naming it."""
    m = manifest.withColumn("save_path", U.save_path("url", F.col("link_type")))
    keys = m.groupBy("save_path").agg(F.min(F.struct("url", "link_type")).alias("m"))
    keys = keys.select("save_path", "m.url", "m.link_type")
    if force:
        return keys
    fresh = fresh_copies(archive, ttl_min, as_of).select("save_path")
    return keys.join(fresh, "save_path", "left_anti")


def cached_list(manifest: DataFrame, archive: DataFrame, ttl_min: int | None, as_of: str) -> DataFrame:
    """JN3 complement: distinct save paths served from a fresh copy (left semi join)."""
    m = manifest.withColumn("save_path", U.save_path("url", F.col("link_type"))).select("save_path").distinct()
    return m.join(fresh_copies(archive, ttl_min, as_of).select("save_path"), "save_path", "left_semi")


def unseen(new: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """SET2: rows of ``new`` whose key is not in ``visited`` (left anti join)."""
    return new.join(visited.select(key).distinct(), key, "left_anti")


def seen(new: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """SET2 (intersect analogue): rows of ``new`` whose key is in ``visited``."""
    return new.join(visited.select(key).distinct(), key, "left_semi")
