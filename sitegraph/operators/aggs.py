"""Sets, memoisation, sort and the pacing/retry plans (AGG2-3, SET1, SRT1, WIN1-2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.session import ensure_checkpoint_dir


def url_set(links: DataFrame, seeds: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """AGG2: distinct URLs of the links plus the seeds."""
    u = links.select(F.col(url_col).alias("url"))
    if seeds is not None:
        u = u.unionByName(seeds.select(F.col(url_col).alias("url")))
    return u.distinct()


def first_per_key(df: DataFrame, key: str | list[str], order: str | list[str],
                  count_as: str | None = None) -> DataFrame:
    """AGG3: the first row per key (smallest ``order``), like a memo that
    keeps the first result it saw.  Done with ``min_by`` so that a hot key is
    reduced map-side before the shuffle instead of being sorted in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*others), F.struct(*orders)).alias("_first")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [*keys, "_first.*"] + ([count_as] if count_as else [])
    return out.select(*cols)


def union_levels(*levels: DataFrame) -> DataFrame:
    """SET1: concatenation of levels, then a set."""
    return reduce(lambda a, b: a.unionByName(b), levels).distinct()


def sort_urls(df: DataFrame, cols=("scheme", "netloc", "path")) -> DataFrame:
    """SRT1: total order by URL pieces -- a range-partitioned sort, not one task."""
    return df.orderBy(*cols)


def running_before(df: DataFrame, value: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its group.

    The input is computed once: range-partitioned by (group, order) and written
    as a reliable checkpoint.  A group or hour of any size spans as many
    partitions as it needs; a running sum inside each partition is moved by the
    sums of the partitions before it, one number for each (group, partition)."""
    ensure_checkpoint_dir(df.sparkSession)
    d = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order) \
        .withColumn("_piece", F.spark_partition_id()).checkpoint(eager=True)
    sums = d.groupBy(*group, "_piece").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_piece").alias("_p"),
                       F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_piece") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return d.join(sums, same).select(*df.columns, (F.col("_start") + F.col("_in")).alias(out))


def pacing_plan(requests: DataFrame, period_ms: int, fetch_col: str = "is_fetch",
                group_col: str | None = "host", ts_col: str = "ts", id_col: str = "request_id") -> DataFrame:
    """WIN1: ``offset_ms`` = period x number of network fetches before the
    request in its group (host; None: all requests), i.e. when it may start if
    every fetch is followed by a pause; cache hits cost nothing."""
    r = requests.withColumn("_f", F.col(fetch_col).cast("int")).withColumn("_all", F.lit(0))
    out = running_before(r, "_f", [group_col or "_all"], [ts_col, id_col], "_before")
    return out.withColumn("offset_ms", (F.col("_before") * F.lit(period_ms)).cast("bigint")).drop("_before", "_f", "_all")


def retry_plan(attempts: DataFrame, period_ms: int, outcome_col: str = "outcome",
               ts_col: str = "ts") -> DataFrame:
    """WIN2: a throttled first attempt gets exactly one more attempt three
    periods later; other outcomes get none."""
    retry = F.col(outcome_col) == "throttled"
    at = F.col(ts_col) + F.make_dt_interval(secs=F.lit(3 * period_ms / 1000.0))
    return attempts.withColumn("retry", retry).withColumn("retry_at", F.when(retry, at))


def with_fetch_flag(lookups: DataFrame, status_col: str = "cache_status") -> DataFrame:
    return lookups.withColumn("is_fetch", F.col(status_col) != "hit")


def number_attempts(attempts: DataFrame, url_col: str = "url", ts_col: str = "ts", id_col: str = "request_id") -> DataFrame:
    """WIN2 over captured attempts: ``attempt`` numbers the attempts at a URL in the
    order of time, from 1 (a URL asked for a third of the time spans partitions)."""
    ones = attempts.withColumn("_one", F.lit(1))
    return running_before(ones, "_one", [url_col], [ts_col, id_col], "_before") \
        .withColumn("attempt", (F.col("_before") + 1).cast("int")).drop("_before", "_one")
