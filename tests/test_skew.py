"""A third of all rows on one key: results stay whole and exact."""

from collections import defaultdict

from pyspark.sql import functions as F

from sitegraph.operators import aggs as A
from sitegraph.operators import joins as J

N = 200_000


def _requests(spark):
    # every third request hits the same page of the same host
    r = spark.range(N).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, F.lit("https://hot.org/index.html"))
         .otherwise(F.concat(F.lit("https://h"), (F.col("id") % 97).cast("string"), F.lit(".org/p/"),
                             (F.col("id") % 1000).cast("string"))).alias("url"),
        F.lit("HTML").alias("link_type"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    return r


def test_hot_key_lookup_first_and_pacing(spark):
    req = _requests(spark)
    arc = spark.createDataFrame([("hot.org/index.html", "2024-01-01 00:00:00")], "save_path string, fetched_at string") \
        .select("save_path", F.to_timestamp_ntz("fetched_at").alias("fetched_at"))
    look = J.cache_lookup(req, arc, ttl_min=60)
    counts = {r.cache_status: r.n for r in look.groupBy("cache_status").agg(F.count("*").alias("n")).collect()}
    hot = (N + 2) // 3
    assert counts["hit"] == sum(1 for i in range(0, N, 3) if i <= 3600)
    assert counts["stale"] == hot - counts["hit"]
    assert counts["miss"] == N - hot
    first = A.first_per_key(look.select("save_path", "request_id", "ts"), "save_path", ["ts", "request_id"],
                            count_as="n")
    got = {r.save_path: (r.request_id, r.n) for r in first.collect()}
    assert got["hot.org/index.html"] == (0, hot)
    assert sum(n for _, n in got.values()) == N
    plan = A.pacing_plan(A.with_fetch_flag(look).withColumn("host", F.regexp_extract("url", "//([^/]+)", 1)),
                         1000)
    hot_rows = plan.filter(F.col("host") == "hot.org").select("request_id", "offset_ms").collect()
    off = {r.request_id: r.offset_ms for r in hot_rows}
    fetched_before = 0
    for i in range(0, N, 3):
        assert off[i] == fetched_before * 1000
        fetched_before += int(i > 3600)
    assert plan.count() == N
