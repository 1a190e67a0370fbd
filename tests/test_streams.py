"""Streaming jobs: stream = batch, and the exact TTL rule against a sequential model."""

from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as E
from sitegraph.functions import urls as U
from sitegraph.operators import links as L
from sitegraph.sources import derived as X
from sitegraph.tables import table

SF = "/root/testdata/sf0.001"


def test_stream_manifest_equals_batch(spark):
    streamed = E.queries()["str1_stream_manifest"](spark, SF)
    batch = L.page_links(table(spark, SF, "pages"), "same").select("link_type", "url")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_streams_over_a_table_of_several_files_and_an_empty_one(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.org/p{k}", f'<a href="/x{k % 4}">x</a><a href="http://o.org/">o</a>') for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(5).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    pages.where("page_id < 0").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    for name, scope in (("str1_stream_manifest", "same"), ("str2_stream_url_set", "none")):
        batch = L.page_links(pages, scope).select("link_type", "url")
        batch = batch if name.startswith("str1") else batch.select("url").distinct()
        streamed = E.queries()[name](spark, str(tmp_path / "many"))
        assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) != []
        none = E.queries()[name](spark, str(tmp_path / "none"))
        assert none.columns == batch.columns and none.collect() == []


def test_exact_ttl_stream_matches_sequential_model(spark):
    from sitegraph.queries import TTL_MIN
    got = {(r.save_path, r.request_id) for r in E.queries()["str3_stream_fetch_events"](spark, SF).collect()}
    req = X.requests(spark, SF).withColumn("save_path", U.save_path("url", F.col("link_type")))
    rows = sorted(((r.save_path, r.ts, r.request_id) for r in req.collect()), key=lambda x: (x[1], x[2]))
    last = {}
    exp = set()
    for key, ts, rid in rows:
        secs = int(ts.timestamp()) if ts.tzinfo else int((ts - ts.min).total_seconds())
        if key not in last or secs - last[key] > TTL_MIN * 60:
            exp.add((key, rid))
            last[key] = secs
    assert got == exp
    counts = defaultdict(int)
    for key, _ in got:
        counts[key] += 1
    assert max(counts.values()) >= 1


def _fetches(spark, batches, ttl_min, late):
    """Run the rule over hand-made micro-batches of (request_id, minute): rows and progress."""
    from datetime import datetime, timedelta
    from sitegraph.streaming import streams as ST
    folder, progress = ST.stream_folder(spark, "test-fetch"), []
    schema = "request_id long, url string, link_type string, ts timestamp_ntz"
    for rows in batches:
        rows = [(i, None if i is None else u, "HTML", datetime(2024, 1, 1) + timedelta(minutes=m)) for i, u, m in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = ST.read_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    out = ST.run_available_now(ST.stream_fetch_events(stream, ttl_min, late=late), "test-fetch", progress=progress)
    return sorted(r.request_id for r in spark.read.parquet(out).collect()), progress


def test_late_requests_are_decided_in_the_order_of_time(spark):
    a = "http://h.org/a"
    got, progress = _fetches(spark, [[(1, a, 10), (2, a, 30)], [(3, a, 5), (4, a, 21)], [(5, a, 60), (None, None, 500)]],
                             ttl_min=10, late="40 minutes")
    # by time: 3 (5), 1 (10), 4 (21), 2 (30), 5 (60); a copy lives for ten minutes
    assert got == [3, 4, 5]
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert max(rows) > 0 and rows[-1] == 0, rows  # nothing is kept of a path that is not asked for


def test_too_late_requests_are_dropped_and_boundaries_count(spark):
    a, b = "http://h.org/a", "http://h.org/b"
    got, _ = _fetches(spark, [[(1, a, 100), (2, b, 0)], [(3, a, 110), (4, a, 20), (5, b, 90)], [(6, a, 111), (None, None, 900)]],
                      ttl_min=10, late="5 minutes")
    assert got == [1, 2, 6]  # 3 is exactly ten minutes old: served; 4 and 5 came behind the watermark


def _assembled(spark, batches, **options):
    """Run the assembly over hand-made micro-batches of (id, seq, chunk, last[, ts]): rows and progress."""
    from sitegraph.streaming import streams as ST
    folder, progress = ST.stream_folder(spark, "test-chunks"), []
    schema = "response_id long, seq int, chunk binary, last boolean" + (", ts timestamp_ntz" if options else "")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = ST.read_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1)
    out = ST.run_available_now(ST.stream_responses(stream, **options), "test-chunks", progress=progress)
    return sorted((r.response_id, bytes(r.raw)) for r in spark.read.parquet(out).collect()), progress


def test_responses_are_assembled_from_chunks_in_any_order_and_batch(spark):
    sized = b"HTTP/1.1 200 OK\r\ncontent-LENGTH: 4\r\n\r\nabcd"
    closed = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n\xff\x00\r\n\r\nbody"
    rows = []
    for size in (1, 2, 3, 7, 1000):  # separators across chunks and batches
        pieces = [closed[k:k + size] for k in range(0, len(closed), size)]
        rows += [(size, k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
        # never marked as closed, and with bytes after the body
        pieces = [(sized + b"zz")[k:k + size] for k in range(0, len(sized) + 2, size)]
        rows += [(-size, k, p, False) for k, p in enumerate(pieces)]
    rows += [(50, 1, b"x", True), (60, 0, None, True), (None, 0, b"x", True), (70, None, b"x", True)]  # 50 lacks its start
    batches = [[], [], [], []]
    for k, r in enumerate(sorted(rows, key=lambda r: hash((str(r[0]), r[1], 5)))):
        batches[(k * 7 + (r[1] or 0)) % 4].append(r)
    got, progress = _assembled(spark, batches)
    want = [(s, closed) for s in (1, 2, 3, 7, 1000)] + [(-s, sized) for s in (1, 2, 3, 7, 1000)] + [(60, b"")]
    got = [(i, raw) for i, raw in got if i >= 0 or raw != b""]
    assert got == sorted(want)


def test_repeated_chunks_count_once_and_state_ends_with_the_response(spark):
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    got, progress = _assembled(spark, [[(1, 1, b"b", False), (1, 1, b"b", False), (2, 0, head, False)],
                                       [(1, 1, b"b", False), (1, 2, b"c", True)],
                                       [(1, 0, head, False), (2, 1, b"", True)]])
    assert got == [(1, head + b"bc"), (2, head)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_a_response_without_an_end_is_given_up(spark):
    from datetime import datetime, timedelta

    def at(minute):
        return datetime(2024, 1, 1) + timedelta(minutes=minute)
    got, progress = _assembled(spark, [[(1, 0, b"a", False, at(0)), (2, 0, b"b", False, at(0))],
                                       [(2, 1, b"c", False, at(50))], [(3, 0, b"x", True, at(100))],
                                       [(2, 2, b"d", True, at(104))]],
                               ts_col="ts", late="5 minutes", idle=3600)
    assert got == [(2, b"bcd"), (3, b"x")]  # 1 had nothing for more than an hour
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_streamed_responses_equal_the_batch(spark):
    streamed = E.queries()["src5_stream_responses"](spark, SF)
    batch = E.queries()["src5_assemble_responses"](spark, SF)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
