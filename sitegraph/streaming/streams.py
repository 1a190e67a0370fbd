"""Streaming forms of the link jobs (STR1-4) and of the assembly of responses (SRC5).

Sources are file streams; sinks are parquet folders or ``foreachBatch``
upserts.  Output and state live under the session's checkpoint directory
(``spark.checkpoint.dir``: shared storage on a cluster), never on a
machine-local folder.  ``run_available_now`` drains what is there and stops,
which is how the tests and the registered queries use them.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators import links as L
from sitegraph.sinks import writers as W
from sitegraph.session import ensure_checkpoint_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, folder: str, schema, file_glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet file stream over ``folder`` (new files become new input)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """File stream over the table ``name``.parquet of ``folder``, be it one file or a
    folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return read_stream(spark, path.toString(), schema)
    return read_stream(spark, folder, schema, file_glob=f"{name}.parquet")  # a file stream reads folders


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", progress: list | None = None,
                      base: str | None = None) -> str:
    """Drain the stream into a parquet folder; return the folder.  State is kept in RocksDB
    (on disk, with snapshots below the checkpoint folder), not in the heap.  ``progress``
    gets what Spark reports of each micro-batch.  A run with the ``base`` folder of an
    earlier one goes on from its state and adds to its output."""
    spark = df.sparkSession
    base = base or stream_folder(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        q = (df.writeStream.trigger(availableNow=True).outputMode(output_mode)
             .option("checkpointLocation", base + "/_state").format("parquet").start(base + "/out"))
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
    if progress is not None:
        progress += [json.loads(p.json) for p in q.recentProgress]
    return base + "/out"


def stream_manifest(pages_stream: DataFrame, scope: str = "same") -> DataFrame:
    """STR1: manifest lines emitted as pages arrive (stateless, append)."""
    return L.page_links(pages_stream, scope=scope).select("link_type", "url")


def stream_url_set(links_stream: DataFrame, key: str = "url") -> DataFrame:
    """STR2: each URL once, for ever (state grows with the distinct URLs, like
    the in-process memo it replaces)."""
    return links_stream.select(key).dropDuplicates([key])


def stream_archive(rows_stream: DataFrame, root: str, name: str = "archive", base: str | None = None):
    """STR4: every micro-batch is appended to the archive at ``root`` (SNK3): the
    newest copy per save path counts.  The table remembers the last batch of this
    stream, so one that is repeated after a failure is added once.  Buckets whose
    deltas have become a large share are compacted after a batch, the others stay.
    A run with the ``base`` folder of an earlier one goes on after its batches."""
    spark = rows_stream.sparkSession
    base = base or stream_folder(spark, name)

    def add(df, number):
        W.write_archive(df, root, writer=base, batch=number)
        W.compact_archive(spark, root)

    q = (rows_stream.writeStream.trigger(availableNow=True)
         .option("checkpointLocation", base + "/_state").foreachBatch(add).start())
    q.awaitTermination()
    return root


def _epoch(c, unit: str):
    return F.timestamp_diff(unit, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c.cast("timestamp_ntz"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FetchRule:
    """State of a group of save paths: the second of each path's last fetch, and the requests
    (the first of each path and second) that the watermark has not passed yet.  Requests are
    decided in the order of time once no earlier one can come; a fetch is forgotten as soon
    as no later request can be served from its copy, so both fall to nothing when paths are
    not asked for.  A group's state is read and written as a whole, once a micro-batch."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle) -> None:
        self.handle = handle
        self.fetched = handle.getListState("fetched", "save_path string, ts_s long")
        self.pending = handle.getListState("pending", "save_path string, ts_s long, ts_us long, request_id long")
        self.timer = handle.getValueState("timer", "at long")

    def _forgotten_at(self, fetched: int) -> int:
        """Watermark (ms) from which a request is later than the copy of this second lives."""
        return (fetched + self.ttl_s + 1) * 1000 - 1

    def _decide(self, rows, watermark: int):
        """Decide what the watermark has passed, keep the rest, set the next timer."""
        import pandas as pd
        timer = self.timer.get()
        known = timer is not None  # a group without a timer has no state
        last = dict(map(tuple, self.fetched.get())) if known else {}
        first = {(r[0], r[1]): tuple(r) for r in self.pending.get()} if known else {}
        had = bool(last), bool(first)
        for r in rows:
            have = first.get(r[:2])
            if have is None or r[2:] < have[2:]:
                first[r[:2]] = r
        out, late = [], []
        for r in sorted(first.values(), key=lambda r: r[2:]):
            path, ts_s, ts_us, request_id = r
            if ts_us // 1000 > watermark:
                late.append(r)
            elif path not in last or ts_s - last[path] > self.ttl_s:
                last[path] = ts_s
                out.append((path, request_id, ts_s))
        last = {path: ts_s for path, ts_s in last.items() if watermark < self._forgotten_at(ts_s)}
        for state, rows_, before in ((self.fetched, list(last.items()), had[0]), (self.pending, late, had[1])):
            if rows_:
                state.put(rows_)
            elif before:
                state.clear()
        ends = [self._forgotten_at(min(last.values()))] if last else []
        ends += [late[0][2] // 1000 + 1] if late else []
        if known and (not ends or timer[0] != min(ends)):
            if timer[0] > watermark:  # else it has expired
                self.handle.deleteTimer(timer[0])
            if not ends:
                self.timer.clear()
        if ends and (not known or timer[0] != min(ends)):
            self.handle.registerTimer(min(ends))
            self.timer.update((min(ends),))
        if out:
            yield pd.DataFrame(out, columns=["save_path", "request_id", "ts_s"])

    def handleInputRows(self, key, rows, timerValues):
        watermark, some = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            pdf = pdf[pdf["asked"] & (pdf["ts_us"] // 1000 > watermark)]  # else too late
            some += zip(pdf["save_path"].tolist(), pdf["ts_s"].tolist(), pdf["ts_us"].tolist(), pdf["request_id"].tolist())
        if some:
            yield from self._decide(some, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._decide([], timerValues.getCurrentWatermarkInMs())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        pass

    def close(self) -> None:
        pass


def stream_fetch_events(requests_stream: DataFrame, ttl_min: int, ts_col: str = "ts", late: str = "1 hour",
                        groups: int = 1024) -> DataFrame:
    """STR3, exact: the requests that trigger a network fetch when a copy is reused
    while ``ttl*60 >= now - fetched`` (whole seconds), i.e. a key is fetched again only
    once its last copy is older than the TTL.

    Requests may come in any order and batch, up to ``late`` behind the newest one; what
    comes later is dropped.  A request is decided once the watermark has passed it, so
    the result is that of the requests in the order of time.  State (RocksDB, with
    event-time timers) holds a path's undecided requests, one for each second, and the
    time of its last fetch until the copy is too old for any request to come.  Paths are dealt
    by their hash into so many ``groups``, whose state is read and written together: a call
    to the state store costs far more than a path's row, so with a group for each path these
    calls are nearly all of the time.  More groups suit more paths or smaller micro-batches.
    A row without a request id (a heartbeat) only moves the watermark on.
    Output: (save_path, request_id, ts_s) of the fetching requests."""
    from pyspark.sql.streaming import StatefulProcessor

    rule = type("FetchRule", (_FetchRule, StatefulProcessor), {})
    ts_us = _epoch(F.col(ts_col), "MICROSECOND")
    path = U.save_path("url", F.col("link_type"))
    # no nulls among the numbers, which pandas would take for floats: a request without time is too late
    r = requests_stream.select(F.timestamp_micros(ts_us).alias("event_time"), path.alias("save_path"),
                               F.col("request_id").isNotNull().alias("asked"),
                               F.coalesce(F.col("request_id").cast("long"), F.lit(0)).alias("request_id"),
                               F.coalesce(_epoch(F.col(ts_col), "SECOND"), F.lit(-1 << 62)).alias("ts_s"),
                               F.coalesce(ts_us, F.lit(-1 << 62)).alias("ts_us"))
    r = r.withColumn("path_group", F.pmod(F.xxhash64("save_path"), F.lit(groups)))
    return r.withWatermark("event_time", late).groupBy("path_group").transformWithStateInPandas(
        rule(int(ttl_min) * 60), "save_path string, request_id long, ts_s long", "Append", "EventTime")


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$")


class _ResponseRule:
    """State of one response: ``pieces``, its chunks by number as they came; ``at``, how far it
    has come without a gap and the sizes of the chunks ahead of the gap.  A chunk is stored
    once and read when the response is complete, and before only where the head still goes on
    in it; a micro-batch takes a few calls to the state store, whatever the number of chunks."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms  # None: nothing is given up

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState(
            "at", "next long, last long, ended boolean, head binary, wanted long, have long, until long, ahead binary")
        self.pieces = handle.getListState("pieces", "seq long, piece binary")

    def _forget(self) -> None:
        for state in (self.at, self.pieces):
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd
        at = self.at.get()
        known = at is not None
        next_, last, ended, head, wanted, have, until, ahead = tuple(at) if known else (0, -1, False, b"", -1, 0, None, b"")
        sizes: dict[int, int] = dict(np.frombuffer(bytes(ahead), dtype=np.int64).reshape(-1, 2).tolist())
        new: dict[int, bytes] = {}
        newest = 0
        for pdf in rows:
            newest = max(newest, int(pdf["ts_ms"].max()))
            for seq, chunk, end in zip(pdf["seq"].tolist(), pdf["chunk"].tolist(), pdf["last"].tolist()):
                if end:
                    last = seq
                if seq >= next_ and seq not in sizes and seq not in new:
                    new[seq] = bytes(chunk) if chunk is not None else b""
        sizes.update((seq, len(chunk)) for seq, chunk in new.items())
        held = None

        def complete() -> bool:
            return 0 <= last < next_ or (ended and 0 <= wanted <= have)

        while not complete() and next_ in sizes:
            size = sizes.pop(next_)
            next_ += 1
            if ended:
                have += size
                continue
            chunk = new.get(next_ - 1)
            if chunk is None:
                held = held or {seq: bytes(piece) for seq, piece in self.pieces.get()}
                chunk = held[next_ - 1]
            start = max(0, len(head) - 3)  # a separator may lie across chunks
            head = bytes(head) + chunk
            cut = head.find(b"\r\n\r\n", start)
            if cut >= 0:
                found = _LENGTH.search(head, 0, cut)
                ended, wanted, have = True, int(found.group(1)) if found else -1, len(head) - cut - 4
                head = b""
        if complete():
            if until is not None:
                self.handle.deleteTimer(until)
            if known:
                new.update(held or {seq: bytes(piece) for seq, piece in self.pieces.get()})
                self._forget()
            raw = b"".join(new[seq] for seq in range(next_))
            if ended and 0 <= wanted < have:
                raw = raw[:len(raw) - (have - wanted)]
            yield pd.DataFrame({"response_id": [key[0]], "raw": [raw]})
            return
        if new:
            self.pieces.appendList(list(new.items()))
        if self.idle_ms is not None and (until is None or newest + self.idle_ms > until):
            if until is not None:
                self.handle.deleteTimer(until)
            until = newest + self.idle_ms
            self.handle.registerTimer(until)
        ahead = np.array(sorted(sizes.items()), dtype=np.int64).tobytes()
        self.at.update((next_, last, ended, bytes(head), wanted, have, until, ahead))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._forget()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        pass

    def close(self) -> None:
        pass


def stream_responses(chunks_stream: DataFrame, id_col: str = "response_id", ts_col: str | None = None,
                     late: str = "1 hour", idle: int = 3600) -> DataFrame:
    """SRC5 as a stream: ``(response_id, raw)`` of each response as soon as it is complete, from
    chunks (``response_id, seq, chunk, last``) in any order and batch.

    It is complete when all chunks up to the one marked ``last`` (the connection's end) are
    there, or when the head has ended, at the first CRLFCRLF wherever chunks are cut, and the
    body has the bytes that Content-Length names; what comes after these is left out.  The
    first of several chunks of one number counts.  A null chunk is empty; rows without an id
    or a number are left out, and chunks that come again after their response are a new
    response under way.

    State (RocksDB) is that of the responses under way.  With ``ts_col``, the time of a chunk, a
    response is given up without a row once the watermark (``late`` behind the newest chunk)
    is ``idle`` seconds past its last chunk, and chunks behind the watermark are dropped;
    without it a response that never ends keeps its state."""
    from pyspark.sql.streaming import StatefulProcessor

    rule = type("ResponseRule", (_ResponseRule, StatefulProcessor), {})
    c = chunks_stream.where(F.col(id_col).isNotNull() & (F.col("seq") >= 0))
    timed = [] if ts_col is None else [F.timestamp_micros(_epoch(F.col(ts_col), "MICROSECOND")).alias("event_time")]
    ms = F.lit(0).cast("long") if ts_col is None else _epoch(F.col(ts_col), "MILLISECOND")
    c = c.select(*timed, F.col(id_col).alias("response_id"), F.col("seq").cast("long").alias("seq"), "chunk",
                 F.coalesce("last", F.lit(False)).alias("last"), ms.alias("ts_ms"))
    kind = c.schema["response_id"].dataType.simpleString()
    grouped = (c if ts_col is None else c.where("event_time IS NOT NULL").withWatermark("event_time", late)).groupBy("response_id")
    out = grouped.transformWithStateInPandas(rule(None if ts_col is None else idle * 1000), f"response_id {kind}, raw binary",
                                             "Append", "None" if ts_col is None else "EventTime")
    return out.withColumnRenamed("response_id", id_col)
