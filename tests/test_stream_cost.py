"""What the streams cost: input written and read by several tasks, few calls to the state store."""

import os
import re

import pandas as pd

import __spark_entry__ as E
from sitegraph.session import ensure_checkpoint_dir
from sitegraph.streaming import streams as ST


class _State:
    """A state variable in memory that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return getattr(self, "_" + name)(*args)
        return call

    def _get(self):
        return iter(self.held or []) if isinstance(self.held, list) or self.held is None and self.many else self.held

    def _put(self, rows):
        self.held = list(rows)

    def _appendList(self, rows):
        self.held = (self.held or []) + list(rows)

    def _update(self, row):
        self.held = row

    def _clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.calls, self.states = [], []

    def _state(self, many):
        state = _State(self.calls)
        state.many = many
        self.states.append(state)
        return state

    def getValueState(self, *_):
        return self._state(False)

    def getListState(self, *_):
        return self._state(True)

    def registerTimer(self, at):
        self.calls.append("registerTimer")

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")


class _Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_response_of_many_chunks_takes_few_calls():
    handle, rule = _Handle(), ST._ResponseRule(None)
    rule.init(handle)
    raw = b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(200))
    pieces = [(k, raw[k:k + 1], k == len(raw) - 1) for k in range(len(raw))]
    got = []
    for part in (pieces[150:], pieces[1:100], pieces[99:151], pieces[:1]):
        pdf = pd.DataFrame(part[::-1], columns=["seq", "chunk", "last"]).assign(ts_ms=0)
        got += list(rule.handleInputRows((7,), iter([pdf]), None))
    assert [(r.response_id[0], r.raw[0]) for r in got] == [(7, raw)]
    assert len(handle.calls) <= 20 and all(s.held is None for s in handle.states)


def test_the_paths_of_a_group_are_decided_together():
    handle, rule = _Handle(), ST._FetchRule(600)
    rule.init(handle)
    rows = [(f"p{k}", True, s, s * 1_000_000, 10 * k + j) for k in range(100) for j, s in enumerate((1000, 1100, 1700))]
    pdf = pd.DataFrame(rows, columns=["save_path", "asked", "ts_s", "ts_us", "request_id"])
    assert list(rule.handleInputRows((1,), iter([pdf]), _Watermark(0))) == []
    out = pd.concat(rule.handleExpiredTimer((1,), _Watermark(1_700_000), None))
    assert sorted(out["request_id"]) == sorted(10 * k + j for k in range(100) for j in (0, 2))
    assert list(rule.handleExpiredTimer((1,), _Watermark(2_400_000), None)) == []
    assert len(handle.calls) <= 25 and all(s.held is None for s in handle.states)


def _files(root, pattern):
    return [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if re.match(pattern, n)]


def _folders(spark, name):
    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/streams"
    return {os.path.join(root, n) for n in os.listdir(root) if n.startswith(name)} if os.path.isdir(root) else set()


def _tables(spark, tmp_path):
    rows = [(k, f"https://h{k % 3}.org/p{k}", f"<p>{k}</p>") for k in range(24)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(
        str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_a_micro_batch_of_the_archive_stream_is_written_by_several_tasks(spark, tmp_path):
    before = _folders(spark, "str4-input")
    got = E.queries()["str4_stream_archive"](spark, _tables(spark, tmp_path))
    assert got.count() == 24
    new, = _folders(spark, "str4-input") - before
    assert len(_files(new, r"part-.*\.parquet$")) > 3
