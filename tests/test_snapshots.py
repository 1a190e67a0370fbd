"""The snapshot archive: merges, crashes at every file operation, races, compaction, cleaning."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest

from sitegraph.sinks import snapshots as S
from sitegraph.sinks import writers as W

SCHEMA = "save_path string, host string, body string, fetched_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def _root():
    return os.path.join(tempfile.mkdtemp(prefix="sg-snap-"), "table")


def _rows(spark, paths, day, body):
    return spark.createDataFrame([(p, "h", body, DAY + timedelta(days=day)) for p in paths], SCHEMA)


def _table(spark, root):
    return {r.save_path: r.body for r in W.read_saved(spark, root).collect()}


def _bytes(root):
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, ns in os.walk(root) for n in ns if n.endswith(".parquet")}


class Killed(Exception):
    pass


def _kill_at(monkeypatch, at):
    """Every file operation counts, before and after it; number ``at`` does not return."""
    count = [0]
    def hook(f):
        def run(*a, **k):
            count[0] += 1
            if count[0] == at:
                raise Killed
            out = f(*a, **k)
            count[0] += 1
            if count[0] == at:
                raise Killed
            return out
        return run
    for name in ("write", "put_if_absent", "delete"):
        monkeypatch.setattr(S.Files, name, hook(getattr(S.Files, name)))
    monkeypatch.setattr(S, "_add_folder", hook(S._add_folder))
    return count


def test_a_killed_write_loses_nothing_and_can_be_repeated(spark, monkeypatch):
    before = {f"p{k}": "old" for k in range(6)}
    after = {**before, "p1": "new", "q": "new"}
    at = 0
    while True:
        at += 1
        root = _root()
        W.write_archive(_rows(spark, before, 0, "old"), root, buckets=2)
        with monkeypatch.context() as m:
            _kill_at(m, at)
            try:
                W.write_archive(_rows(spark, ["p1", "q"], 1, "new"), root)
                done = True
            except Killed:
                done = False
        assert _table(spark, root) in ((after,) if done else (before, after))
        W.write_archive(_rows(spark, ["p1", "q"], 1, "new"), root)
        assert _table(spark, root) == after
        if done:
            break
    assert at > 5


def test_a_killed_compaction_loses_nothing(spark, monkeypatch):
    want = {**{f"p{k}": "old" for k in range(6)}, "p1": "new"}
    at = 0
    while True:
        at += 1
        root = _root()
        W.write_archive(_rows(spark, [f"p{k}" for k in range(6)], 0, "old"), root, buckets=2)
        W.write_archive(_rows(spark, ["p1"], 1, "new"), root)
        with monkeypatch.context() as m:
            _kill_at(m, at)
            try:
                W.compact_archive(spark, root)
                done = True
            except Killed:
                done = False
        assert _table(spark, root) == want
        W.compact_archive(spark, root)
        assert _table(spark, root) == want
        if done:
            break


def test_a_small_batch_writes_a_small_share(spark):
    root = _root()
    rows = spark.range(20_000).selectExpr("concat('p', id) AS save_path", "'h' AS host",
                                          "repeat(sha2(cast(id AS string), 256), 8) AS body",
                                          "timestamp_ntz'2024-01-01 00:00:00' AS fetched_at")
    W.write_archive(rows, root, buckets=4)
    W.compact_archive(spark, root)
    S.clean(spark, root, keep=1, older_than_s=0)
    first = _bytes(root)
    W.write_archive(rows.where("save_path LIKE '%77'").selectExpr(
        "save_path", "host", "reverse(body) AS body", "fetched_at + interval 1 day AS fetched_at"), root)
    more = {p: n for p, n in _bytes(root).items() if p not in first}
    assert set(first) < set(_bytes(root))  # nothing rewritten
    assert sum(more.values()) < 0.03 * sum(first.values())
    assert W.compact_archive(spark, root) == []  # 1 % is below the share
    assert W.read_saved(spark, root).count() == 20_000


def test_only_buckets_that_are_due_are_rewritten(spark):
    root = _root()
    paths = [f"p{k}" for k in range(400)]
    W.write_archive(_rows(spark, paths, 0, "x" * 500), root, buckets=8)
    assert len(W.compact_archive(spark, root)) == 8
    files = S.Files(spark, root)
    kept = S.snapshot(files)["buckets"]
    one = [r.save_path for r in spark.read.parquet(*S._paths(root, kept["8-3"])).collect()]
    W.write_archive(_rows(spark, one, 1, "y" * 500), root)
    assert W.compact_archive(spark, root) == ["8-3"]
    now = S.snapshot(files)["buckets"]
    assert [b for b in now if now[b] != kept[b]] == ["8-3"]
    assert _table(spark, root) == {p: ("y" if p in one else "x") * 500 for p in paths}


def test_buckets_split_as_they_grow(spark):
    root = _root()
    W.write_archive(_rows(spark, [f"p{k}" for k in range(300)], 0, "b"), root, buckets=2)
    size = max(p["bytes"] for q in S.snapshot(S.Files(spark, root))["buckets"].values() for p in q)
    S.compact(spark, root, split_bytes=size // 3)
    names = list(S.snapshot(S.Files(spark, root))["buckets"])
    assert len(names) > 2
    W.write_archive(_rows(spark, [f"p{k}" for k in range(100, 400)], 1, "c"), root)
    assert _table(spark, root) == {f"p{k}": "b" if k < 100 else "c" for k in range(400)}
    S.compact(spark, root)
    assert W.read_saved(spark, root).count() == 400


def test_writers_that_race(spark, monkeypatch):
    """A commit that another writer and a dividing compaction overtake adds up with them."""
    root = _root()
    W.write_archive(_rows(spark, [f"p{k}" for k in range(100)], 0, "old"), root, buckets=2)
    add = S._add_folder
    def overtaken(files, rows, key, live):
        out = add(files, rows, key, live)
        monkeypatch.setattr(S, "_add_folder", add)
        W.write_archive(_rows(spark, ["p1", "other"], 2, "other"), root)
        S.compact(spark, root, split_bytes=100)
        return out
    monkeypatch.setattr(S, "_add_folder", overtaken)
    W.write_archive(_rows(spark, ["p1", "p2", "mine"], 1, "mine"), root)
    assert len(S.snapshot(S.Files(spark, root))["buckets"]) > 2
    want = {**{f"p{k}": "old" for k in range(100)}, "p1": "other", "p2": "mine", "other": "other", "mine": "mine"}
    assert _table(spark, root) == want
    S.compact(spark, root, share=0.0)
    assert _table(spark, root) == want


def test_a_compaction_that_is_overtaken_gives_up(spark, monkeypatch):
    root = _root()
    W.write_archive(_rows(spark, [f"p{k}" for k in range(50)], 0, "old"), root, buckets=2)
    add = S._add_folder
    def overtaken(*a):
        out = add(*a)
        monkeypatch.setattr(S, "_add_folder", add)
        assert S.compact(spark, root)
        return out
    monkeypatch.setattr(S, "_add_folder", overtaken)
    assert S.compact(spark, root) == []
    assert W.read_saved(spark, root).count() == 50


def test_a_numbered_batch_counts_once(spark):
    root = _root()
    for batch in (0, 1, 1, 0):
        W.write_archive(_rows(spark, [f"p{batch}"], batch, "b"), root, writer="stream", batch=batch)
    assert S.snapshot(S.Files(spark, root))["version"] == 1
    assert _table(spark, root) == {"p0": "b", "p1": "b"}


def test_ties_nulls_and_repeated_rows(spark):
    root = _root()
    rows = [("a", "h", "x", DAY), ("a", "h", "y", DAY), ("a", "h", "w", DAY - timedelta(days=1)), (None, "h", "n1", DAY),
            (None, "h", "n2", DAY + timedelta(days=1)), ("b", None, None, None), ("b", None, None, None), ("c", "h", "c", None),
            ("c", "h", "d", DAY)]
    W.write_archive(spark.createDataFrame(rows, SCHEMA), root)
    assert _table(spark, root) == {"a": "y", None: "n2", "b": None, "c": "d"}
    assert W.read_saved(spark, root).count() == 4


def test_clean_keeps_what_is_named(spark):
    root = _root()
    W.write_archive(_rows(spark, ["a", "b", "c"], 0, "1"), root, buckets=2)
    W.write_archive(_rows(spark, ["a"], 1, "2"), root)
    W.compact_archive(spark, root)
    orphan, _ = S._add_folder(S.Files(spark, root), _rows(spark, ["z"], 0, "lost"), "save_path", ["1-0"])
    assert S.clean(spark, root) == ["_log/" + f"{0:020d}.json"]  # the rest is too young
    gone = S.clean(spark, root, keep=1, older_than_s=0)
    assert f"data/{orphan}" in gone and len(gone) > 2
    assert _table(spark, root) == {"a": "2", "b": "1", "c": "1"}
