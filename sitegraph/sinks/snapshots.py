"""Snapshot table of archive rows (SNK3, STR4): appended deltas, compacted buckets.

A write adds one folder of rows (a delta) and commits it by one manifest file; rows of
earlier writes are neither read nor rewritten.  A reader takes the newest manifest and
merges what it names: per key the newest row counts.  ``compact`` rewrites only buckets
whose deltas have grown beyond a share of them.

Layout below the root::

    _log/00000000000000000007.json   the whole state after commit 7
    data/<folder>/bucket=<m>-<r>/    rows whose hash is r modulo m

* Commits: a manifest is written under another name and renamed to the next number,
  which fails if that exists.  A writer that loses the race reads the newer state and
  renames again; deltas of several writers add up in any order, and a compaction
  gives up only if another one replaced its buckets.  The store must rename without
  overwriting in one step (HDFS and other file systems with atomic renames).
* A writer that dies leaves files that no manifest names; the table is as before, the
  same call can be repeated, and ``clean`` removes them later.
* Buckets are hash ranges that split as they grow: a compaction divides a bucket above
  ``SPLIT_BYTES``, the others keep theirs.  A bucket is never the work of one task:
  writes are rebalanced by size, merges are shuffled by key.
* Merging reads two narrow columns to find the keys that stand on several rows; whole
  rows are joined and compared for these keys only.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: a bucket above this size is divided when it is compacted
SPLIT_BYTES = 512 << 20
#: share of a bucket that its deltas may have before it is compacted, and their number
DELTA_SHARE, MOST_DELTAS = 0.25, 16
_ATTEMPTS = 50


class Files:
    """The few file operations a commit needs, on the root's own file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))] if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def age_s(self, name: str) -> float:
        now = self._jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def put_if_absent(self, source: str, target: str) -> bool:
        """Rename, unless the target is there."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        here = [self._fs.makeQualified(self._path(p)) for p in (source, target)]
        try:
            context.rename(*here, options)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def _log_name(version: int) -> str:
    return f"_log/{version:020d}.json"


def snapshot(files: Files) -> dict | None:
    """The newest committed state; None if there is no table."""
    versions = [n for n in files.names("_log") if n.endswith(".json") and not n.startswith(".")]
    return json.loads(files.read(f"_log/{max(versions)}")) if versions else None


def commit(files: Files, change) -> dict:
    """Write the state that ``change`` makes of the newest one (None: nothing to do), again
    if another writer was faster."""
    for _ in range(_ATTEMPTS):
        now = snapshot(files)
        new = change(now)
        if new is None:
            return now
        new["version"] = now["version"] + 1 if now else 0
        temporary = f"_log/.{uuid.uuid4().hex}"
        files.write(temporary, json.dumps(new))
        if files.put_if_absent(temporary, _log_name(new["version"])):
            return new
        files.delete(temporary)
    raise RuntimeError(f"{files.root}: {_ATTEMPTS} commits of other writers came first")


# --- rows and buckets ----------------------------------------------------------------------

def newest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key: the newest, of equally new ones the largest.  Keys on several rows are
    found on (key, ts) by a hash aggregate; only their rows are joined, and only rows that
    tie on the time are compared whole."""
    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(ts).alias("_t")).where("_n > 1")

    again = counted(rows.select(key, ts))
    same = rows[key].eqNullSafe(F.col("_k"))
    single = rows.join(again.select("_k"), same, "left_anti")
    top = rows.join(again.select("_k", "_t"), same & rows[ts].eqNullSafe(F.col("_t"))).select(*rows.columns)
    ties = counted(top.select(key, ts)).select("_k")
    same = top[key].eqNullSafe(F.col("_k"))
    tied = top.join(ties, same, "left_semi")
    best = tied.groupBy(key, ts).agg(F.max(F.struct(*[c for c in rows.columns if c not in (key, ts)])).alias("_b"))
    best = best.select(*[F.col(c) if c in (key, ts) else F.col("_b")[c].alias(c) for c in rows.columns])
    return single.unionByName(top.join(ties, same, "left_anti")).unionByName(best)


def bucket_of(key: str, buckets: list[str]):
    """Column: the name ``m-r`` of the live bucket that a key belongs to."""
    kinds: dict[int, list[int]] = {}
    for name in buckets:
        m, r = map(int, name.split("-"))
        kinds.setdefault(m, []).append(r)
    h = F.xxhash64(key)
    out = F.lit(None).cast("string")
    for m, rests in kinds.items():
        r = F.pmod(h, F.lit(m))
        name = F.concat(F.lit(f"{m}-"), r.cast("string"))
        out = F.coalesce(out, name if len(rests) == m else F.when(r.isin(rests), name))
    return out


def _columns(schema: StructType) -> list[str]:
    return [f"{f.name} {f.dataType.simpleString()}" for f in schema]


def _add_folder(files: Files, rows: DataFrame, key: str, buckets: list[str]) -> tuple[str, dict[str, int]]:
    """Write the rows as a new folder that nothing names yet: (folder, bytes by bucket)."""
    folder = uuid.uuid4().hex
    rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket").write \
        .partitionBy("bucket").parquet(f"{files.root}/data/{folder}")
    found = [n for n in files.names(f"data/{folder}") if n.startswith("bucket=")]
    return folder, {n.removeprefix("bucket="): files.size(f"data/{folder}/{n}") for n in found}


def append(rows: DataFrame, root: str, key: str, ts: str, buckets: int = BUCKETS, writer: str | None = None,
           batch: int | None = None) -> None:
    """Add rows to the table at ``root`` (made if absent, with so many buckets).  A writer
    that numbers its batches adds each one once, however often it is repeated."""
    files = Files(rows.sparkSession, root)
    state = snapshot(files)
    if state is None and files.exists() and set(files.names("")) - {"_log", "data"}:
        raise ValueError(f"{root} exists but holds no archive (no _log)")

    def check(now: dict | None) -> None:
        if now and (_columns(StructType.fromJson(now["schema"])) != _columns(rows.schema) or now["key"] != key):
            raise ValueError(f"the archive at {root} has the columns {_columns(StructType.fromJson(now['schema']))} "
                             f"and the key {now['key']}")

    def known(now: dict | None) -> bool:
        return writer is not None and now is not None and now["batches"].get(writer, -1) >= batch

    check(state)
    if known(state):
        return
    live = list(state["buckets"]) if state else [f"{buckets}-{r}" for r in range(buckets)]
    folder, sizes = _add_folder(files, rows, key, live)

    def change(now: dict | None) -> dict | None:
        check(now)
        if known(now) or (now and not sizes and writer is None):
            return None
        new = now or {"schema": json.loads(rows.schema.json()), "key": key, "ts": ts, "batches": {},
                      "buckets": {b: [] for b in live}}
        for b, size in sizes.items():
            # a bucket that was divided meanwhile: its parts read the folder too
            m, r = map(int, b.split("-"))
            for name, held in new["buckets"].items():
                m2, r2 = map(int, name.split("-"))
                if m2 % m == 0 and r2 % m == r:
                    held.append({"folder": folder, "from": b, "bytes": size * m // m2, "delta": True})
        if writer is not None:
            new["batches"][writer] = batch
        return new

    commit(files, change)


def _paths(root: str, parts: list[dict]) -> list[str]:
    return sorted({f"{root}/data/{p['folder']}/bucket={p['from']}" for p in parts})


def _merged(files: Files, state: dict, names: list[str]) -> DataFrame:
    """The newest rows of buckets that hold several folders or a delta."""
    schema = StructType.fromJson(state["schema"])
    rows = files.spark.read.schema(schema).parquet(*_paths(files.root, [p for b in names for p in state["buckets"][b]]))
    # a folder written before a division holds rows of the other parts too
    divided = any(p["from"] != b for b in names for p in state["buckets"][b])
    if divided:
        rows = rows.where(bucket_of(state["key"], list(state["buckets"])).isin(names))
    return newest(rows, state["key"], state["ts"])


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the table as of its newest commit."""
    files = Files(spark, root)
    state = snapshot(files)
    if state is None:
        raise ValueError(f"{root} holds no archive (no _log)")
    schema = StructType.fromJson(state["schema"])
    held = {b: p for b, p in state["buckets"].items() if p}
    plain = [b for b, p in held.items() if len(p) == 1 and not p[0]["delta"] and p[0]["from"] == b]
    rest = [b for b in held if b not in set(plain)]
    out = spark.read.schema(schema).parquet(*_paths(files.root, [held[b][0] for b in plain])) if plain else None
    if rest:
        merged = _merged(files, state, rest)
        out = merged if out is None else out.unionByName(merged)
    return spark.createDataFrame([], schema) if out is None else out


def due(state: dict, share: float = DELTA_SHARE) -> list[str]:
    """Buckets to compact: their deltas have more than this share of their bytes (or are many)."""
    out = []
    for name, parts in state["buckets"].items():
        deltas = [p for p in parts if p["delta"]]
        if deltas and (sum(p["bytes"] for p in deltas) > share * sum(p["bytes"] for p in parts) or len(deltas) > MOST_DELTAS):
            out.append(name)
    return out


def compact(spark: SparkSession, root: str, share: float = DELTA_SHARE, split_bytes: int = SPLIT_BYTES) -> list[str]:
    """Rewrite the buckets that are due as one folder of unique rows each, divided where they are
    large; the other buckets are not touched.  Returns the rewritten buckets."""
    files = Files(spark, root)
    state = snapshot(files)
    names = due(state, share) if state else []
    if not names:
        return []
    replaced = {b: state["buckets"][b] for b in names}
    after: dict[str, list[str]] = {}
    for b, parts in replaced.items():
        m, r = map(int, b.split("-"))
        times = 1
        while sum(p["bytes"] for p in parts) > split_bytes * times:
            times *= 2
        after[b] = [f"{m * times}-{r + k * m}" for k in range(times)]
    live = [n for b in state["buckets"] for n in after.get(b, [b])]
    folder, sizes = _add_folder(files, _merged(files, state, names), state["key"], live)

    def change(now: dict) -> dict | None:
        if any(now["buckets"].get(b, [])[:len(p)] != p for b, p in replaced.items()):
            files.delete(f"data/{folder}")  # another compaction was faster
            return None
        new = {**now, "buckets": {}}
        for b, parts in now["buckets"].items():
            if b not in replaced:
                new["buckets"][b] = parts
                continue
            later = parts[len(replaced[b]):]  # deltas added meanwhile
            for n in after[b]:
                own = [{"folder": folder, "from": n, "bytes": sizes[n], "delta": False}] if n in sizes else []
                new["buckets"][n] = own + [{**p, "bytes": p["bytes"] // len(after[b])} for p in later]
        return new

    done = commit(files, change)
    return names if any(p["folder"] == folder for q in done["buckets"].values() for p in q) else []


def clean(spark: SparkSession, root: str, keep: int = 2, older_than_s: float = 86_400) -> list[str]:
    """Delete manifests but the last ``keep``, and folders and buckets that none of these names
    and that are old enough not to belong to a write under way.  Returns what went."""
    files = Files(spark, root)
    versions = sorted(n for n in files.names("_log") if n.endswith(".json"))
    states = [json.loads(files.read(f"_log/{v}")) for v in versions[-keep:]]
    named = {(p["folder"], p["from"]) for s in states for parts in s["buckets"].values() for p in parts}
    gone = [f"_log/{v}" for v in versions[:-keep]]
    gone += [f"_log/{n}" for n in files.names("_log") if n.startswith(".") and not n.endswith(".crc")
             and files.age_s(f"_log/{n}") >= older_than_s]
    for folder in files.names("data"):
        if files.age_s(f"data/{folder}") < older_than_s:
            continue
        dead = [n for n in files.names(f"data/{folder}") if n.startswith("bucket=")
                and (folder, n.removeprefix("bucket=")) not in named]
        whole = not any(f == folder for f, _ in named)
        gone += [f"data/{folder}"] if whole else [f"data/{folder}/{n}" for n in dead]
    for name in gone:
        files.delete(name)
    return gone
