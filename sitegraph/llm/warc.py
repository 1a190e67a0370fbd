"""Operator 1: deterministic sharded WARC writer, and its reader.

The writer turns a table of pages into gzipped WARC 1.1 files:

* Digests are computed where the rows are read.  Of the records with equal
  payloads of at least ``dedup_bytes`` the one with the largest id is a response
  record and the others are revisits of it (rows that share that largest id are
  all responses); shorter payloads are always responses.
* Records are made (headers regenerated, each record a gzip member of its own)
  before any shuffle, so only compressed bytes travel.
* They are range-sorted by (URL, id, digest) and saved with the running size of
  their compressed members.  The sizes of the ranges (one number each) give the
  offset of every record in the whole sequence; a record belongs to file
  ``offset // roll_bytes``.  The files depend on the records alone, not on how
  Spark split them: a second run writes the same bytes.
* A task writes a file under a temporary name of its own, moves it to its final
  name and reports a manifest row (file, records, bytes, SHA-1).  A repeated or
  speculative attempt writes the same bytes under another temporary name.  The
  driver checks that the manifest accounts for every record and writes it as the
  table ``manifest`` last; readers take the files that the manifest lists.

``read_warc`` deals the manifest's files out, and each task parses its files
record by record, checking both digests of every record.

Paths may be of any file system that pyarrow and Spark both open (file, HDFS, S3,
...).  Hot URLs, payloads or sources make no large group: the sort key ends in the
id, and the join on the payload digest is a broadcast of the repeated payloads, when
they are counted to be few, or salted.

Defined results: a null payload is empty; a null URL gives a record without a
target URI; control characters and spaces of a URL are percent-encoded; a null
id leaves out the id header and is null again when read; repeated rows give a
record each; an empty table gives an archive without files; other columns are
left aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, read, utf8

DEDUP_BYTES, ROLL_BYTES, SALTS = 1000, 32 << 20, 16
#: repeated payloads (digest and id) are broadcast up to this count, joined by a salted shuffle above it
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEADER = "X-Record-Key"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sitegraph:warc")
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")

RECORDS_DDL = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
               "refers_to bigint, url string, file string")


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    """Record ids follow from the record, so a second run gives the same."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}|{digest}')}>"


def gzip_member(data: bytes) -> bytes:
    """One gzip member with an empty time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def make_record(key: int | None, url: bytes | None, payload: bytes, refers_to: int | None, revisit: bool,
                date: str = DATE) -> bytes:
    """A whole record, uncompressed; the digest of the payload also stands in revisits."""
    hexed = hashlib.sha1(payload).hexdigest()
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(key, hexed)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url)
        head.append(f"WARC-Target-URI: {safe.decode()}")
    if key is not None:
        head.append(f"{ID_HEADER}: {key}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, hexed)}",
                 f"X-Refers-To-Key: {refers_to}"]
    head += [f"WARC-Payload-Digest: {sha1_base32(payload)}", f"WARC-Block-Digest: {sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as its header says")
    return headers, rest[:size]


def gzip_members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip stream, one after the other."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(size)
        if not data:
            break
        out.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the last gzip member of a file is cut off")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def record_kinds(pages: DataFrame, dedup_bytes: int) -> DataFrame:
    """(digest, first): payloads of at least ``dedup_bytes`` that several rows have, and
    the largest id.  Counted on narrow rows, with a partial count before the shuffle."""
    return (pages.where(F.col("payload_bytes") >= dedup_bytes).groupBy("digest")
            .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))


def members(rows: DataFrame, date: str) -> DataFrame:
    """(url, id, digest, first, member): each row's record as a gzip member."""
    @F.arrow_udf("binary")
    def compress(ids: pa.Array, urls: pa.Array, payloads: pa.Array, first: pa.Array, revisit: pa.Array) -> pa.Array:
        out = [gzip_member(make_record(k, u, p, f, bool(r), date))
               for k, u, p, f, r in zip(ids.to_pylist(), urls.cast(pa.binary()).to_pylist(), utf8(payloads),
                                        first.to_pylist(), revisit.to_pylist())]
        return pa.array(out, type=pa.binary())

    return rows.withColumn("member", compress.asNondeterministic()("id", "url", "payload", "first", "revisit"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
               dedup_bytes: int = DEDUP_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write the pages as WARC files under ``path`` and return the manifest
    (file, records, bytes, sha1), which is also saved as ``path/manifest``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        F.col(payload).alias("payload"), F.unhex(F.sha1(body)).alias("digest"),
                        F.octet_length(body).cast("bigint").alias("payload_bytes"))
    # the response member of every row, made where the row is read; revisits are small and made after the join
    plain = members(rows.withColumns({"first": F.lit(None).cast("bigint"), "revisit": F.lit(False)}), date)
    plain = plain.select("id", "url", "digest", "payload_bytes", "member")
    kinds = scratch.save(record_kinds(rows.select("id", "digest", "payload_bytes"), dedup_bytes), "kinds")
    if kinds.count() <= BROADCAST_ROWS:
        typed = plain.join(F.broadcast(kinds), "digest", "left")
    else:  # a payload may be that of a third of all rows
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        typed = plain.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))).join(
            kinds.withColumn("salt", salts), ["digest", "salt"], "left")
    typed = typed.withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))

    @F.arrow_udf("binary")
    def revise(ids: pa.Array, urls: pa.Array, kept: pa.Array, first: pa.Array, revisit: pa.Array) -> pa.Array:
        out = []
        for k, u, m, f, r in zip(ids.to_pylist(), urls.cast(pa.binary()).to_pylist(), kept.to_pylist(),
                                 first.to_pylist(), revisit.to_pylist()):
            if r:  # the headers of the response, with its payload's digest
                _, block = parse_record(zlib.decompress(m, 31))
                m = gzip_member(make_record(k, u, block.partition(b"\r\n\r\n")[2], f, True, date))
            out.append(m)
        return pa.array(out, type=pa.binary())

    made = typed.withColumn("member", revise("id", "url", "member", "first", "revisit")).select(
        "url", "id", "digest", "member")
    ordered = made.repartitionByRange("url", "id", "digest").sortWithinPartitions("url", "id", "digest")

    def running(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before, n = TaskContext.get().partitionId(), 0, 0
        for part in parts:
            sizes = [len(m) for m in part.column(3).to_pylist()]
            ends, at = [], before
            for s in sizes:
                ends.append(at)
                at += s
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece] * len(sizes), type=pa.int32()), pa.array(range(n, n + len(sizes)), type=pa.int64()),
                 pa.array(ends, type=pa.int64()), pa.array(sizes, type=pa.int64()), part.column(3)],
                names=["piece", "place", "before", "size", "member"])
            before, n = at, n + len(sizes)

    sized = scratch.save(ordered.mapInArrow(
        running, "piece int, place bigint, before bigint, size bigint, member binary"), "members")
    totals = sized.groupBy("piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("piece").collect()
    offset, offsets = 0, []
    for t in totals:  # one row for each range
        offsets.append((t.piece, offset))
        offset += t.bytes
    starts = spark.createDataFrame(offsets or [(0, 0)], "piece int, start bigint")
    filed = sized.join(F.broadcast(starts), "piece").withColumn(
        "file", F.floor((F.col("start") + F.col("before")) / roll_bytes).cast("bigint"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(path)
        context = TaskContext.get()
        mark = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}"
        current, out, done = None, None, []

        def close():
            name = f"part-{current:08d}.warc.gz"
            out["stream"].close()
            files.move(f"{where}/_temporary/{mark}-{name}", f"{where}/{name}")
            done.append((name, out["records"], out["bytes"], out["sha1"].hexdigest()))

        files.create_dir(f"{where}/_temporary", recursive=True)
        for part in parts:
            for number, member in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if number != current:
                    if out is not None:
                        close()
                    current = number
                    stream = files.open_output_stream(
                        f"{where}/_temporary/{mark}-part-{number:08d}.warc.gz", compression=None)
                    out = {"stream": stream, "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                out["stream"].write(member)
                out["sha1"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
        if out is not None:
            close()
        columns = list(zip(*done)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], type=pa.string()), pa.array(columns[1], type=pa.int64()),
             pa.array(columns[2], type=pa.int64()), pa.array(columns[3], type=pa.string())],
            names=["file", "records", "bytes", "sha1"])

    report = (filed.select("file", "member", "piece", "place").repartition("file")
              .sortWithinPartitions("file", "piece", "place").select("file", "member")
              .mapInArrow(write, "file string, records bigint, bytes bigint, sha1 string"))
    report = scratch.save(report, "report")
    counted = report.agg(F.sum("records"), F.sum("bytes"), F.count("*"), F.count_distinct("file")).first()
    if (counted[0] or 0, counted[1] or 0) != (sum(t.n for t in totals), offset) or counted[2] != counted[3]:
        raise RuntimeError(f"the manifest does not account for all records: {counted}")
    report.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    files, where = filesystem(path)
    if files.get_file_info(f"{where}/_temporary").type == pafs.FileType.Directory:
        files.delete_dir(f"{where}/_temporary")
    scratch.purge()
    return spark.read.parquet(f"{path}/manifest")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files that the manifest lists (RECORDS_DDL), digests checked.
    ``payload_bytes`` and ``payload_digest`` are those of the full payload."""
    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(path)
        for part in parts:
            for name in part.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{where}/{name}", compression=None) as stream:
                    for data in gzip_members(stream):
                        rows.append(read_record(data, name))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    listed = spark.read.parquet(f"{path}/manifest").select("file")
    return listed.repartition(max(1, min(listed.count(), 10_000)), "file").mapInArrow(parse, RECORDS_DDL)


def read_record(data: bytes, name: str) -> tuple:
    headers, block = parse_record(data)
    if headers["warc-block-digest"] != sha1_base32(block):
        raise ValueError(f"a block of {name} does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"]
    kind = headers["warc-type"]
    if kind == "response" and (digest != sha1_base32(payload) or size != len(payload)):
        raise ValueError(f"a payload of {name} does not match its digest")
    key, refers = headers.get(ID_HEADER.lower()), headers.get("x-refers-to-key")
    return (None if key is None else int(key), size, base64.b32decode(digest[5:]).hex(), kind,
            None if refers is None else int(refers), headers.get("warc-target-uri"), name)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc-archive").base
    write_warc(read(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM w
"""
