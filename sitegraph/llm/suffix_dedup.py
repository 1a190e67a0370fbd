"""Operator 6: removal of repeated byte strings by difference-cover suffix sorting.

Removes every byte covered by a ``LENGTH``-byte string that also starts earlier
(smaller document id, or the same document and an earlier start).  Only prefixes
of ``LENGTH`` bytes of the suffixes matter, so the difference-cover algorithm stops
there:

1. *Sample.*  ``COVER`` is a difference cover modulo ``PERIOD``: for any two
   positions some shift below ``PERIOD`` takes both to sampled residues.  If two
   100-byte strings are equal, the sampled suffixes at that shift inside them
   share at least ``LENGTH - PERIOD + 1`` bytes.
2. *Name.*  Sampled suffixes are named by that many bytes (hashes of as many bits
   as make a chance collision rare) and the names are sorted, a range of names to
   a task.  One level of names spans the whole prefix that counts, so there is
   nothing left to recurse on; suffixes of a unique name are discarded, since no
   100-byte string around them can repeat.
3. *Merge.*  The remaining suffixes are all positions within a period before a
   repeated sample.  They are dealt out by an anchor that depends on the 100 bytes
   alone (the leftmost smallest hash of 8 bytes in them), so equal prefixes meet.
   Neighbours with one anchor travel as one stretch of text.
4. *Compare.*  A task sorts its suffixes by the (128-bit hashed) prefix, then place;
   of neighbours with equal prefixes all but the first are repeats.  The edges of a
   frequent passage share an anchor and differ in text, so their bucket grows with the
   corpus: the suffixes of buckets over ``HEAVY_BYTES`` are dealt out once more, by the
   hash of the whole prefix, each distinct prefix of a chunk once.

Documents travel in compressed chunks of ``CHUNK_BYTES``; what a chunk repeats
within itself is found there, and of equal stretches only the first leaves it, so
a frequent passage sends one stretch per chunk.  Whole copies of a text are
settled beforehand by their digests.  Nothing but counts reaches the driver.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing;
rows with equal id and text are one document and get equal results; rows with
equal ids and different texts are ordered by start alone; null ids come last;
an empty table gives an empty result; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, mix64, read, release, utf8

LENGTH, PERIOD = 100, 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # a perfect difference set modulo 57
CHUNK_BYTES, BUCKET_NAMES, ANCHOR = 4 << 20, 1 << 21, 8
BUCKET_BYTES, HEAVY_BYTES, PART_BYTES = 8 << 20, 12 << 20, 4 << 20
SLICE = 1 << 19  # positions that are hashed or sorted at a time: what a worker holds is a few bytes a position beside
LAST_ID = (1 << 63) - 1
BROADCAST_ROWS = 1_000_000
SEPARATOR = 0xFF  # in no UTF-8 text
CHUNKS_DDL = "chunk bigint, ids binary, sizes binary, body binary"
CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])


class Hashes:
    """Hashes of all windows of a byte array: sums of random 64-bit values of the
    bytes times powers of an odd base, modulo 2^64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003))
        base = int(mix64(np.array([seed], dtype=np.uint64))[0]) | 1
        n = len(data)
        powers = _powers(base, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * powers[:n], out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), n)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes at each position (the caller keeps them inside)."""
        return mix64((self.sums[at + size] - self.sums[at]) * self.inverse[at])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n + 1:
        out = np.full(n + 1, base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base]


def window_hashes(data: np.ndarray, at: np.ndarray, sizes: np.ndarray | int, seed: int = 1) -> np.ndarray:
    """Hashes of ``sizes`` bytes at each of the ascending positions, a slice of the data after the other."""
    out = np.empty(len(at), dtype=np.uint64)
    for a, b in blocks(at):
        low, size = at[a], sizes if isinstance(sizes, int) else sizes[a:b]
        piece = data[low:int((at[a:b] + size).max())]
        out[a:b] = Hashes(piece, seed).windows(at[a:b] - low, size)
    return out


def blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of ascending positions within one SLICE."""
    if len(at):
        edges = np.append(np.searchsorted(at, np.arange(0, int(at[-1]) + 1, SLICE)), len(at))
        yield from ((int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a)


class Chunk:
    """Documents of a chunk: ids, places and bytes, a separator after each text."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.sizes = np.frombuffer(sizes, dtype=np.int64)
        self.data = np.frombuffer(zstandard.decompress(body), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1

    def inside(self, size: int) -> np.ndarray:
        """At which positions ``size`` bytes of one document start."""
        ok = np.zeros(len(self.data) + 1, dtype=np.int32)
        long = self.sizes >= size
        np.add.at(ok, self.starts[long], 1)
        np.add.at(ok, self.starts[long] + self.sizes[long] - size + 1, -1)
        return np.cumsum(ok[:-1], dtype=np.int32) > 0

    def samples(self, size: int) -> np.ndarray:
        """Positions of the difference cover with ``size`` bytes of their document ahead."""
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        offset = np.arange(len(self.data), dtype=kind) - np.repeat(self.starts.astype(kind), self.sizes + 1)
        offset %= PERIOD
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        return np.flatnonzero(cover[offset] & self.inside(size))


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned values: differences in byte planes, compressed."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def to_chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """The documents (doc_id, text) in rows of about ``chunk_bytes`` of text."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, bodies, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            sizes = np.array([len(b) for b in bodies], dtype=np.int64)
            body = zstandard.compress(b"".join(x for b in bodies for x in (b, b"\xff")), 3)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([np.array(ids, dtype=np.int64).tobytes()], type=pa.binary()),
                 pa.array([sizes.tobytes()], type=pa.binary()), pa.array([body], type=pa.binary())], schema=CHUNKS)

        for part in parts:
            for own, body in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                ids.append(own)
                bodies.append(body)
                held += len(body) + 1
                if held >= chunk_bytes:
                    yield chunk()
                    number += 1
                    ids, bodies, held = [], [], 0
        if ids:
            yield chunk()

    return rows.mapInArrow(run, CHUNKS_DDL)


def each_chunk(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for part in parts:
        for k in range(part.num_rows):
            number, *rest = (c[k].as_py() for c in part.columns[:4])
            yield number, Chunk(*rest)


def repeated_names(chunks: DataFrame, bits: int, buckets: int, size: int) -> DataFrame:
    """(chunk, names): the names of a chunk's samples that other chunks have too, one
    row for each range of names."""
    def name(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in each_chunk(parts):
            names = np.unique(sample_names(chunk, bits, size)[1])
            which = (names >> np.uint64(max(bits - 32, 0))) * np.uint64(buckets) >> np.uint64(min(bits, 32))
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1])[:len(which)])
            for a, b in zip(first, np.append(first[1:], len(names))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(which[a])], type=pa.int32()), pa.array([number]), pa.array([packed(names[a:b])], type=pa.binary())],
                    names=["bucket", "chunk", "names"])
            release()

    def meet(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_numpy()
        sets = [unpacked(x) for x in group.column("names").to_pylist()]
        names = np.concatenate(sets)
        names.sort()
        twice = np.unique(names[1:][names[1:] == names[:-1]])
        del names
        out_chunk, out = [], []
        for c, s in zip(chunk.tolist(), sets):
            own = s[among(s, twice)]
            if len(own):
                out_chunk.append(c)
                out.append(packed(own))
        release()
        return pa.table({"chunk": pa.array(out_chunk, type=pa.int64()), "names": pa.array(out, type=pa.binary())})

    return (chunks.mapInArrow(name, "bucket int, chunk bigint, names binary").groupBy("bucket")
            .applyInArrow(meet, "chunk bigint, names binary"))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def sample_names(chunk: Chunk, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = chunk.samples(size)
    return at, window_hashes(chunk.data, at, size) >> np.uint64(64 - bits)


def candidates(chunk: Chunk, names: np.ndarray, bits: int, size: int, length: int) -> np.ndarray:
    """Which positions start ``length`` bytes that may repeat: within a period before a
    sample whose name other chunks have, or this one has twice."""
    at, own = sample_names(chunk, bits, size)
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    hit = at[again | np.isin(own, names)]
    marks = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    np.add.at(marks, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(marks, hit + 1, -1)
    return (np.cumsum(marks[:-1], dtype=np.int32) > 0) & chunk.inside(length)


def anchors(data: np.ndarray, length: int) -> np.ndarray:
    """Position of the anchor of the ``length`` bytes at each position: the leftmost
    smallest hash of ANCHOR bytes inside them."""
    count = len(data) - ANCHOR + 1
    keys = np.zeros(count, dtype=np.uint64)
    for j in range(ANCHOR):
        keys = (keys << np.uint64(8)) | data[j:count + j]
    low = np.uint64((1 << 32) - 1)
    least = (mix64(keys) & ~low) | np.arange(count, dtype=np.uint64)
    span, width = 1, length - ANCHOR + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    return (least & low).astype(np.int64)


def anchors_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The anchors of ascending positions, a slice of the data after the other."""
    out = np.empty(len(at), dtype=np.int64)
    for a, b in blocks(at):
        low = at[a]
        out[a:b] = anchors(data[low:at[b - 1] + length], length)[at[a:b] - low] + low
    return out


STRETCHES_DDL = "bucket int, chunk bigint, bytes bigint, ids binary, starts binary, sizes binary, body binary, runs binary"
STRETCHES = pa.schema([("bucket", pa.int32()), *[(n, pa.int64() if n in ("chunk", "bytes") else pa.binary())
                                                  for n in ("chunk", "bytes", "ids", "starts", "sizes", "body", "runs")]])


def runs_of(flags: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values, as rows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def stretches(number: int, chunk: Chunk, names: np.ndarray, bits: int, size: int, length: int,
              buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's remaining suffixes by bucket of their anchor, and (bucket -1) the runs of
    positions that repeat an earlier stretch of the chunk."""
    marked = candidates(chunk, names, bits, size, length)
    at = np.flatnonzero(marked)
    if not len(at):
        return
    anchor = anchors_at(chunk.data, at, length)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])))
    start = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + length  # of the stretch's bytes
    doc = np.searchsorted(chunk.starts, start, side="right") - 1
    sizes = end - start
    name, other = window_hashes(chunk.data, start, sizes, 1), window_hashes(chunk.data, start, sizes, 2)
    order = np.lexsort((start - chunk.starts[doc], chunk.ids[doc], sizes, other, name))
    same = np.append(False, (name[order][1:] == name[order][:-1]) & (other[order][1:] == other[order][:-1])
                     & (sizes[order][1:] == sizes[order][:-1]))
    later = order[same]
    flags = np.zeros(len(chunk.data), dtype=bool)
    for a, b in zip(start[later].tolist(), (end[later] - length + 1).tolist()):
        flags[a:b] = True
    empty = b""
    yield pa.RecordBatch.from_arrays(
        [pa.array([x], type=f.type) for x, f in zip((-1, number, 0, empty, empty, empty, empty,
                                                     runs_of(flags).astype(np.int64).tobytes()), STRETCHES)], schema=STRETCHES)
    sent = np.sort(order[~same])
    gram = np.zeros(len(sent), dtype=np.uint64)
    for j in range(ANCHOR):
        gram = (gram << np.uint64(8)) | chunk.data[anchor[first[sent]] + j]
    bucket = (mix64(gram + np.uint64(7)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    by = np.argsort(bucket, kind="stable")
    sent, bucket = sent[by], bucket[by]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
    text = chunk.data.tobytes()
    for a, b in zip(cuts, np.append(cuts[1:], len(sent))):
        own = sent[a:b]
        body = zstandard.compress(b"".join(text[x:y] for x, y in zip(start[own].tolist(), end[own].tolist())), 3)
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(
            (int(bucket[a]), number, int(sizes[own].sum()), chunk.ids[doc[own]].tobytes(),
             np.stack([start[own], start[own] - chunk.starts[doc[own]]]).astype(np.int64).tobytes(),
             sizes[own].astype(np.int64).tobytes(), body, empty), STRETCHES)], schema=STRETCHES)


class Suffixes:
    """Suffixes: chunk, place in it, document id and place in the document, and the
    128-bit hash of their prefix."""

    FIELDS = ("chunk", "place", "ids", "offset", "one", "two")

    def __init__(self, *columns: np.ndarray):
        self.columns = dict(zip(self.FIELDS, columns))

    def __len__(self) -> int:
        return len(self.columns["one"])

    def take(self, which: np.ndarray) -> Suffixes:
        return Suffixes(*[c[which] for c in self.columns.values()])

    def ordered(self) -> tuple[Suffixes, np.ndarray, np.ndarray]:
        """The suffixes by prefix and place; which of them repeat the first with their prefix, and which
        are that first.  A string of the same document and start is the same string."""
        c = self.columns
        own = self.take(np.lexsort((c["offset"], c["ids"], c["two"], c["one"])))
        c = own.columns
        new = np.append(True, (c["one"][1:] != c["one"][:-1]) | (c["two"][1:] != c["two"][:-1]))[:len(own)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        leads = (c["ids"] == c["ids"][first]) & (c["offset"] == c["offset"][first])
        return own, ~leads, leads

    def parts(self, n: int) -> Iterator[tuple[int, Suffixes]]:
        """The suffixes by ``n`` ranges of the hash of their prefix."""
        which = (self.columns["one"] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        for k in range(n):
            if len(at := np.flatnonzero(which == k)):
                yield k, self.take(at)


def suffixes(chunk: int, ids: bytes, starts: bytes, sizes: bytes, body: bytes, length: int) -> Suffixes:
    """The suffixes of a row of stretches."""
    ids, size = np.frombuffer(ids, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64)
    start, offset = np.frombuffer(starts, dtype=np.int64).reshape(2, -1)
    data = np.frombuffer(zstandard.decompress(body), dtype=np.uint8)
    count = size - length + 1
    stretch = np.repeat(np.arange(len(size)), count)
    inner = np.arange(len(stretch)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(size) - size)[stretch] + inner
    return Suffixes(np.full(len(at), chunk, dtype=np.int64), start[stretch] + inner, ids[stretch], offset[stretch] + inner,
                    window_hashes(data, at, length, 1), window_hashes(data, at, length, 2))


def runs_by_chunk(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """(chunk, runs) of (chunk, place) of repeats."""
    if not sum(len(c) for c, _ in found):
        return
    chunk, place = np.concatenate([c for c, _ in found]), np.concatenate([p for _, p in found])
    by = np.lexsort((place, chunk))
    chunk, place = chunk[by], place[by]
    cuts = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(chunk))):
        p = place[a:b]
        new = np.flatnonzero(np.append(True, p[1:] > p[:-1] + 1))
        ends = np.append(p[new[1:] - 1], p[-1]) + 1
        yield int(chunk[a]), np.stack([p[new], ends], axis=1).astype(np.int64).tobytes()


def repeated(rows: list[Suffixes]) -> pa.Table:
    """(chunk, runs): which of these suffixes start a string that starts earlier too.  They are sorted
    by ranges of their hashes, so that the copies of a sort are small."""
    n = sum(len(r) for r in rows) // SLICE + 1
    columns = [np.concatenate([r.columns[f] for r in rows]) for f in Suffixes.FIELDS]
    rows.clear()
    found = []
    for _, part in Suffixes(*columns).parts(n):
        own, later, _ = part.ordered()
        found.append((own.columns["chunk"][later], own.columns["place"][later]))
    del columns
    out = list(runs_by_chunk(found))
    return pa.table({"chunk": pa.array([c for c, _ in out], type=pa.int64()), "runs": pa.array([r for _, r in out], type=pa.binary())})


def repeats(group: pa.Table, length: int) -> pa.Table:
    """(chunk, runs): the repeats in a bucket of stretches."""
    columns = [group.column(n).to_pylist() for n in ("chunk", "ids", "starts", "sizes", "body")]
    out = repeated([suffixes(*row, length) for row in zip(*columns)])
    release()
    return out


PARTS_DDL = "bucket int, part int, chunk bigint, suffixes binary, runs binary"


def dealt_again(rows: DataFrame, length: int) -> DataFrame:
    """PARTS_DDL of the rows (bucket, chunk, ids, starts, sizes, body, parts) of heavy buckets: their
    suffixes by ranges of the hash of the prefix, and (part -1) the runs of positions whose prefix
    the row has at an earlier place.  Of equal prefixes only the first leaves it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(
                values, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "part", "chunk", "suffixes", "runs"])

        for batch in batches:
            for k in range(batch.num_rows):
                bucket, chunk, *data, parts = (c[k].as_py() for c in batch.columns)
                found = []
                for part, some in suffixes(chunk, *data, length).parts(parts):
                    own, later, leads = some.ordered()
                    found.append((own.columns["chunk"][later], own.columns["place"][later]))
                    sent = own.take(np.flatnonzero(leads)).columns
                    yield row(bucket, part, chunk, zstandard.compress(b"".join(
                        np.ascontiguousarray(sent[f].view(np.uint8).reshape(-1, 8).T).tobytes() for f in Suffixes.FIELDS[1:]), 1), b"")
                for number, runs in runs_by_chunk(found):
                    yield row(bucket, -1, number, b"", runs)
            release()

    return rows.select("bucket", "chunk", "ids", "starts", "sizes", "body", "parts").mapInArrow(run, PARTS_DDL)


def repeats_of_part(group: pa.Table) -> pa.Table:
    """(chunk, runs): the repeats in a part of a heavy bucket."""
    rows = []
    for chunk, data in zip(group.column("chunk").to_pylist(), group.column("suffixes").to_pylist()):
        planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(len(Suffixes.FIELDS) - 1, 8, -1)
        values = [np.ascontiguousarray(p.T).view(np.int64).ravel() for p in planes]
        rows.append(Suffixes(np.full(len(values[0]), chunk, dtype=np.int64), *values[:3], *[v.view(np.uint64) for v in values[3:]]))
    out = repeated(rows)
    release()
    return out


SPANS = "array<struct<first:bigint,end:bigint>>"
RESULT_DDL = (f"doc_id bigint, digest binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              f"spans {SPANS}")
RESULT = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])


def cut_documents(chunk: Chunk, runs: list[bytes], length: int) -> pa.Table:
    """A row for each document of a chunk: what its repeated strings cover."""
    marks = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    for r in runs:
        pairs = np.frombuffer(r, dtype=np.int64).reshape(-1, 2)
        np.add.at(marks, pairs[:, 0], 1)
        np.add.at(marks, pairs[:, 1] - 1 + length, -1)
    gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
    rows = []
    for own, start, size in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.sizes.tolist()):
        removed, body = gone[start:start + size], chunk.data[start:start + size]
        spans = runs_of(removed).tolist()
        digest = hashlib.sha256(body).digest()
        kept = hashlib.sha256(body[~removed]).hexdigest() if spans else digest.hex()
        rows.append((own, digest, size, int(removed.sum()), len(spans), kept,
                     [{"first": a, "end": b} for a, b in spans]))
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)


def repeated_strings(docs: DataFrame, scratch: Scratch, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES,
                     bucket_names: int = BUCKET_NAMES, bucket_bytes: int = BUCKET_BYTES, heavy_bytes: int = HEAVY_BYTES,
                     part_bytes: int = PART_BYTES) -> DataFrame:
    """RESULT_DDL of the documents (doc_id, text), which are distinct."""
    size = length - PERIOD + 1
    chunks = scratch.save(to_chunks(docs, chunk_bytes), "chunks")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_samples = total * len(COVER) // PERIOD + 1
    bits = min(64, n_samples.bit_length() + 13)  # a name's chance of a false partner is about 2^-13
    names = repeated_names(chunks, bits, max(1, n_samples // bucket_names), size)
    buckets = max(1, total // bucket_bytes)

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [unpacked(x) for x in right.column("names").to_pylist()] if right.num_rows else []
        known = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
        out = [b for number, chunk in each_chunk(left.to_batches()) for b in
               stretches(number, chunk, known, bits, size, length, buckets)]
        release()
        return pa.Table.from_batches(out, schema=STRETCHES)

    merged = scratch.save(chunks.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(merge, STRETCHES_DDL), "stretches")
    sent = merged.where("bucket >= 0").drop("runs")
    # a row for each heavy bucket: at most a small number for each 8 MB of text
    heavy = scratch.save(sent.groupBy("bucket").agg(F.sum("bytes").alias("load")).where(F.col("load") > heavy_bytes).select(
        "bucket", (F.floor(F.col("load") / part_bytes) + 1).cast("int").alias("parts")), "heavy")
    found = (sent.join(F.broadcast(heavy), "bucket", "left_anti").groupBy("bucket")
             .applyInArrow(lambda group: repeats(group, length), "chunk bigint, runs binary"))
    runs = merged.where("bucket = -1").select("chunk", "runs").unionAll(found)
    if not heavy.isEmpty():
        again = scratch.save(dealt_again(sent.join(F.broadcast(heavy), "bucket"), length), "parts")
        runs = runs.unionAll(again.where("part = -1").select("chunk", "runs")).unionAll(
            again.where("part >= 0").groupBy("bucket", "part").applyInArrow(repeats_of_part, "chunk bigint, runs binary"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.column("runs").to_pylist() if right.num_rows else []
        out = pa.concat_tables([cut_documents(chunk, own, length) for _, chunk in each_chunk(left.to_batches())])
        release()
        return out

    return chunks.groupBy("chunk").cogroup(runs.groupBy("chunk")).applyInArrow(cut, RESULT_DDL)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                 **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs``;
    ``spans`` holds the removed ranges (first, end) of bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = scratch.save(docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("bigint").alias("size")), "rows")
    several = (rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
               .select("digest", "first"))
    rows = scratch.save(rows.join(several, "digest", "left").select(
        "doc_id", "id", "digest", "size", F.coalesce(F.col("id") != F.col("first"), F.lit(False)).alias("copy")), "flagged")

    # a text is read once, in the document of its smallest id
    gone = scratch.save(rows.where("copy").select("id", "digest").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    first = (docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col(text).alias("text"),
                         F.unhex(F.sha2(body, 256)).alias("digest"))
             .join(F.broadcast(gone) if few else gone, ["id", "digest"], "left_anti"))
    if not rows.where("NOT copy").groupBy("id", "digest").count().where("count > 1").isEmpty():
        first = first.dropDuplicates(["id", "digest"])  # repeated rows
    cut = repeated_strings(first.select(F.col("id").alias("doc_id"), "text"), scratch, length, **options)
    found = rows.where("NOT copy").join(cut.withColumnRenamed("doc_id", "id"), ["id", "digest"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    whole = F.col("size") >= length
    copies = rows.where("copy").select(
        "doc_id", F.col("size").alias("n_bytes"), F.when(whole, F.col("size")).otherwise(0).alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("size").alias("end"))))
        .otherwise(F.array().cast(SPANS)).alias("spans"))
    return found.unionAll(copies)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("spans")
