"""Operator 5: benchmark decontamination by a broadcast set of normalised n-grams.

Words are the runs of ASCII letters and digits and of non-ASCII characters of
the text with A-Z lower-cased.  The windows of a benchmark item are its runs of
``n`` consecutive words; an item with fewer words, but not none, is one window.
Every window goes into a hash set that each task holds; a document's token
windows are looked up in it, and a lookup compares the words themselves, so a
hit is verified.

The benchmark is a stated query set.  Its size is measured before anything is
broadcast: items are cut into blocks of at most ``block_bytes`` of text and the
documents are scanned with one block after the other, the result of a block
travelling on in the row (written to a shared table between blocks).  An item
larger than a block is a block of its own.

Defined results: a null or empty text has no words and no hit; an empty
benchmark hits nothing; an item without words or with a null text has no
window; repeated items count once per item id; items with a null id mark words
but are not listed; repeated documents each get their own row; other columns of
the documents are left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch, fresh, read, utf8

NGRAM = 10
BLOCK_BYTES = 4 << 20
RESULT = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
          "hits:array<struct<start:bigint,end:bigint>>>")

_KEEP = {*range(48, 58), *range(97, 123), *range(128, 256)}
NORMAL = bytes((c + 32 if 65 <= c <= 90 else c) if (c + 32 if 65 <= c <= 90 else c) in _KEEP else 32
               for c in range(256))
_WORD = re.compile(rb"[^\x20]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class WindowSet:
    """Hash set of the windows of some items: words -> item ids, by window length."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.windows: dict[int, dict[tuple, set]] = defaultdict(dict)
        self.vocabulary: set[bytes] = set()
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            self.vocabulary.update(words)
            size = min(n, len(words))
            table = self.windows[size]
            for i in range(len(words) - size + 1):
                table.setdefault(tuple(words[i:i + size]), set()).add(item)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items found."""
        marks = np.zeros(len(words) + 1, dtype=np.int32)
        found: set = set()
        if not words or not self.windows:
            return marks[:-1] > 0, found
        known = np.fromiter(map(self.vocabulary.__contains__, words), dtype=bool, count=len(words))
        unknown = np.concatenate([[0], np.cumsum(~known)])
        for size, table in self.windows.items():
            if len(words) < size:
                continue
            # only windows made of benchmark words can be in the set
            for i in np.flatnonzero(unknown[size:] == unknown[:-size]):
                items = table.get(tuple(words[i:i + size]))
                if items:
                    marks[i] += 1
                    marks[i + size] -= 1
                    found |= items
        return np.cumsum(marks[:-1]) > 0, found


def scan_column(text, before, items: list[tuple[str | None, bytes]], n: int):
    """Column of RESULT: hits of the items in ``text``, joined with the hits in
    ``before`` (a column of RESULT of an earlier block)."""
    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        windows = WindowSet(items, n)
        rows = []
        for body, old in zip(utf8(texts), earlier.to_pylist()):
            words = normal_words(body)
            hit, found = windows.scan(words)
            listed = {i for i in found if i is not None}
            if old:
                listed.update(old["items"])
                for span in old["hits"]:
                    hit[span["start"]:span["end"]] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            rows.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(listed),
                         "hits": [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]})
        return pa.array(rows, type=ARROW_RESULT)

    return scan.asNondeterministic()(text, before)


ARROW_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark in blocks of at most ``block_bytes`` of text, one in memory at a time."""
    cut = benchmark.select(F.col(item).cast("string").alias("item"),
                           F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("body"))
    block, size = [], 0
    for row in cut.toLocalIterator():
        if block and size + len(row.body) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, bytes(row.body)))
        size += len(row.body)
    yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
              item_text: str = "text", n: int = NGRAM, block_bytes: int = BLOCK_BYTES,
              into: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with one more column (its name is returned too) of type RESULT:
    number of words, words inside an occurrence of a window, the item ids found
    (sorted as strings) and the hit word ranges."""
    name = into or fresh(docs, "hits")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    out, last = docs.withColumn(name, F.lit(None).cast(RESULT)), None
    for k, block in enumerate(blocks_of(benchmark, item, item_text, block_bytes)):
        if k:
            out = scratch.save(out, f"block{k}")
            if last is not None:
                scratch.drop(last)
            last = f"block{k}"
        out = out.withColumn(name, scan_column(F.col(text), F.col(name), block, n))
    return out, name


def without_hits(text, hits):
    """Column: the text without its hit words and the separators between words of one hit."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, body, own in zip(texts.to_pylist(), utf8(texts), spans.to_pylist()):
            if not own:
                out.append(value)
                continue
            at = [m.span() for m in _WORD.finditer(body.translate(NORMAL))]
            kept, end = [], 0
            for span in own:
                kept.append(body[end:at[span["start"]][0]])
                end = at[span["end"] - 1][1]
            out.append(b"".join([*kept, body[end:]]).decode())
        return pa.array(out, type=pa.string())

    return cut(text, hits)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  text: str = "text", **options) -> DataFrame:
    """The documents without benchmark passages: ``remove="documents"`` drops every
    document with a hit, ``remove="spans"`` cuts the hit words out of the texts.
    Columns are those of ``docs``."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found, name = find_hits(docs, benchmark, text=text, **options)
    if remove == "documents":
        return found.filter(F.col(f"{name}.n_hit") == 0).select(*docs.columns)
    return found.withColumn(text, without_hits(F.col(text), F.col(f"{name}.hits"))).select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = find_hits(docs, read(spark, sf_dir, "benchmark"))
    hits = F.col(name)
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"))


SQL = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hits AS (
  SELECT d.doc_id, d.i, d.size, k.item
  FROM (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
              FROM docs, sizes WHERE len(w) >= size)) d
  JOIN windows k ON k.size = d.size AND k.win = d.win),
marked AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.items, '')) AS items_sha256,
  coalesce(m.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN marked m USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""
