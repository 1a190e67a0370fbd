"""Captured HTTP responses: chunk reassembly and header parsing (SRC5, URL15-16).

A response arrives as byte chunks (``response_id, seq, chunk``).  Reassembly
groups the chunks of one response -- a group never larger than that one
response -- and splits head from body at the *first* CRLFCRLF, wherever the
chunk borders fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import urls as U

_CRLF2 = "\r\n\r\n"


def assemble_responses(chunks: DataFrame, id_col: str = "response_id") -> DataFrame:
    """SRC5 part 1: ``(response_id, raw)`` with the chunks concatenated in seq order.

    Bytes are joined as ISO-8859-1 text (one character per byte, any byte is
    valid), which copies each byte once, however many chunks there are."""
    g = chunks.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda x: F.decode(x["chunk"], "ISO-8859-1")), "")
    return g.select(id_col, F.encode(text, "ISO-8859-1").alias("raw"))


def split_head_body(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """SRC5 part 2: head (before the first CRLFCRLF, read as ISO-8859-1, so any
    byte is valid) and body (the bytes after it, as they are).  No separator:
    all head, empty body."""
    latin = F.decode(F.col(raw_col), "ISO-8859-1")       # one char per byte
    pos = F.instr(latin, _CRLF2)
    head = F.when(pos > 0, F.substring(latin, F.lit(1), pos - 1)).otherwise(latin)
    body = F.when(pos > 0, F.substring(raw_col, pos + 4, F.octet_length(raw_col))).otherwise(F.unhex(F.lit("")))
    return df.withColumn("head", head).withColumn("body", body).withColumn("content_started", pos > 0)


def parse_responses(responses: DataFrame, url_col: str = "request_url", raw_col: str = "raw") -> DataFrame:
    """URL15/16 on each response: status, outcome, Location resolved against
    the request URL (only for redirects)."""
    r = split_head_body(responses, raw_col)
    r = r.withColumn("status", U.http_status("head")).withColumn("outcome", U.outcome("status"))
    loc = F.when(F.col("outcome") == "redirect", U.location_url("head", url_col))
    return r.withColumn("location", loc).withColumn("headers", header_map("head"))


def header_map(head_col: str = "head"):
    """Headers of a head block as MAP<STRING,STRING>: status line skipped,
    names lower-cased and trimmed, a repeated name keeps its last value."""
    lines = F.split(F.col(head_col), "\r\n")
    kv = F.transform(F.filter(lines, lambda l, i: (i > 0) & (F.instr(l, ":") > 0)),
                     lambda l, i: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("k"), i.alias("i"),
                                           F.trim(F.regexp_extract(l, r"^[^:]*:\s*(.*)$", 1)).alias("v")))
    # sorted by name and place: the last of a name is followed by another name
    by_name = F.array_sort(kv)
    last = F.filter(by_name, lambda e, i: ~F.coalesce(F.get(by_name, i + 1)["k"] == e["k"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
