"""Tables derived from the driver's ``pages`` and ``events`` by plain expressions.

The driver corpus has only ``<a href="/word">`` links and no link between its
pages, so the richer inputs the operators need are derived here, with rules
that DuckDB states identically (``sitegraph.checks.duck``).  All of them grow
with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.tables import table

# ---------------------------------------------------------------------------
# Fixed fixture values.
# Tag prefixes put in front of a page (chosen by page_id mod 6); "{host}" is
# replaced by the page host.
RICH_PREFIXES = (
    '<link rel="stylesheet" type="text/css" href="/static/site.css">'
    '<script type="text/javascript" src="app.js"></script><img src="../img/logo.png" alt="logo">',
    '<link rel="icon" href="/favicon.ico"><a href="//cdn.example.net/lib/x.js">cdn</a>'
    '<a href="mailto:team@example.com">mail</a>',
    '<a href="https://blog.{host}/post/1">b</a><a href="http://other.example.org/x/">o</a>'
    '<iframe src="/embed/frame.html"></iframe>',
    '<a href="./sub/page.html">s</a><a href="../up/">u</a><img src="pic.jpg" alt="p">',
    '<a href="?page=3">q</a><a href="#top">t</a><link href="/feed/" type="application/rss+xml">',
    '<script src="/js/main.js"></script><a title="x" href="docs/../guide/index.html">g</a>'
    '<link href="/print.css" media="print">',
)
# Resources of these pages (page_id mod 6) that were captured too: path, start of the body.
RESOURCES = {0: ("/static/site.css", "css of "), 5: ("/js/main.js", "js of ")}
# Edge rule of the synthetic link graph: p -> (a*p + b) mod n for each (a, b).
EDGE_RULES = ((7, 3), (13, 5))
# Instant the archive ages are measured from, and the age spread in minutes.
AS_OF = "2024-01-16 00:00:00"
AGE_SPREAD_MIN = 2000
AGE_FACTOR = 37
# Response fixtures: status by page_id mod 10, reason phrases, chunk size.
STATUS_BY_DIGIT = (200, 200, 200, 200, 99999999999, 500, 301, 302, 404, 429)
REASONS = {200: "OK", 301: "Moved Permanently", 302: "Found", 404: "Not Found", 429: "Too Many Requests",
           500: "Error", 99999999999: "Odd"}
# Bytes around the body of every tenth response (digit 3): no valid UTF-8.
BINARY_DIGIT, BINARY_START, BINARY_END = 3, "89504E470D0A1A0A", "FF00FE"
CHUNK_BYTES = 63
# Micro-batches of response chunks.
CHUNK_BATCHES = 4
# Micro-batches of requests, and the longest time that a request is under way.
REQUEST_BATCHES, REQUEST_DELAY_MIN = 4, 60
# ---------------------------------------------------------------------------


def simple_host(url) -> F.Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, r"^[a-z]+://([^/?#:]+)", 1)


def pages_rich(pages: DataFrame) -> DataFrame:
    """Pages with a tag prefix that exercises every link form and tag kind."""
    k = len(RICH_PREFIXES)
    prefix = F.lit(None).cast("string")
    for i in reversed(range(k)):
        prefix = F.when(F.col("page_id") % k == i, F.lit(RICH_PREFIXES[i])).otherwise(prefix)
    prefix = F.replace(prefix, F.lit("{host}"), simple_host("url"))
    return pages.select("page_id", "url", F.concat(prefix, F.col("html")).alias("html"))


def pages_and_resources(pages: DataFrame) -> DataFrame:
    """The rich pages and the resources captured beside them (negative ids)."""
    out = pages_rich(pages)
    for k, (path, body) in RESOURCES.items():
        out = out.unionByName(pages.where(F.col("page_id") % 6 == k).select(
            (-F.col("page_id") - 1).alias("page_id"),
            F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#:]+", 0), F.lit(path)).alias("url"),
            F.concat(F.lit(body), simple_host("url")).alias("html")))
    return out


def _page_count(pages: DataFrame) -> int:
    return pages.count()


def edges(pages: DataFrame, n: int | None = None) -> DataFrame:
    """(src, dst, src_url, dst_url): two out-edges per page by EDGE_RULES."""
    n = n if n is not None else _page_count(pages)
    p = pages.select("page_id", "url")
    rules = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGE_RULES])
    e = p.select(F.col("page_id").alias("src"), F.col("url").alias("src_url"),
                 F.posexplode(rules).alias("rule", "ab"))
    e = e.select("src", "src_url", "rule", ((F.col("ab.a") * F.col("src") + F.col("ab.b")) % n).alias("dst"))
    d = p.select(F.col("page_id").alias("dst"), F.col("url").alias("dst_url"))
    return e.join(d, "dst").select("src", "dst", "rule", "src_url", "dst_url")


def pages_linked(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Pages with a navigation in front that links to the pages of ``edges`` (full
    URLs, in rule order); their own html follows."""
    e = edges(pages, n)
    anchor = F.concat(F.lit('<a href="'), F.col("dst_url"), F.lit('">go</a>'))
    a1 = e.filter(F.col("rule") == 0).select(F.col("src").alias("page_id"), anchor.alias("a1"))
    a2 = e.filter(F.col("rule") == 1).select(F.col("src").alias("page_id"), anchor.alias("a2"))
    html = F.concat(F.lit("<nav>"), F.col("a1"), F.col("a2"), F.lit("</nav>"), F.col("html"))
    return pages.select("page_id", "url", "html").join(a1, "page_id").join(a2, "page_id") \
        .select("page_id", "url", html.alias("html"))


def archive(pages: DataFrame) -> DataFrame:
    """Previously saved copies: the https pages, one row per save path, the
    newest copy winning; ``fetched_at`` spreads over AGE_SPREAD_MIN minutes."""
    fetched = F.to_timestamp_ntz(F.lit(AS_OF)) - F.make_dt_interval(
        mins=(F.col("page_id") * AGE_FACTOR) % AGE_SPREAD_MIN)
    a = pages.filter(F.col("url").startswith("https://")).select(
        "page_id", U.save_path("url", "HTML").alias("save_path"),
        U.url_host("url").alias("host"), F.col("html").alias("body"), fetched.alias("fetched_at"))
    best = a.groupBy("save_path").agg(
        F.max_by(F.struct("body", "host", "page_id"), F.struct("fetched_at", "page_id")).alias("b"),
        F.max("fetched_at").alias("fetched_at"))
    return best.select(F.col("save_path").alias("page_key"), "save_path", "b.host",
                       "b.body", "fetched_at")


def copy_version(pages: DataFrame, version: int) -> DataFrame:
    """Archive rows of a write: version 0 has every page, 1 newer copies of every
    third page, 2 older copies of every third (another one); save paths overlap."""
    fetched = F.to_timestamp_ntz(F.lit(AS_OF)) - F.make_dt_interval(mins=(F.col("page_id") * AGE_FACTOR) % AGE_SPREAD_MIN)
    fetched = fetched + F.make_dt_interval(days=F.lit((0, 3, -3)[version]))
    some = pages if version == 0 else pages.filter(F.col("page_id") % 3 == version)
    return some.select(U.save_path("url", "HTML").alias("page_key"), U.save_path("url", "HTML").alias("save_path"),
                       U.url_host("url").alias("host"), F.concat(F.lit(f"v{version} "), F.col("html")).alias("body"),
                       fetched.alias("fetched_at"))


def requests(spark: SparkSession, sf: str, pages: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """One request per event: page = event_id mod n; errors ask for type NO."""
    pages = pages if pages is not None else table(spark, sf, "pages")
    n = n if n is not None else _page_count(pages)
    ev = table(spark, sf, "events").select(
        "event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % n).alias("page_id"))
    lt = F.when(F.col("event_type") == "error", F.lit("NO")).otherwise(F.lit("HTML"))
    return ev.join(pages.select("page_id", "url"), "page_id").select(
        F.col("event_id").alias("request_id"), "url", lt.alias("link_type"), "ts")


def request_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The requests with ``batch``, the quarter of all time in which each arrives: after up
    to REQUEST_DELAY_MIN minutes, so later ones overtake it.  The last batch ends with
    a heartbeat (a row without request and URL) far behind all requests."""
    r = requests(spark, sf)
    ends = r.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    arrival = F.col("ts") + F.make_dt_interval(mins=F.col("request_id") % (REQUEST_DELAY_MIN + 1))
    seconds = F.timestamp_diff("SECOND", F.lit(ends.low), arrival)
    quarter = F.timestamp_diff("SECOND", F.lit(ends.low), F.lit(ends.high)) / REQUEST_BATCHES + 1
    batch = F.least(F.floor(seconds / quarter), F.lit(REQUEST_BATCHES - 1)).cast("int")
    beat = spark.range(1).select(F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("url"),
                                 F.lit("HTML").alias("link_type"), (F.lit(ends.high) + F.make_dt_interval(days=F.lit(30))).alias("ts"),
                                 F.lit(REQUEST_BATCHES - 1).alias("batch"))
    return r.select("request_id", "url", "link_type", "ts", batch.alias("batch")).unionByName(beat)


def responses(pages: DataFrame, n: int | None = None) -> DataFrame:
    """Captured HTTP responses, one per page: status by page_id mod 10,
    Location for 301/302 (to p+1, to p+3, back to p-1 forming loops, or
    missing), body = the page's html, for BINARY_DIGIT between bytes that are no text."""
    n = n if n is not None else _page_count(pages)
    pid = F.col("page_id")
    digit = pid % 10
    status = F.lit(None).cast("bigint")
    for i in reversed(range(10)):
        status = F.when(digit == i, F.lit(STATUS_BY_DIGIT[i])).otherwise(status)
    target = (F.when(digit == 6, (pid + 1) % n)
              .when((digit == 7) & (pid % 40 == 7), F.lit(None))
              .when((digit == 7) & (pid % 20 == 17), (pid - 1 + n) % n)
              .when(digit == 7, (pid + 3) % n))
    base = pages.select("page_id", "url", "html", status.alias("status"), target.alias("target"))
    tgt = pages.select(F.col("page_id").alias("target"), F.col("url").alias("location"))
    r = base.join(tgt, "target", "left")
    reason = F.lit(None).cast("string")
    for code, text in REASONS.items():
        reason = F.when(F.col("status") == code, F.lit(text)).otherwise(reason)
    head = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" "), reason,
                    F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.when(F.col("location").isNotNull(),
                           F.concat(F.lit("Location: "), F.col("location"), F.lit("\r\n"))).otherwise(F.lit("")),
                    F.lit("\r\n"))
    text = F.encode(F.col("html"), "UTF-8")
    body = F.when(pid % 10 == BINARY_DIGIT, F.concat(F.unhex(F.lit(BINARY_START)), text, F.unhex(F.lit(BINARY_END)))) \
        .otherwise(text)
    ts = F.to_timestamp_ntz(F.lit(AS_OF)) - F.make_dt_interval(mins=pid)
    return r.select(F.col("page_id").alias("response_id"), F.col("url").alias("request_url"),
                    ts.alias("ts"), F.concat(F.encode(head, "UTF-8"), body).alias("raw"))


def chunks(resp: DataFrame, size=CHUNK_BYTES) -> DataFrame:
    """Responses cut into ``size``-byte pieces (response_id, seq, chunk);
    ``size`` may be a number or a column (one size per response)."""
    return _cut(resp.withColumn("_end", _last_seq(size)), size).drop("_end")


def _size(size):
    return size if isinstance(size, F.Column) else F.lit(int(size))


def _last_seq(size):
    """Column: the number of a response's last chunk."""
    return F.greatest(F.ceil(F.octet_length("raw") / _size(size)), F.lit(1)).cast("int") - 1


def _cut(resp: DataFrame, size) -> DataFrame:
    c = resp.select("response_id", "raw", "_end", _size(size).alias("_sz"),
                    F.explode(F.sequence(F.lit(0), _last_seq(size))).alias("seq"))
    return c.select("response_id", "seq", F.substring("raw", F.col("seq") * F.col("_sz") + 1, F.col("_sz")).alias("chunk"), "_end")


def chunk_batches(resp: DataFrame, size=CHUNK_BYTES) -> DataFrame:
    """The chunks with ``last`` (the connection ends with this one) and ``batch``, the one of
    CHUNK_BATCHES in which each arrives, in no order."""
    ends = resp.groupBy("response_id").agg(F.max(_last_seq(size)).alias("_end"))
    c = _cut(resp.join(ends, "response_id"), size)
    batch = F.pmod(F.xxhash64("response_id", "seq"), F.lit(CHUNK_BATCHES)).cast("int")
    return c.select("response_id", "seq", "chunk", (F.col("seq") == F.col("_end")).alias("last"), batch.alias("batch"))


def manifest_lines(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``TYPE\\tURL`` text lines of a manifest plus one URL-less line per page."""
    a = links.select(F.concat_ws("\t", "link_type", "url").alias("value"))
    b = pages.select(F.lit("NO").alias("value"))
    return a.unionByName(b)


def seed_lines(pages: DataFrame) -> DataFrame:
    """One line per page URL, each followed by a blank line."""
    return pages.select(F.explode(F.array(F.col("url"), F.lit(""))).alias("value"))
