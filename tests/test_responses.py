"""HTTP chunk reassembly: every chunk size gives the same head and body."""

from pyspark.sql import functions as F

from sitegraph.sources import derived as X
from sitegraph.sources import http as HT

PAYLOAD = ("HTTP/1.1 301 Moved Permanently\r\nLocation: https://example.org/x/\r\nServer: t\r\n\r\n"
           "<html>body with \r\n\r\n inside and ünïcode</html>")


def test_chunk_size_sweep(spark):
    """Every receive size from 4 to 512 bytes: one distinct (head, body)."""
    sizes = spark.range(4, 513).select(F.col("id").cast("int").alias("response_id"))
    resp = sizes.select("response_id", F.lit(PAYLOAD.encode("utf-8")).alias("raw"))
    chunks = X.chunks(resp, F.col("response_id"))
    out = HT.split_head_body(HT.assemble_responses(chunks))
    assert out.count() == 509
    got = out.select("head", "body", "content_started").distinct().collect()
    assert len(got) == 1
    head, body, started = got[0]
    assert head == PAYLOAD.split("\r\n\r\n", 1)[0]
    assert bytes(body) == PAYLOAD.split("\r\n\r\n", 1)[1].encode()
    assert started is True


def test_no_separator(spark):
    raw = spark.createDataFrame([(1, b"abcdefghijkl")], "response_id int, raw binary")
    r = HT.split_head_body(HT.assemble_responses(X.chunks(raw, 6))).first()
    assert (r.head, bytes(r.body), r.content_started) == ("abcdefghijkl", b"", False)


def test_separator_split_across_chunks(spark):
    cases = [
        (["abcdef", "ghijkl", "\r\n\r\n12345678"], "abcdefghijkl", "12345678"),
        (["abcde\r\n\r\n", "123"], "abcde", "123"),
        (["abc\r\n", "\r\n123"], "abc", "123"),
        (["abcdef\r", "\n\r\n123"], "abcdef", "123"),
        (["abcde\r\n\r", "\n123"], "abcde", "123"),
    ]
    rows = [(i, j, part.encode()) for i, (parts, _, _) in enumerate(cases) for j, part in enumerate(parts)]
    chunks = spark.createDataFrame(rows, "response_id int, seq int, chunk binary")
    got = {r.response_id: (r.head, bytes(r.body).decode()) for r in HT.split_head_body(HT.assemble_responses(chunks)).collect()}
    assert got == {i: (h, b) for i, (_, h, b) in enumerate(cases)}


def test_parse_responses_headers(spark):
    raw = ("HTTP/1.1 302 Found\r\nSet-Cookie: a=1\r\nLocation: /next/\r\nset-cookie: b=2\r\n"
           "X-Empty:\r\n\r\n<html/>").encode()
    df = spark.createDataFrame([(1, "https://h.org/a/b.html", raw)], "response_id int, request_url string, raw binary")
    r = HT.parse_responses(df).first()
    assert (r.status, r.outcome, r.location) == (302, "redirect", "https://h.org/next/")
    assert r.headers == {"set-cookie": "b=2", "location": "/next/", "x-empty": ""}
    assert bytes(r.body) == b"<html/>"


def test_any_bytes(spark):
    """Neither a body nor a header has to be valid UTF-8."""
    body = bytes(range(256)) * 3
    raw = b"HTTP/1.1 404 Not Found\r\nX-Name: caf\xe9\r\nbroken line\r\n\r\n" + body
    chunks = X.chunks(spark.createDataFrame([(1, raw)], "response_id int, raw binary"), 7)
    r = HT.assemble_responses(chunks).withColumn("request_url", F.lit("https://orchard.test/"))
    r = HT.parse_responses(r).first()
    assert bytes(r.body) == body and r.headers == {"x-name": "caf\u00e9"} and r.status == 404


def test_long_responses_take_linear_time(spark):
    import time
    def seconds(mb):
        raw = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (mb << 20)
        df = X.chunks(spark.createDataFrame([(1, raw)], "response_id int, raw binary"), 63)
        t = time.time()
        assert HT.assemble_responses(df).select(F.octet_length("raw")).first()[0] == len(raw)
        return time.time() - t
    seconds(1)
    assert seconds(8) < 60  # copying per chunk took 10 s for 2 MB, and its square for more


def test_throttled_responses_are_failures(spark):
    from sitegraph.sinks.writers import failures
    df = spark.createDataFrame([("a", "error"), ("b", "throttled"), ("c", "ok"), ("d", "redirect")], "url string, outcome string")
    assert sorted(r.url for r in failures(df).collect()) == ["a", "b"]
