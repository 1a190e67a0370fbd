"""URL columns: hand-worked values for the rules of ``sitegraph.functions.urls``,
and properties that hold for whole grids of made-up URLs."""

import itertools

import pytest
from pyspark.sql import functions as F

from sitegraph.functions import urls as U

SCHEMES = ["", "http://", "https://", "ftp://"]
HOSTS = ["orchard.test", "plum.orchard.test", "10.1.2.3"]
PATHS = ["", "/", "/pear", "/pear/", "/a.b/c-d/e_f.html"]
TAILS = ["", "?kind=7", "#core", " \t", "\r\n", "$x"]


def values(spark, expr, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r.out for r in df.coalesce(1).select(expr.alias("out")).collect()]


def test_parts_put_a_url_together_again(spark):
    grid = list(itertools.product(SCHEMES, HOSTS, PATHS, TAILS))
    df = spark.createDataFrame([("".join(g), *g) for g in grid], "url string, s string, h string, p string, t string")
    for r in df.select("s", "h", "p", "t", U.url_parts("url").alias("u")).collect():
        assert (r.u.protocol, r.u.host) == (r.s, r.h), r
        assert r.u.path == (r.p + "\t"[:0] if r.t != " \t" else r.p), r


def test_parts_of_odd_urls(spark):
    rows = [("https://orchard.test:8443/pear", "https://", "orchard.test", "/pear"), ("/pear/plum", "", "", "/pear/plum"),
            ("https://orchard.test/File:tree.png", "https://", "orchard.test", "/File:tree.png"), ("", "", "", ""),
            ("orchard.test:99", "", "orchard.test:99", "")]
    df = spark.createDataFrame(rows, "url string, s string, h string, p string")
    for r in df.select("*", U.url_parts("url").alias("u")).collect():
        assert (r.u.protocol, r.u.host, r.u.path) == (r.s, r.h, r.p), r.url


def test_host_path_drops_scheme_query_and_one_final_slash(spark):
    rows = [(s + h + p + t, (h + p)[:-1] if p.endswith("/") else h + p)
            for s, h, p, t in itertools.product(SCHEMES, HOSTS, PATHS, TAILS[:3])]
    assert values(spark, U.host_path("u"), "u string, want string", rows) == [w for _, w in rows]


@pytest.mark.parametrize("path,up", [("", 0), ("pear", 1), ("pear/", 1), ("pear/plum", 2), ("./pear/plum/", 2),
                                     ("pear/./plum", 2), ("pear/plum/../fig/", 2), ("../pear/", 0)])
def test_dir_count_and_relative_path(spark, path, up):
    assert values(spark, U.dir_count("p"), "p string", [(path,)]) == [up]
    assert values(spark, U.relative_path("p", "t"), "p string, t string", [(path, "fig/x.html")]) == ["../" * up + "fig/x.html"]


def test_dirname_ends_after_the_last_slash(spark):
    rows = [("pear", ""), ("pear/plum.html", "pear/"), ("pear/plum/", "pear/plum/"), ("a/b/c", "a/b/")]
    assert values(spark, U.dirname("p"), "p string, want string", rows) == [w for _, w in rows]


def test_is_file_url(spark):
    rows = [("https://orchard.test/pear.html", "HTML", True), ("https://orchard.test/pear", "HTML", False),
            ("https://orchard.test/v1.2/", "HTML", False), ("https://orchard.test/v1.2", "HTML", False),
            ("https://orchard.test/pear", "SCRIPT", True), ("https://orchard.test", "HTML", False),
            ("https://orchard.test/pear?file=x.png", "HTML", True)]
    assert values(spark, U.is_file_url("u", F.col("t")), "u string, t string, want boolean", rows) == [w for *_, w in rows]


def test_normalize_path(spark):
    rows = [("orchard.test/a/../b/./c", "orchard.test/b/c"), ("x//y\\z", "x/y/z"), ("..", ""), ("/", "/"),
            ("/a/..", "/"), ("a/b/../../../c/", "c/"), ("./a", "a")]
    assert values(spark, U.normalize_path("p"), "p string, want string", rows) == [w for _, w in rows]


def test_resolve_link(spark):
    file, folder = "https://orchard.test/guide/trees.html", "https://orchard.test/guide/trees"
    rows = [("leaf.png", file, "https://orchard.test/guide/leaf.png"), ("leaf.png", folder, folder + "/leaf.png"),
            ("/leaf.png", file, "https://orchard.test/leaf.png"), ("../leaf/", file, "https://orchard.test/leaf/"),
            ("http://seeds.test/a?b#c", file, "http://seeds.test/a?b#c"), ("httpd.html", file, "httpd.html"),
            ("fig/./kiwi/../lime", folder + "/", folder + "/fig/lime"), ("/", "./orchard.test/guide/x.html", "orchard.test/"),
            ("lime", "https://orchard.test:81/guide", "https://orchard.test/guide/lime"),
            ("tel:123", file, "https://orchard.test/guide/tel:123"), ("#core", file, "https://orchard.test/guide/#core")]
    assert values(spark, U.resolve_link("l", "p"), "l string, p string, want string", rows) == [w for *_, w in rows]


def test_save_path_of_pages_ends_in_an_index(spark):
    rows = [("https://orchard.test/guide" + end, t, "orchard.test/guide/index.html")
            for end, t in itertools.product(("", "/", "/index.html", "?page=2"), ("HTML", "NO"))]
    rows += [("https://orchard.test/tree.svg", "IMAGE", "orchard.test/tree.svg"),
             ("https://orchard.test/menu/", "SCRIPT", "orchard.test/menu"), ("https://orchard.test", "HTML", "orchard.test/index.html")]
    assert values(spark, U.save_path("u", F.col("t")), "u string, t string, want string", rows) == [w for *_, w in rows]


def test_link_type_by_tag_then_type_then_suffix(spark):
    suffixes = {".png": "IMAGE", ".jpg": "IMAGE", ".svg": "IMAGE", ".css": "STYLE", ".js": "SCRIPT", ".pdf": "NO", "": "NO"}
    types = {"text/css": "STYLE", "image/webp": "IMAGE", "text/javascript": "SCRIPT"}
    rows = [(tag, "/leaf" + s, t, want) for tag, want in (("a", "HTML"), ("img", "IMAGE"), ("script", "SCRIPT"))
            for s, t in itertools.product(suffixes, (None, "text/css"))]
    rows += [("link", "/leaf" + s, t, types[t]) for s, t in itertools.product(suffixes, types)]
    rows += [("link", "/leaf" + s + q, t, want) for s, want in suffixes.items() for q in ("", "?v=3", "#x")
             for t in (None, "", "application/json")]
    assert values(spark, U.link_type("tag", "l", "ty"), "tag string, l string, ty string, want string", rows) == [
        w for *_, w in rows]


def test_scope(spark):
    base = "https://orchard.test/guide"
    rows = [("https://orchard.test/x", True, True, True), ("http://orchard.test", True, True, True),
            ("https://plum.orchard.test", False, True, True), ("https://myorchard.test", False, True, False),
            ("https://test", False, False, False), ("https://seeds.test/orchard.test", False, False, False)]
    df = spark.createDataFrame([(u, base, *w) for u, *w in rows], "u string, p string, same boolean, sub boolean, dot boolean")
    for r in df.select("same", "sub", "dot", U.in_scope("u", "p", "same").alias("a"), U.in_scope("u", "p", "subdomain").alias("b"),
                       U.in_scope("u", "p", "subdomain", dot_boundary=True).alias("c"),
                       U.in_scope("u", "p", "none").alias("d")).collect():
        assert (r.a, r.b, r.c, r.d) == (r.same, r.sub, r.dot, True)


def test_http_status_and_outcome(spark):
    rows = [("HTTP/1.1 200 OK", 200, "ok"), ("HTTP/1.0 302", 302, "redirect"), ("HTTP/1.1  429 Slow down", 429, "throttled"),
            ("HTTP/1.1 503 Busy", 503, "error"), ("HTTP/3 200 OK", None, "parse_error"), ("HTTP/1.1 abc", None, "parse_error"),
            ("HTTP/1.1 99999999999 Too long", None, "parse_error"), ("HTTP/1.1 0", 0, "parse_error"), ("", None, "parse_error")]
    df = spark.createDataFrame(rows, "h string, status int, outcome string")
    for r in df.select("*", U.http_status("h").alias("s")).withColumn("o", U.outcome("s")).collect():
        assert (r.s, r.o) == (r.status, r.outcome), r.h


def test_location(spark):
    rows = [("HTTP/1.1 301 Moved\r\nLocation: /plum/\r\n", "https://orchard.test/pear", "https://orchard.test/plum/"),
            ("HTTP/1.1 301 Moved\r\nlocation: http://seeds.test/\r\nX: y", "https://orchard.test", "http://seeds.test/"),
            ("HTTP/1.1 302 Found\r\nlocation: a\r\nLocation: b\r\n", "https://orchard.test/", "https://orchard.test/b"),
            ("HTTP/1.1 302 Found\r\nServer: s\r\n", "https://orchard.test/", None)]
    assert values(spark, U.location_url("h", "u"), "h string, u string, want string", rows) == [w for *_, w in rows]
